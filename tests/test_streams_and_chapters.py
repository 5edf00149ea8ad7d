"""JSON lines as a stream, sections over chapters, texts to embed again: small cases that the corpus has none of."""

import json

from corpusloom.operators.lifecycle import changed_texts
from corpusloom.operators.structure import over_chapters
from corpusloom.streaming import ingest


def test_pieces_of_files_that_come_later(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()

    def add(name, *lines):
        (tmp_path / "in" / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
        ingest.run_once(ingest.answer_pieces(ingest.read_lines(spark, source)), out, checkpoint)
        return {(r.answer, r.part): (r.text, r.done) for r in ingest.answer_parts(spark.read.schema("answer long, seq long, piece string, done boolean").parquet(out), 2).collect()}

    line = lambda seq, piece, done=False: {"answer": 7, "seq": seq, "response": piece, "done": done}
    assert add("a.json", line(1, " of"), line(0, "Loads"), '{"answer": 7, "se', "", {"seq": 3}, {"answer": 8, "seq": 0, "message": {"content": "x"}}) == {(7, 0): ("Loads of", False), (8, 0): ("x", False)}
    # a line that came before comes again, and a restart reads new files only
    assert add("b.json", line(1, " of"), line(2, " snow"), {"answer": 7, "seq": 3, "done": True}) == {(7, 0): ("Loads of", False), (7, 1): (" snow", True), (8, 0): ("x", False)}
    assert spark.read.parquet(out).count() == 6
    assert add("c.json") == add("d.json", "[]", "null", "7")


def test_over_chapters(spark):
    rows = [("b", 2, ["c", None]), ("b", 1, ["a", "b"]), ("b", 3, []), ("b", 4, None), ("b", 5, ["d"]), ("b", 5, ["d"]), (None, 1, ["x"]), (None, None, ["first"])]
    df = spark.createDataFrame(rows, "book string, chapter int, sections array<string>")
    got = sorted(((r.book or "", r.place, r.chapter, r.at, r.section) for r in over_chapters(df).collect()), key=str)
    assert got == sorted([("b", 0, 1, 0, "a"), ("b", 1, 1, 1, "b"), ("b", 2, 2, 0, "c"), ("b", 3, 2, 1, None), ("b", 4, 5, 0, "d"), ("", 0, None, 0, "first"), ("", 1, 1, 0, "x")], key=str)
    assert over_chapters(df.limit(0)).count() == 0


def test_changed_texts(spark):
    columns = "id int, normalized_hash string"
    before = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (None, "n")], columns)
    after = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d"), (4, "d"), (None, "n"), (None, "m")], columns)
    assert sorted((r.id or 0, r.normalized_hash) for r in changed_texts(before, after).collect()) == [(0, "m"), (2, "c"), (4, "d"), (4, "d")]
