"""Fill-in-the-middle: a text is cut into units, its middle moved to the end behind sentinels, and restored from the output. DataFrame functions alone; nothing is shuffled.

A unit grammar is stated by the classes of the two characters that meet where one unit ends and the next begins, and becomes a zero-width regular expression, ``(?<=[before])(?=[after])``. Splitting there loses no character, so the pieces joined again are the text. Only the empty text must be told apart, since splitting it gives one empty piece and not none.

The two cuts and the form follow from SHA-256 of the seed and doc_id, so reruns agree. A text that holds a sentinel stays as it is; hence the first sentinel of a kind in an output is the one that was put there (none is the beginning of itself, so none can arise where a piece meets it), and output and form give back the exact text.

Defined results: a null text counts as empty and stays plain, with no units; a null doc_id counts as ``""``; rows that share a doc_id are cut by the same numbers, each over its own units; cuts may leave any part empty; a very long text is handled whole in one row; an empty table gives an empty result; columns named as the new ones are replaced by them, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

SEED, RATE, SPM_SHARE = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_SPACE, _OTHER, _ANY = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"[\x{0}-\x{10FFFF}]"
#: For each unit grammar the classes (before, after) that meet at its boundaries.
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "token": [(_OTHER, _SPACE)],  # [space]*[other]+ | [space]+
    "run": [(_OTHER, _SPACE), (_SPACE, _OTHER)],  # [space]+ | [other]+
    "line": [(r"\n", _ANY)],  # [^\n]*\n | [^\n]+
    "char": [(_ANY, _ANY)],
}


def boundary(grammar: str) -> str:
    """The zero-width expression of the places where a unit of ``grammar`` ends and another begins."""
    return "|".join(f"(?<={a})(?={b})" for a, b in GRAMMARS[grammar])


def units(text: Column, grammar: str = "token") -> Column:
    """The pieces of a text, none for an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def fill_middle(docs: DataFrame, grammar: str = "token", rate: int = RATE, spm_share: int = SPM_SHARE, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n (units), form (plain, psm, spm), output, and prefix, middle, suffix (null where plain). ``rate``: percent of texts that are moved, ``spm_share``: percent of these that begin with the suffix."""
    new = ("n", "form", "output", "prefix", "middle", "suffix")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns if c not in new]).alias("_row"), text.alias("_text"), digest.alias("_digest")).withColumn("_units", units(F.col("_text"), grammar))
    row = row.withColumn("n", F.size("_units").cast("long")).withColumns({"_a": number(0) % (F.col("n") + 1), "_b": number(1) % (F.col("n") + 1)})
    held = [F.contains("_text", F.lit(s)) for s in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("_text") == "") | held[0] | held[1] | held[2] | (number(2) % 100 >= rate)
    row = row.withColumns({"form": F.when(plain, "plain").when(number(3) % 100 < spm_share, "spm").otherwise("psm"), "_from": F.least("_a", "_b").cast("int"), "_to": F.greatest("_a", "_b").cast("int")})
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start, length), ""))
    row = row.withColumns({
        "prefix": part(F.lit(1), F.col("_from")), "middle": part(F.col("_from") + 1, F.col("_to") - F.col("_from")), "suffix": part(F.col("_to") + 1, F.col("n").cast("int")),
    })
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("_text"))
    return row.withColumn("output", output).select("_row.*", *new)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone."""
    after = lambda x, head: F.substring(x, F.length(head) + len(SUFFIX) + 1, F.length(x))
    body = F.substring(output, len(PREFIX) + 1, F.length(output))
    first = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = after(body, first)
    second = F.substring_index(rest, MIDDLE, 1)
    middle = after(rest, second)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 13 over all documents."""
    made = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", chars("prefix"), chars("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_H = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
ORACLE_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM d),
c AS (SELECT *, len(w) AS n, {_H.format(1)} % (len(w) + 1) AS x, {_H.format(9)} % (len(w) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {_H.format(17)} % 100 >= {RATE} THEN 'plain' WHEN {_H.format(25)} % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(w[1 : least(x, y)], ''), '') AS a, coalesce(array_to_string(w[least(x, y) + 1 : greatest(x, y)], ''), '') AS m, coalesce(array_to_string(w[greatest(x, y) + 1 :], ''), '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || a || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || a || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
