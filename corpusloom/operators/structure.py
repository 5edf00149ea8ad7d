"""Structure of paged documents: running lines, outlines, sections.

Pages come as rows (doc, page, text); files are opened by whatever reads them, outside of this library.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.scan import running
from corpusloom.operators.tables import small
from corpusloom.steps import written

EDGE_LINES, LEAST_PAGES, PAGE_SHARE, OFFSET, FRONT_PAGES, OCR_CHARS, MOST_CHARS = 3, 5, 0.25, 20, 40, 50, 200_000
# Fixed patterns: a row of a printed outline (number, title, leader, page); the heading above it.
TOC_ROW = r"^\s*((?:Chapter|Part|Appendix)\s+[A-Z0-9IVX]+|[A-Z]\.\d+(?:\.\d+)*|\d+(?:\.\d+)+|\d+)\s+(.+?)\s*[.\s·•]{2,}\s*(\d+)\s*$"
TOC_HEADING = r"^\s*(Contents|Table of Contents|CONTENTS|TABLE OF CONTENTS)\s*$"


def over_chapters(chapters: DataFrame) -> DataFrame:
    """(book, chapter, at, place, section) of ``chapters`` (book, chapter, sections): the sections of a book's chapters one after another, numbered from 0 over the book by ``place`` and within the chapter by ``at``.

    Only the chapters' sizes are scanned, a narrow row each; their sections move at most for one join. A chapter without sections gives none, null ones stay; rows of one chapter that come twice make one chapter, with the sections of the row that has most (of these, the greatest).
    """
    one = chapters.groupBy("book", "chapter").agg(F.max(F.struct(F.size("sections").alias("n"), "sections")).alias("c")).select("book", "chapter", "c.n", "c.sections")
    one = written(one.withColumn("n", F.greatest("n", F.lit(0)).cast("long")))
    before = running(one.select(F.col("book").alias("_b"), F.col("chapter").alias("_c"), "n"), "_b", ["_c"], sums={"_last": F.col("n")}).withColumn("_first", F.col("_last") - F.col("n")).drop("n", "_last")
    placed = one.join(before, one.book.eqNullSafe(before._b) & one.chapter.eqNullSafe(before._c))
    return placed.select("book", "chapter", "_first", F.posexplode("sections").alias("at", "section")).select("book", "chapter", "at", (F.col("_first") + F.col("at")).alias("place"), "section")


def lines_of(pages: DataFrame) -> DataFrame:
    """(doc, page, at, line, of): every line, its place from 1 and the page's number of lines."""
    split = pages.select("doc", "page", F.split("text", "\n").alias("all"))
    return split.select("doc", "page", F.size("all").alias("of"), F.posexplode("all").alias("at", "line")).withColumn("at", F.col("at") + 1)


def running_lines(pages: DataFrame) -> DataFrame:
    """(doc, line): lines among the first or last three of a page that stand so on at least five pages and a quarter of all. Counted by partial sums, top and bottom each by itself."""
    lines = lines_of(pages).withColumn("line", strip(F.col("line")))
    least = pages.groupBy("doc").agg(F.greatest(F.lit(LEAST_PAGES), F.floor(F.count("*") * PAGE_SHARE)).alias("least"))
    counted = lines.groupBy("doc", "line").agg(F.count_if(F.col("at") <= EDGE_LINES).alias("top"), F.count_if(F.col("at") > F.col("of") - EDGE_LINES).alias("bottom"))
    return counted.join(least, "doc").filter("top >= least OR bottom >= least").select("doc", "line")


def body_lines(pages: DataFrame) -> DataFrame:
    """``lines_of`` without empty lines, page numbers and running lines."""
    kept = lines_of(pages).withColumn("_line", strip(F.col("line"))).filter("_line <> '' AND NOT _line RLIKE '^[0-9]{1,4}$'")
    noisy = running_lines(pages).select(F.col("doc").alias("_doc"), F.col("line").alias("_noisy"))
    return kept.join(noisy, (F.col("doc") == F.col("_doc")) & (F.col("_line") == F.col("_noisy")), "left_anti").drop("_line")


def needs_ocr(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)), F.lit(0)) < OCR_CHARS


def toc_rows(pages: DataFrame) -> DataFrame:
    """(doc, page, at, number, title, printed): rows of the printed outline on the first forty pages, below its heading."""
    lines = lines_of(pages.filter(F.col("page") <= FRONT_PAGES)).filter("trim(line) <> ''")
    heading = lines.filter(F.col("line").rlike(TOC_HEADING)).groupBy("doc").agg(F.min(F.struct("page", "at")).alias("from"))
    rows = lines.join(heading, "doc").filter(F.struct("page", "at") > F.col("from")).filter(F.col("line").rlike(TOC_ROW))
    of = lambda k: F.regexp_extract("line", TOC_ROW, k)
    return rows.select("doc", "page", "at", of(1).alias("number"), F.regexp_replace(of(2), "[.·•]+$", "").alias("title"), of(3).cast("int").alias("printed"))


# Fixed pattern: a number before a title.
NUMBERED = r"^((?:Chapter|CHAPTER|Part|PART|Appendix|APPENDIX)\s+[A-Z0-9IVX]+|[A-Z]\.\d+(?:\.\d+)*|\d+(?:\.\d+)+|\d+)\s+(.*)$"


def embedded_outline(entries: DataFrame) -> DataFrame:
    """(doc, seq, number, title, page, depth) of the outline that a file carries: ``entries`` (doc, seq, level, title, page), whatever reads them. An entry without a title goes; one without a number is told by its title's first 32 characters."""
    title = strip(F.col("title"))
    number = F.regexp_extract(title, NUMBERED, 1)
    clean = F.when(number != "", strip(F.regexp_extract(title, NUMBERED, 2))).otherwise(title)
    return entries.filter(title != "").select("doc", "seq", F.when(number != "", number).otherwise(F.substring(clean, 1, 32)).alias("number"), clean.alias("title"), F.greatest(F.lit(1), "page").alias("page"), F.greatest(F.lit(0), F.col("level") - 1).alias("depth"))


def file_page(printed: Column, pages: Column) -> Column:
    """A printed page's number in the file: twenty pages on, within the file."""
    return F.least(F.greatest(F.lit(1), F.coalesce(printed, F.lit(1)) + OFFSET), F.greatest(F.lit(1), pages))


def section_bounds(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """``toc`` (doc, seq, page) with first and last: from its page to the one before the next entry's, within the file. ``pages``: (doc, n)."""
    following = F.lead("page").over(Window.partitionBy("doc").orderBy("seq"))
    first = F.greatest(F.lit(1), F.least("page", "n"))
    return toc.join(pages, "doc").withColumn("_next", following).withColumn("first", first).withColumn("last", F.greatest("first", F.least(F.coalesce(F.col("_next") - 1, F.col("n")), F.col("n")))).drop("_next", "n")


def repair_pages(toc: DataFrame, pages: DataFrame, window: int = 10) -> DataFrame:
    """``toc`` (doc, seq, number, page) with page mended and state: '' where its number begins a line of the page, 'verified' where it was found within ``window`` pages after the last good one, else 'unverified' there. A number that is null or blank stands on no page; a null page is none that an entry claims; the entries of a document without pages have page 0, unverified.

    What was found last decides where the next is looked for, so a document is one group; of its pages, only those lines reach the worker that begin with a number of its outline, and of them the number.
    """
    wanted = toc.filter(strip(F.coalesce("number", F.lit(""))) != "").select(F.col("doc").alias("_doc"), strip(F.col("number")).alias("number")).distinct()
    # a line's beginnings as long as a number of the outline are looked up: a few keys for each line, however many numbers there are
    long = wanted.groupBy(F.col("_doc").alias("doc")).agg(F.collect_set(F.length("number")).alias("_long"))
    heads = lines_of(pages).select("doc", "page", F.regexp_replace("line", r"^\s+", "").alias("_line")).filter("_line <> ''")
    begun = heads.join(small(written(long)), "doc").select("doc", "page", "_line", F.explode(F.filter("_long", lambda k: k <= F.length("_line"))).alias("_k"))
    begun = begun.select("doc", "page", "_line", F.substr("_line", F.lit(1), F.col("_k")).alias("number")).filter(_ends_word(F.col("number"), F.col("_line"))).select("doc", "page", "number")
    there = begun.join(wanted, (F.col("doc") == F.col("_doc")) & (begun.number == wanted.number)).select("doc", "page", begun.number)
    counts = pages.groupBy("doc").agg(F.max("page").alias("n"))
    per_doc = counts.join(there.distinct(), "doc", "left").select("doc", "n", "page", "number")

    def mend(key, entries: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        n = int(there.n.max()) if len(there) else 0
        on = there.loc[there.number.notna(), ["number", "page"]].sort_values(["number", "page"], ignore_index=True)
        pages_, numbers = on["page"].tolist(), on["number"]
        starts = on.index[numbers != numbers.shift()].tolist()  # where each number's pages begin
        run = dict(zip(numbers.iloc[starts], pairwise([*starts, len(on)]), strict=True))
        entries = entries.sort_values("seq")
        last, mended, states = 1, [], []
        for number, page in zip(entries["number"], entries["page"], strict=True):
            lo, hi = run.get((number or "").strip(), (0, 0))
            said = None if pd.isna(page) else int(page)
            claimed = max(1, min(said, n)) if said is not None else 0
            near, at = (bisect_left(pages_, p, lo, hi) for p in (last, claimed))
            if claimed >= last and at < hi and pages_[at] == claimed:
                page, state, last = said, "", claimed
            elif near < hi and pages_[near] <= min(last + window, n):
                page, state, last = int(pages_[near]), "verified", int(pages_[near])
            else:
                page, state = min(last, n), "unverified"
            mended.append(page)
            states.append(state)
        return entries.assign(page=pd.array(mended, "Int32"), state=states)

    kind = dict(toc.dtypes)
    schema = f"doc {kind['doc']}, seq {kind['seq']}, number string, page int, state string"
    return toc.select("doc", "seq", "number", "page").groupBy("doc").cogroup(per_doc.groupBy("doc")).applyInPandas(mend, schema)


def _ends_word(number: Column, line: Column) -> Column:
    """Whether ``number`` ends at a word's edge in ``line``, which begins with it."""
    word = r"^[\p{L}\p{N}_]$"
    last, following = F.substring(number, -1, 1), F.substr(line, F.length(number) + 1, F.lit(1))
    return last.rlike(word) != following.rlike(word)


def sectionize(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc, section, chapter, number, title, body): sections of ``lines`` (doc, at, line), each from its header line (a section number first) to the next; a chapter's heading ends one. Lines before the first are left out. A document's lines go on over as many ranges as they need (``scan.running``)."""
    s = strip(F.col("line"))
    number, chapter = F.regexp_extract(s, r"^(\d{3,4}\.\d+(?:\.\d+)*)\b", 1), F.regexp_extract(s, r"^(?:CHAPTER|Chapter)\s+(\d+)", 1)
    marked = lines.select("doc", "at", "line", F.when(number != "", number).alias("_number"), F.when(chapter != "", chapter).alias("_chapter"))
    header = F.col("_number").isNotNull() | F.col("_chapter").isNotNull()
    grouped = running(marked, "doc", ["at"], {"section": header.cast("int")}, {"chapter": F.col("_chapter")}, ranges)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x.line), "\n")
    title = F.trim(F.regexp_replace(F.max(F.when(F.col("_number").isNotNull(), s)), r"^[\d.]+", ""))
    return grouped.groupBy("doc", "section").agg(F.max("chapter").alias("chapter"), F.max("_number").alias("number"), title.alias("title"), text.alias("body")).filter("number IS NOT NULL")


def page_of_line(lines: DataFrame, starts: DataFrame, ranges: int | None = None) -> DataFrame:
    """``lines`` (doc, at) with page, that of the last of ``starts`` (doc, page, start) at or before it: both in one order, the page carried forward over the ranges of that order. Of starts at one place the last page counts."""
    both = lines.select("doc", F.col("at").cast("long").alias("at"), F.lit(None).cast("int").alias("_page"), F.lit(1).alias("_k"), F.monotonically_increasing_id().alias("_i"))
    first = starts.select("doc", F.col("start").cast("long").alias("at"), F.col("page").cast("int").alias("_page"), F.lit(0).alias("_k"), F.col("page").cast("long").alias("_i"))
    return running(both.unionByName(first), "doc", ["at", "_k", "_i"], lasts={"page": F.col("_page")}, ranges=ranges).filter("_k = 1").select("doc", "at", "page")


def page_starts(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc, page, start): the number of lines before each page, from the pages' numbers of lines; no text is moved."""
    n = pages.select("doc", "page", F.size(F.split("text", "\n")).alias("_n"))
    return running(n, "doc", ["page"], {"_upto": F.col("_n")}, ranges=ranges).select("doc", "page", (F.col("_upto") - F.col("_n")).alias("start"))


def _heading(number: Column, title: Column) -> Column:
    quote = lambda x: F.regexp_replace(x, r"([^A-Za-z0-9_ ])", r"\\$1")
    return F.concat(F.lit(r"(?m)^\s*(?:"), quote(strip(number)), F.lit("|"), quote(F.substring(strip(title), 1, 40)), F.lit(r")\b"))


def slice_body(text: Column, number: Column, title: Column, next_number: Column, next_title: Column) -> Column:
    """``text`` from its heading, if it has one, to the next one's, blank lines made one, cut to the longest length."""
    at = F.regexp_instr(text, _heading(number, title))
    body = F.when(at > 1, F.substr(text, at)).otherwise(text)
    rest = F.substr(body, F.lit(2))
    end = F.regexp_instr(rest, _heading(next_number, next_title))
    cut = F.when(F.coalesce(end, F.lit(0)) > 0, F.substr(body, F.lit(1), end)).otherwise(body)
    return F.substring(strip(F.regexp_replace(cut, r"\n{3,}", "\n\n")), 1, MOST_CHARS)
