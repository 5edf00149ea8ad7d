"""Validation of section texts in four layers; the first that fails names the reason."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import sha256
from corpusloom.operators.tables import small
from corpusloom.steps import written

# Patterns of pages that are no content, by the reason they give, in order.
ERROR_PAGE = ["(?:404|403|500|502)", "(?:page not found|access denied|404 not found)", "(?:internal server error|gateway timeout|500 error)"]
CAPTCHA = ["(?:captcha|recaptcha)", "(?:verify you are human)", r"(?:robot|bot)\s+(?:check|verification)"]
PAYWALL = ["(?:paywall|premium|membership)", r"(?:limited access|restricted content|subscribe\s+to\s+(?:access|view|receive))", r"(?:upgrade|sign up|sign in|purchase\s+(?:required|to\s+(?:view|access)))"]
SHOP = ["(?:order|purchase|cart)", "(?:shipping|delivery|address)", "(?:account|login|password)"]
# Signs of a code text.
INDICATORS = {
    "section_numbers": r"\d{3,4}\.\d+(?:\.\d+)*",
    "shall_compliance": r"\b(?:shall|shall not|shall be|shall comply)\b",
    "compliance_language": r"\b(?:in accordance with|subject to|permitted|prohibited|regulated|approved)\b",
    "standard_refs": r"\b(?:ASTM|NFPA|ACI|ASCE|AISC|IAPMO|ICC|ASHRAE)\s+[A-Z]?\d+",
    "code_terms": r"\b(?:section|chapter|appendix|table|figure|exception)\b",
    "definition_markers": r"\b(?:defined as|means|definition|shall be construed)\b",
}
# Fixed patterns: characters that few texts have.
CONTROL, ODD, EITHER = r"[\x00-\x08\x0B\x0C\x0E-\x1F]", r"[^\u0000-\u206F]", r"[\x00-\x08\x0B\x0C\x0E-\x1F\u2070-\x{10FFFF}]"
BLANK = " \t\n\x0b\f\r"
LEAST_CHARS, MOST_CONTROL, MOST_ODD, MOST_TAGS, MOST_REPEATED, LEAST_LINES = 20, 0.05, 0.1, 0.3, 0.2, 5


def _share(text: Column, pattern: str) -> Column:
    """Of the characters, those that the pattern, of one character, matches."""
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def control_share(text: Column) -> Column:
    return _share(text, CONTROL)


def odd_share(text: Column) -> Column:
    return _share(text, ODD)


def tag_ratio(text: Column) -> Column:
    """Tags for each word."""
    return F.regexp_count(text, F.lit("<[^>]+>")) / F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1))


def _many_tags(text: Column) -> Column:
    """Whether there are too many tags; without both brackets nothing is counted."""
    return text.contains("<") & text.contains(">") & (tag_ratio(text) > MOST_TAGS)


def _full_lines(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")


def repetition(text: Column) -> Column:
    """The share of all lines that equal the most frequent one; 0 for fewer than five. The lines are sorted and counted within the row, so nothing is shuffled."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit("").alias("line"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s.line == x, s.run + 1).otherwise(F.lit(1))
        return F.struct(x.alias("line"), run.alias("run"), F.greatest(s.best, run).alias("best"))

    return F.when(F.size(lines) < LEAST_LINES, 0.0).otherwise(F.aggregate(F.array_sort(_full_lines(lines)), start, step, lambda s: s.best) / F.size(lines))


def _repetitive(text: Column) -> Column:
    """Whether one line is too large a share; lines are sorted only where so few are different that one may be."""
    lines = F.split(text, "\n")
    full = _full_lines(lines)
    few = F.size(full) - F.size(F.array_distinct(full)) + 1 > MOST_REPEATED * F.size(lines)
    return text.rlike(rf"(?s)(?:\n.*?){{{LEAST_LINES - 1}}}") & few & (repetition(text) > MOST_REPEATED)


def format_error(text: Column) -> Column:
    """Layer 1. Two ends that aren't blank and what lies between them are a text without the blanks around it; shares are counted only where there is anything to count."""
    return (
        F.when(~F.is_valid_utf8(text), "Encoding error")
        .when(~F.coalesce(text.rlike(rf"(?s)\S.{{{LEAST_CHARS - 2}}}.*?\S"), F.lit(False)), "Content too short")
        .when(text.rlike(EITHER), F.when(text.contains("\0") | (control_share(text) > MOST_CONTROL), "Content appears to be binary").when(odd_share(text) > MOST_ODD, "Content contains mojibake"))
    )


@F.arrow_udf(T.StructType([*(T.StructField(name, T.BooleanType()) for name in ("error", "captcha", "paywall", "shop")), T.StructField("signs", T.IntegerType())]))
def _seen(low: pa.Array, text: pa.Array) -> pa.Array:
    """What patterns find: those of web pages in the text in lower case, and how many kinds of signs in the text. Arrow looks for all alternatives of a pattern in one pass over a batch, whose time doesn't hang on their number; the JVM's patterns try each at every character."""
    web = [pc.match_substring_regex(low, "|".join(p)) for p in (ERROR_PAGE, CAPTCHA, PAYWALL, SHOP)]
    signs = [pc.match_substring_regex(text, p, ignore_case=True).cast(pa.int32()) for p in INDICATORS.values()]
    return pa.StructArray.from_arrays([*web, reduce(pc.add, signs)], ["error", "captcha", "paywall", "shop", "signs"])


def seen(text: Column) -> Column:
    return _seen(F.lower(text), text)


def garbage_error(text: Column, web: Column, found: Column | None = None) -> Column:
    """Layer 2; the patterns of web pages hold for texts from the web only. ``found``: what ``seen`` gives, if it is there."""
    found = seen(text) if found is None else found
    return (
        F.when(web & found.error, "Error page pattern detected")
        .when(web & found.captcha, "CAPTCHA detected")
        .when(web & found.paywall, "Paywall detected")
        .when(web & found.shop, "Shop page detected")
        .when(_many_tags(text), "Excessive HTML tags")
        .when(_repetitive(text), "Excessively repetitive content")
    )


def indicator_count(text: Column) -> Column:
    """Layer 3, which never rejects: how many kinds of signs a text shows."""
    return seen(text).signs


def structure_ok(text: Column) -> Column:
    return indicator_count(text) >= F.when(F.length(text) < 200, 2).otherwise(3)


def truncated(text: Column) -> Column:
    last = F.btrim(F.substring_index(text, "\n", -1), F.lit(BLANK))
    return (text.contains("...") & text.rlike(r"\.\.\.\s*\z")) | ((F.length(last) > 100) & ~F.substring(last, -1, 1).isin(*".!?):"))


def bad_number(text: Column) -> Column:
    """Whether a section number has a part of more than three digits after the first."""
    return F.exists(F.regexp_extract_all(text, F.lit(r"(\d{3,4}\.\d+(?:\.\d+)*)"), 1), lambda n: n.rlike(r"\.\d{4,}"))


def flag_duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` with duplicate: an earlier row (by ``order``) has the same key. The least order of each key is aggregated and joined, so that a key of any frequency is neither sorted nor gathered in one task."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    return df.join(first, key).withColumn("duplicate", F.col(order) > F.col("_first")).drop("_first")


def validate(df: DataFrame, text: str = "text", order: str = "doc_id", web: Column | None = None) -> DataFrame:
    """(``order``, hash, layer, error, indicators) of every row of ``df``: the first layer that fails, else null. Only texts that pass the first two layers count as earlier copies; copies of one text all pass or all fail, unless ``web`` tells them apart.

    All that follows from a text is computed in one scan; only these narrow columns are shuffled, by hash.
    """
    content, from_web = F.col(text), F.lit(True) if web is None else web
    found = F.col("_found")
    narrow = df.withColumn("_found", seen(content)).select(
        order, sha256(content).alias("hash"), format_error(content).alias("_1"), garbage_error(content, from_web, found).alias("_2"), F.coalesce(truncated(content), F.lit(False)).alias("_cut"), F.coalesce(bad_number(content), F.lit(False)).alias("_bad"), found.signs.alias("indicators")
    )
    narrow = written(narrow.withColumn("_2", F.when(F.col("_1").isNull(), F.col("_2"))))
    first = narrow.filter("coalesce(_1, _2) IS NULL").groupBy("hash").agg(F.min(order).alias("_first"))
    late = F.when(F.col(order) > F.col("_first"), "Duplicate content").when(F.col("_cut"), "Content appears truncated").when(F.col("_bad"), "Invalid section number format")
    judged = narrow.join(first, "hash", "left").withColumn("_4", F.when(F.coalesce("_1", "_2").isNull(), late))
    layer = F.when(F.col("_1").isNotNull(), 1).when(F.col("_2").isNotNull(), 2).when(F.col("_4").isNotNull(), 4)
    return judged.select(order, "hash", layer.alias("layer"), F.coalesce("_1", "_2", "_4").alias("error"), "indicators")


def rejected(df: DataFrame, text: str = "text", order: str = "doc_id", web: Column | None = None) -> DataFrame:
    """The rows of ``df`` that a layer rejects, with layer, error and indicators: a row is told by its ``order`` and its text's hash. The verdicts are narrow rows that are written first: where they are few, no text is shuffled."""
    bad = small(written(validate(df, text, order, web).filter("layer IS NOT NULL").dropDuplicates([order, "hash"]).withColumnRenamed(order, "_order")))
    own = df.withColumn("_hash", sha256(F.col(text)))
    return own.join(bad, own[order].eqNullSafe(bad._order) & own._hash.eqNullSafe(bad.hash)).drop("_order", "_hash", "hash")


def quarantine(rejected: DataFrame, text: str = "text", most: int = 5000) -> DataFrame:
    """Rows for the reject sink: the content cut to ``most`` characters, the errors joined, the rest as JSON."""
    return rejected.select(F.col("doc_id").alias("source_id"), F.col("layer").alias("validation_layer"), F.concat_ws(" | ", "error").alias("error_message"), F.substring(text, 1, most).alias("raw_content"), F.to_json(F.struct("indicators")).alias("metadata"))
