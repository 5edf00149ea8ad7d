"""References from a section's text to other sections, tables, figures, exceptions, standards and parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns, by kind, in the order in which references are told; group 1 is the target.
_NUMBER = r"(?:Section|§)\s+(\d{3,4}(?:\.\d+)*)"
_TARGET = r"\d{3,4}(?:\.\d+)*$"
MANDATORY = [rf"shall comply with {_NUMBER}", rf"in accordance with {_NUMBER}", rf"(?:shall )?comply with the (?:provisions|requirements) of {_NUMBER}"]
INFORMATIONAL = [rf"see {_NUMBER}", rf"see also {_NUMBER}", rf"refer to {_NUMBER}"]
EXCEPTION = r"Exception(?:\s+\d+)?(?:\s*\(.*?\))?:\s*(.+?)(?=(?:Exception|$))"
TABLE, FIGURE = r"(?:Table|see Table)\s+(\d+(?:\.\d+)?)", r"(?:Figure|see Figure|as shown in Figure)\s+(\d+(?:\.\d+)?)"
STANDARD = r"((?:ASTM|NFPA|ACI|ASCE|AISC|IAPMO|ICC|ASHRAE)\s+[A-Z]?\d+[-.]?\d*(?:-\d+)?)"
PART = r"(?:Title\s+\d+,\s+)?Part\s+(\d+)(?:[,\s]+(?:Section|§)\s+(\d{3,4}(?:\.\d+)*))?"
#: Words that a reader may click, and what they point to.
LINK = r"(Sections?|Chapters?|Figures?|Tables?|Appendix|Appendices)\s+([A-Z]{0,3}\d+(?:[.\-]\d+)*(?:[A-Z]+)?)"


def _all(text: Column, pattern: str, group: int, flags: str = "(?i)") -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), group)


def _struct(kind: str, target: Column | None, standard: Column | None, text: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), (none if target is None else target).alias("target"), (none if standard is None else standard).alias("standard"), text.alias("text"))


def extract(text: Column) -> Column:
    """An array of (kind, target, standard, text), kind by kind, each in the order of the text."""
    parts = []
    for kind, patterns in (("mandatory", MANDATORY), ("informational", INFORMATIONAL)):
        for p in patterns:
            # the target ends the match: the text is searched once
            parts.append(F.transform(_all(text, p, 0), lambda w: _struct(kind, F.regexp_extract(w, _TARGET, 0), None, w)))  # noqa: B023
    parts.append(F.transform(_all(text, EXCEPTION, 1, "(?is)"), lambda x: _struct("exception", None, None, F.concat(F.lit("Exception: "), F.substring(x, 1, 100)))))
    parts.append(F.transform(_all(text, TABLE, 1), lambda x: _struct("table", None, None, F.concat(F.lit("Table "), x))))
    parts.append(F.transform(_all(text, FIGURE, 1), lambda x: _struct("figure", None, None, F.concat(F.lit("Figure "), x))))
    parts.append(F.transform(_all(text, STANDARD, 1), lambda x: _struct("external_standard", None, F.upper(x), F.upper(x))))
    across = F.transform(_all(text, PART, 0), lambda w: F.struct(F.regexp_extract(w, "(?i)" + PART, 1).alias("part"), F.regexp_extract(w, "(?i)" + PART, 2).alias("target")))
    named = F.filter(across, lambda r: F.coalesce(r["target"], F.lit("")) != "")
    parts.append(F.transform(named, lambda r: _struct("cross_part", r["target"], None, F.concat(F.lit("Part "), r["part"], F.lit(", Section "), r["target"]))))
    return F.concat(*parts)


#: Numbers that one range may give; a wider one stays as it is.
MOST_OF_RANGE = 1000


def expand_range(reference: Column, most: int = MOST_OF_RANGE) -> Column:
    """``a.1 through a.5`` as all its numbers; anything else, ends of different depth, or a range of more than ``most`` numbers, as it is."""
    ends = F.split(reference, r"(?i)\s+through\s+")
    first, last = (F.split(F.trim(F.element_at(ends, i)), r"\.") for i in (1, 2))
    low, high = (F.element_at(p, -1).try_cast("int") for p in (first, last))
    upto = F.least(high, low.cast("long") + (most - 1)).cast("int")  # bounded whatever the condition below makes of it
    numbers = F.transform(F.sequence(low, F.greatest(low, upto)), lambda n: F.array_join(F.concat(F.slice(first, 1, F.size(first) - 1), F.array(n.cast("string"))), "."))
    whole = F.array(F.trim(reference))
    expandable = (F.size(ends) == 2) & (F.size(first) == F.size(last)) & low.isNotNull() & high.isNotNull()
    return F.when(F.size(ends) != 2, whole).when(expandable & (high.cast("long") - low >= most), whole).when(expandable & (low <= high), numbers).when(expandable, F.expr("cast(array() as array<string>)")).otherwise(whole)


def links(text: Column) -> Column:
    """Every clickable reference: the whole and its number."""
    return F.arrays_zip(_all(text, LINK, 0, "").alias("whole"), _all(text, LINK, 2, "").alias("number"))


def link_keys(number: Column) -> Column:
    """The section numbers that a clickable number may mean, the best first."""
    return F.array(number, *[F.concat(F.lit(f"{k} "), number) for k in ("Chapter", "Figure", "Table", "Appendix")])
