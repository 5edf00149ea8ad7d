"""Text functions, all native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that broken fonts give, and ligatures, with what they stand for.
GLYPHS = {"þ": "+", "Þ": ")", "ð": "(", "Ð": "(", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
# Symbols whose subscript got lost, and how they are to read.
SUBSCRIPTS = {
    "Lr": "L_r", "pf": "p_f", "ps": "p_s", "pg": "p_g",
    "WT": "W_T", "Kz": "K_z", "Kd": "K_d", "Kh": "K_h", "Kzt": "K_zt", "Ke": "K_e", "qz": "q_z", "qh": "q_h", "Cf": "C_f", "Cp": "C_p",
    "SDS": "S_DS", "SD1": "S_D1", "SMS": "S_MS", "SM1": "S_M1", "PGAM": "PGA_M", "MCER": "MCE_R", "Cs": "C_s", "Cd": "C_d", "Cu": "C_u", "TL": "T_L",
    "Ak": "A_k", "Af": "A_f", "Ag": "A_g", "Di": "D_i", "Wi": "W_i", "hi": "h_i", "hn": "h_n", "Fy": "F_y", "Fu": "F_u", "Iz": "I_z", "Ie": "I_e", "VS30": "V_S30",
}
# Fixed patterns: a colon that stands for a decimal point; marks that begin a paragraph of their own; formula lines; marks left by broken fonts.
COLON_POINT = r"([0-9]):(?=[0-9]|[A-Z]\b|[A-Z][a-z]?\b)"
OWN_PARAGRAPH = r"(?i)^(\d+[a-z]?\.\s|\(\s*[a-z0-9ivx]+\s*\)|[•◦·●]\s|(EXCEPTION|EXCEPTIONS|User\sNote|Note|COMMENTARY)s?:)"
FORMULA_START, FORMULA_OPERATOR = r"^\d+[a-z]?\.\s+[A-Z0-9(]", r"[+−=]|\("
# White space, that beyond ASCII with it (what is printed in ASCII is told first), and characters that end a line.
SPACE = r"[[^!-~]&&[\s\x1C-\x1F\x85\p{Z}]]"
LINE_ENDS = "\r\x0b\f\x1c\x1d\x1e\x85  "
SUSPECT = r"[þðÞÐﬁﬂﬀﬃﬄ]|\b[0-9]+:[0-9]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _trim(c: Column) -> Column:
    """``c`` without ``SPACE`` at its ends."""
    return F.btrim(c, F.lit("".join(filter(str.isspace, map(chr, range(0x3001))))))


def squeeze(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return strip(F.lower(F.regexp_replace(c, r"(?U)\s+", " ")))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def fix_glyphs(c: Column) -> Column:
    return reduce(lambda out, glyph: F.replace(out, F.lit(glyph), F.lit(GLYPHS[glyph])), GLYPHS, c)


def fix_colons(c: Column) -> Column:
    return F.regexp_replace(c, COLON_POINT, "$1.")


def has_glyph_artifacts(c: Column) -> Column:
    return F.coalesce(c.rlike(SUSPECT), F.lit(False))


def restore_subscripts(c: Column) -> Column:
    """On formula lines, symbols with an underscore before their subscript. One replacement for all symbols that begin alike."""
    tails: dict[str, list[str]] = {}
    for shown in SUBSCRIPTS.values():
        head, _, tail = shown.partition("_")
        tails.setdefault(head, []).append(tail)
    out = c
    for head, found in tails.items():
        out = F.regexp_replace(out, rf"\b{head}({'|'.join(sorted(found, key=len, reverse=True))})\b", f"{head}_$1")
    return F.when(c.rlike(FORMULA_START) & c.rlike(FORMULA_OPERATOR), out).otherwise(c)


def strip_heading(c: Column, number: Column, title: Column) -> Column:
    """``c`` without a leading number and title; the title in any case and with any white space."""
    quote = lambda x: F.regexp_replace(x, r"([^A-Za-z0-9_ ])", r"\\$1")
    number = strip(number)
    short = F.regexp_replace(strip(title), r"[.:—-]+$", "")
    with_title = F.concat(F.lit(r"(?i)^\s*"), quote(number), F.lit(r"\s+"), F.replace(quote(short), F.lit(" "), F.lit(r"\s+")), F.lit(r"\s*"))
    alone = F.concat(F.lit(r"^\s*"), quote(number), F.lit(r"\s+"))
    pattern = F.when(F.coalesce(short, F.lit("")) != "", with_title).otherwise(alone)
    return F.when(F.coalesce(number, F.lit("")) == "", c).otherwise(F.regexp_replace(c, pattern, F.lit("")))


def paragraphs(text: Column) -> Column:
    """Lines put together: a blank line or a list mark begins a paragraph, a hyphen at a line's end joins without a space. Null and blank texts have none.

    Lines hold no line break, so that the breaks themselves can say how a line follows the one before: a line feed where it begins a paragraph, else a carriage return.
    """
    lined = lambda block: F.split(reduce(lambda c, end: F.replace(c, F.lit(end), F.lit("\n")), LINE_ENDS, block), "\n")
    lines = lambda block: F.filter(F.transform(lined(block), lambda x: _trim(x)), lambda x: x != "")
    placed = lambda line, at: F.concat(F.when((at == 0) | line.rlike(OWN_PARAGRAPH), "\n").otherwise("\r"), line)
    joined = F.array_join(F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), rf"\n{SPACE}*\n+"), lambda block: F.transform(lines(block), placed))), "")
    flowing = F.replace(F.replace(joined, F.lit("-\r"), F.lit("")), F.lit("\r"), F.lit(" "))
    return F.filter(F.transform(F.split(flowing, "\n"), lambda p: F.regexp_replace(p, SPACE + "{2,}", " ")), lambda p: p != "")


def normalize(text: Column, number: Column, title: Column) -> Column:
    """Flowing paragraphs, a blank line between them: glyphs, heading, lines and subscripts in turn. Null gives the empty text."""
    body = strip_heading(fix_colons(fix_glyphs(F.coalesce(text, F.lit("")))), number, title)
    return F.array_join(F.transform(paragraphs(body), restore_subscripts), "\n\n")


def depth_of(number: Column) -> Column:
    """0 for named parts, else the number of dots."""
    return F.when(F.lower(number).rlike(r"^\s*(chapter|part|appendix)"), 0).otherwise(F.size(F.split(number, r"\.")) - 1)


def chapter_of(number: Column) -> Column:
    n = strip(number)
    return F.when(n == "", F.lit(None)).when(F.lower(n).rlike("^(chapter|appendix|part) "), n).otherwise(F.element_at(F.split(n, r"\."), 1))


def slug(number: Column) -> Column:
    """Letters, digits and hyphens only."""
    return F.regexp_replace(F.regexp_replace(number, r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", "")


# Titles of front and back matter.
FRONT_MATTER = r"(?i)^(Preface|Foreword|Acknowledgments|Acknowledgements|Notation|Commentary\b.*|Index|References?|About\s+the\s+Authors?|Contributors?|Dedication|Copyright|Front\s+Matter|End\s+Matter)$"


def section_type(title: Column, depth: Column) -> Column:
    """From the outline's title."""
    t = F.lower(F.coalesce(title, F.lit("")))
    out = F.when(title.rlike(FRONT_MATTER), "front_matter")
    for word in ("table", "figure", "appendix"):
        out = out.when(t.startswith(f"{word} "), word)
    return out.when(t.contains("definitions"), "definition").when(depth == 0, "chapter").otherwise("section")


def content_type(text: Column) -> Column:
    """From the section's text."""
    t = F.lower(text)
    out = F.when(t.contains("table") & (F.length(text) < 2000), "table")
    for word in ("figure", "appendix"):
        out = out.when(t.contains(word), word)
    return out.when(t.contains("definitions") | t.contains("defined as"), "definition").otherwise("section")


def web_content_type(text: Column) -> Column:
    """From the text of a web page's section: a table of any length, and the bare word for a definition."""
    t = F.lower(text)
    out = F.when(t.contains("table"), "table")
    for word in ("figure", "appendix", "definition"):
        out = out.when(t.contains(word), word)
    return out.otherwise("section")


def section_path(chapter: Column, number: Column) -> Column:
    """The way down to a section: its chapter, 0 where it has none, and the parts of its number."""
    return F.concat_ws(".", F.coalesce(F.when(chapter != "", chapter), F.lit("0")), number)


# Fixed patterns: how a reader's view tells callouts, list items and formula lines.
CALLOUT, LIST_ITEM = r"(?i)^(EXCEPTION|EXCEPTIONS|User Note|Note|COMMENTARY)s?:\s*", r"(?i)^(\d+[a-z]?\.\s|\(\s*[a-z0-9ivx]+\s*\)|[•◦·●]\s)"


def line_class(paragraph: Column) -> Column:
    """callout, formula, list or plain: the first that fits a paragraph."""
    formula = paragraph.rlike(FORMULA_START) & paragraph.rlike(FORMULA_OPERATOR)
    return F.when(paragraph.rlike(CALLOUT), "callout").when(formula, "formula").when(paragraph.rlike(LIST_ITEM), "list").otherwise("plain")


# Markers of amending agencies, in the order in which they count.
AGENCIES = ("HCD", "SFM", "DSA", "OSHPD", "BSC-CG")


def amendment(text: Column) -> Column:
    """The first agency, in fixed order, whose marker the text holds."""
    return F.coalesce(*[F.when(text.contains(f"[{a}]"), a) for a in AGENCIES])


def size_label(n: Column) -> Column:
    """Bytes for people: one decimal below ten; a value halfway between two goes to the even one (format_string alone rounds it up)."""
    unit = F.least(F.lit(3), F.when(n > 0, F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0)) + 1e-12)).otherwise(0)).cast("int")
    v = n / F.pow(F.lit(1024.0), unit)
    return F.when((n == 0) | n.isNull(), "—").otherwise(F.concat(F.when(v >= 10, F.format_string("%.0f", F.bround(v, 0))).otherwise(F.format_string("%.1f", F.bround(v, 1))), F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1)))


def age_label(seconds: Column, day: Column) -> Column:
    """How long ago, or the day."""
    of = lambda k, u: F.concat(F.floor(seconds / k + 0.5).cast("string"), F.lit(u))
    return F.when(seconds.isNull(), "—").when(seconds < 60, of(1, "s ago")).when(seconds < 3600, of(60, "m ago")).when(seconds < 86400, of(3600, "h ago")).otherwise(day)


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def query_terms(q: Column) -> Column:
    """The distinct lower-case words of a query; what is no letter or digit parts them, so that none can break the query."""
    return F.array_distinct(F.filter(F.split(F.lower(q), r"[^\p{L}0-9]+"), lambda x: x != ""))
