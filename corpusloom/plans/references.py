"""References, out of citation texts made from part and supplier, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.functions import citations
from corpusloom.operators.tables import small, spread
from corpusloom.steps import written

_TEXT = """concat('Walls shall comply with Section ', 100 + p_partkey % 900, '.', p_size, ' and work in accordance with § ', 1000 + p_partkey, '.1; comply with the provisions of Section ', 700 + p_size, '. See Section ', 200 + p_size, '.2, refer to Section 26.5, see Table ',
 p_size, '.', p_partkey % 7, ' and as shown in Figure ', p_partkey % 12, ' per ASTM E', 100 + p_size, '-18 and nfpa ', p_size, '. Title 24, Part ', p_partkey % 9, ', Section ', 300 + p_size, '.4 and Part 3. Exception 1: ', p_name, ' is exempt.')"""


def citation_texts(t):
    return spread(t("part").select("p_partkey", "p_size", "p_name"), "p_partkey").selectExpr("p_partkey AS id", f"{_TEXT} AS text")


def extracted(t):
    return citation_texts(t).select("id", F.posexplode(citations.extract(F.col("text"))).alias("at", "r")).select("id", "r.kind", "r.target", "r.standard", "r.text")


_N = r"(?:Section|§)\s+(\d{3,4}(?:\.\d+)*)"
_ONE = "SELECT id, '{kind}' AS kind, {target} AS target, {standard} AS standard, {text} AS text FROM (SELECT id, unnest(regexp_extract_all(text, '(?i){p}', 0)) AS w, unnest(regexp_extract_all(text, '(?i){p}', 1)) AS g FROM c)"


def _one(kind, p, target="NULL::VARCHAR", standard="NULL::VARCHAR", text="w"):
    return _ONE.format(kind=kind, p=p, target=target, standard=standard, text=text)


_SQL = f"WITH c AS (SELECT p_partkey AS id, {_TEXT} AS text FROM part), r AS (" + " UNION ALL ".join(
    [_one("mandatory", p, "g") for p in citations.MANDATORY]
    + [_one("informational", p, "g") for p in citations.INFORMATIONAL]
    + [
        _one("exception", r"Exception(?:\s+\d+)?:\s*(.+)$", text="'Exception: ' || substring(g, 1, 100)"),
        _one("table", citations.TABLE, text="'Table ' || g"),
        _one("figure", citations.FIGURE, text="'Figure ' || g"),
        _one("external_standard", citations.STANDARD, standard="upper(g)", text="upper(g)"),
        f"SELECT id, 'cross_part', s, NULL, 'Part ' || g || ', Section ' || s FROM (SELECT id, unnest(regexp_extract_all(text, '(?i){citations.PART}', 1)) AS g, unnest(regexp_extract_all(text, '(?i){citations.PART}', 2)) AS s FROM c) WHERE s <> ''",
    ]
) + ")"


@query("R1 R2 R3 R4 R5 R6 R7", _SQL + " SELECT * FROM r")
def extract_references(t):
    return extracted(t)


@query("R1 R2 A2", _SQL + " SELECT kind, count(*) AS n, count(DISTINCT id) AS sections FROM r GROUP BY kind")
def reference_kinds(t):
    """How many references of each kind, and from how many sections: counted twice over, first by section, so that no distinct count gathers a kind."""
    return extracted(t).groupBy("kind", "id").agg(F.count("*").alias("n")).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("sections"))


@query("R8", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '706.' || p_size WHEN p_partkey % 3 = 1 THEN '706.' || k ELSE '706 through 706.' || p_size END AS number
 FROM part, LATERAL (SELECT unnest(CASE WHEN p_partkey % 3 = 1 THEN range(p_size, p_size + 4) ELSE [0] END) AS k)""")
def range_expand(t):
    k, size = F.col("p_partkey") % 3, F.col("p_size")
    text = F.when(k == 0, F.concat(F.lit("706."), size)).when(k == 1, F.concat(F.lit("706."), size, F.lit(" Through 706."), size + 3)).otherwise(F.concat(F.lit("706 through 706."), size))
    return t("part").select(F.col("p_partkey").alias("id"), F.explode(citations.expand_range(text)).alias("number"))


@query("J13 F27", """WITH idx AS (SELECT DISTINCT 'Chapter ' || p_size AS key FROM part UNION SELECT DISTINCT 'Table ' || p_size || '.' || p_partkey % 7 FROM part WHERE p_size % 2 = 0),
 c AS (SELECT p_partkey AS id, 'See Table ' || p_size || '.' || p_partkey % 7 || ' in Chapter ' || p_size || '.' AS text FROM part),
 l AS (SELECT id, unnest(regexp_extract_all(text, '(?:Table|Chapter) ([0-9]+(?:\\.[0-9]+)?)', 0)) AS whole, unnest(regexp_extract_all(text, '(?:Table|Chapter) ([0-9]+(?:\\.[0-9]+)?)', 1)) AS number FROM c)
 SELECT id, whole, (SELECT min(key) FROM idx WHERE key IN ('Chapter ' || number, 'Table ' || number)) AS hit FROM l""")
def link_references(t):
    """The first of the candidate keys that the outline has."""
    part = t("part")
    index = part.select(F.concat(F.lit("Chapter "), "p_size").alias("key")).union(part.filter("p_size % 2 = 0").selectExpr("concat('Table ', p_size, '.', p_partkey % 7)")).distinct()
    text = F.expr("concat('See Table ', p_size, '.', p_partkey % 7, ' in Chapter ', p_size, '.')")
    found = part.select(F.col("p_partkey").alias("id"), F.posexplode(citations.links(text)).alias("at", "l"))
    # each different number is resolved once; a number of any frequency is no group of its links
    numbers = found.select(F.col("l.number").alias("number")).distinct()
    tried = numbers.select("number", F.posexplode(citations.link_keys(F.col("number"))).alias("rank", "key")).join(index, "key")
    resolved = small(written(tried.groupBy("number").agg(F.min(F.struct("rank", "key"))["key"].alias("hit"))))
    return found.select("id", "l.whole", "l.number").join(resolved, "number", "left").select("id", "whole", "hit")
