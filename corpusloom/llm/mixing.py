"""Mixing sources to target weights by entropy balancing, in DataFrame and SQL functions alone.

Among all document rates r_i the mix takes those that hit each token target while staying as near as possible to r = 1 in token-weighted relative entropy, sum size_i (r_i ln r_i - r_i + 1). A constraint says how many tokens the documents of one value of a column give (a source, a language); constraints of several columns overlap. The solution is an exponential tilt, r_i = exp(sum of the lambdas of its values), and the lambdas minimise the convex dual D = sum_i size_i r_i - sum_k target_k lambda_k. ``balance`` takes Newton steps until the targets are met: each is one distributed pass over the cells (documents with the same values in all constrained columns have one rate, so partial sums make them one cell), which gives gradient target_k - sum size_i r_i and Hessian sum size_i r_i for the values of a column. Values of one column don't overlap, so its block of the Hessian is diagonal; the columns take turns. With sources alone, as here, that is Newton's method itself.

Rates become whole copies: every document gets floor(r) copies, and those first in the order of the MD5 of doc_id get one more until the rest of the target is met, to within half a document. So a source needs one number, the cut in that order, and every document compares itself with it: no text moves. The cut is found from narrow rows by levels: sums of 16^4 buckets of the order tell the bucket that holds it (``LEVELS`` more can divide it again), and only that bucket's rows, one in 65,536 of their source, are ordered themselves.

Only the table of sources (one row each) is ordered in one task; it is broadcast only while its size is small.

Defined results: a null text has size 0 and nothing taken; a null source is a source of its own, the last; a null doc_id counts as the text ``""``; rows that share a doc_id follow by size and hash of the text, and of repeated rows (those that share these too) as many are taken once more as the target asks for, by their order of reading; a source without words has target 0; an empty table gives an empty result; other columns are ignored or, in ``mix_documents``, kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, materialize, table, word_count
from corpusloom.operators.scan import running

WEIGHTS, SHARE, CAP, NEWTON_STEPS, TOLERANCE = (5, 2, 1), 1.5, 2, 64, 1e-12
#: Hexadecimal digits of the order that each level adds, and the number of levels; beyond, rows are ordered themselves.
DIGITS, LEVELS = 4, 1
#: Rows of a table of values or cuts that are broadcast; a larger one is joined by shuffle.
MOST_BROADCAST = 100_000


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``totals`` (source, source_size) with weight and target.

    Targets are c * weight, but at most ``cap`` times the source's size, where c spends ``share`` of all sizes. For each number k of sources that reach their cap first, c is at least what the budget left by them gives the others for each unit of weight; c is the greatest of these.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by_fill = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    return (
        totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank - 1, F.lit(len(weights))) + 1))
        .withColumn("_limit", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_level", level)
        .withColumn("target", F.least("_limit", F.max("_level").over(everything) * F.col("weight")))
        .drop("_limit", "_level")
    )


def _few(df: DataFrame) -> DataFrame:
    """A written table, with a broadcast hint if it is small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def balance(cells: DataFrame, targets: dict[str, DataFrame], steps: int = NEWTON_STEPS, tolerance: float = TOLERANCE) -> dict[str, DataFrame]:
    """The lambdas that meet all targets: for each constrained column a table (column, target, lambda), written. A value without cells is left out.

    ``cells``: the constrained columns (not null) and mass, their tokens; ``targets``: for each column a table (column, target). A value whose target or mass is 0 has a null lambda, and its documents the rate 0. Targets that can't be met together end after ``steps`` steps at the nearest tilt found.
    """
    state = {c: t.select(c, "target", F.when(F.col("target") > 0, F.lit(0.0)).alias("lambda")) for c, t in targets.items()}
    # steps of one column follow from one another in one plan; several columns would refer to each other ever more often
    stride = 4 if len(state) == 1 else 1
    for _ in range(0, steps, stride):
        for _ in range(stride):
            for c in state:
                state[c] = _newton_step(cells, state, c)
        state = {c: materialize(t) for c, t in state.items()}
        if max(t.agg(F.max("off")).first()[0] or 0.0 for t in state.values()) <= tolerance:
            break
    return {c: t.drop("off") for c, t in state.items()}


def _newton_step(cells: DataFrame, state: dict[str, DataFrame], c: str) -> DataFrame:
    """The values of ``c`` with a new lambda, and off: by how much of its target a value missed it before. A value without cells has none to be met."""
    tilt = cells
    for k, t in state.items():
        own = [F.col("target").alias("_target"), F.col("lambda").alias("_own")] if k == c else []
        tilt = tilt.join(t.select(k, F.col("lambda").alias(f"_{k}"), *own), k)
    rate = F.exp(reduce(lambda x, y: x + y, [F.col(f"_{k}") for k in state]))
    sums = tilt.groupBy(c, "_target", "_own").agg(F.sum(F.col("mass") * rate).alias("hessian"))
    gradient = F.col("_target") - F.col("hessian")
    step = F.least(gradient / F.col("hessian"), F.lit(1.0))  # far below its target, Newton's step would overshoot
    return sums.select(c, F.col("_target").alias("target"), F.when(F.col("hessian") > 0, F.col("_own") + step).alias("lambda"), F.abs(gradient / F.col("_target")).alias("off"))


def _keyed(sized: DataFrame) -> DataFrame:
    """``sized`` with _source, which is never null and sorts as the source, and _order, the place of a row in its source."""
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    return sized.withColumn("_source", key).withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))


def plan_sources(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(_source, source_size, target, rate, _whole, _cut, _some), one row for each source of ``sized`` (doc_id, source, size and, if there is one, tie), which is read several times: write it before. A row of a source is taken once more than ``_whole`` times if its (_order, size, tie) is not above ``_cut``; of the rows at the cut, where several are equal, only the first ``_some`` are, where that isn't null."""
    rows = _keyed(sized if "tie" in sized.columns else sized.withColumn("tie", F.lit(0).cast("long"))).select("_source", "_order", F.col("size").cast("long").alias("size"), F.col("tie").cast("long").alias("tie"))
    bucket = lambda level: F.substring("_order", 1, DIGITS * (level + 1)).alias("_bucket")
    sums = materialize(rows.groupBy("_source", bucket(0)).agg(F.sum("size").alias("_tokens")))
    name = F.when(F.col("_source") != "n", F.substring("_source", 2, 1 << 30))
    totals = sums.groupBy("_source").agg(F.sum("_tokens").alias("source_size")).withColumn("source", name)
    targets = materialize(source_targets(totals, weights, share, cap).drop("source", "weight"))
    few = F.broadcast if targets.count() <= MOST_BROADCAST else lambda df: df
    # the cells of the dual are the written sums of documents
    tilt = balance(sums.select("_source", F.col("_tokens").alias("mass")), {"_source": targets.select("_source", "target")})["_source"]
    rate = F.coalesce(F.exp("lambda"), F.lit(0.0))
    whole = F.least(F.floor(rate + 1e-9), F.lit(cap))
    plan = targets.join(tilt.drop("target"), "_source").select("_source", "source_size", "target", rate.alias("rate"), whole.alias("_whole"))
    # what is still needed, and the tokens before the place looked at
    cut = plan.withColumns({"_need": F.col("target") - F.col("_whole") * F.col("source_size"), "_before": F.lit(0).cast("long")})
    so_far = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(LEVELS):
        if level:
            inside = rows.join(few(cut.select("_source", "_found")), "_source").filter(F.col("_order").startswith(F.col("_found")))
            sums = inside.groupBy("_source", bucket(level)).agg(F.sum("size").alias("_tokens"))
        placed = sums.join(cut.select("_source", "_need", F.col("_before").alias("_base")), "_source").withColumn("_start", F.col("_base") + F.sum("_tokens").over(so_far) - F.col("_tokens"))
        last = placed.filter("_start < _need").groupBy("_source").agg(F.max(F.struct("_bucket", "_start")).alias("_l"))
        cut = materialize(cut.drop("_found").join(last, "_source", "left").select(*[c for c in cut.columns if c not in ("_found", "_before")], F.coalesce("_l._start", "_before").alias("_before"), F.coalesce("_l._bucket", F.lit("none")).alias("_found")))
    inside = rows.join(few(cut.select("_source", "_found")), "_source").filter(F.col("_order").startswith(F.col("_found")))
    equal = inside.groupBy("_source", F.struct("_order", "size", "tie").alias("_bucket")).agg(F.sum("size").alias("_tokens"), F.count(F.lit(1)).alias("_n"))
    size = F.col("_bucket.size")
    placed = equal.join(cut.select("_source", "_need", F.col("_before").alias("_base")), "_source").withColumn("_start", F.col("_base") + F.sum("_tokens").over(so_far) - F.col("_tokens"))
    # equal rows follow one another: so many of them have their middle before the need
    some = F.when(size > 0, F.ceil((F.col("_need") - F.col("_start")) / size + 0.5) - 1)
    last = placed.filter(F.col("_start") + size / 2 < F.col("_need")).groupBy("_source").agg(F.max(F.struct("_bucket", F.when(some < F.col("_n"), some).alias("_some"))).alias("_l"))
    # where none of the last bucket is taken: all that stands before it
    before = F.struct(F.col("_found").alias("_order"), F.lit(-1).cast("long").alias("size"), F.lit(0).cast("long").alias("tie"))
    found = F.when(F.col("_found") == "none", F.struct(F.lit("").alias("_order"), F.lit(-1).cast("long").alias("size"), F.lit(0).cast("long").alias("tie"))).otherwise(F.coalesce("_l._bucket", before))
    return materialize(cut.join(last, "_source", "left").select("_source", "source_size", "target", "rate", "_whole", found.alias("_cut"), F.when(F.col("_found") != "none", F.col("_l._some")).alias("_some")))


def with_copies(sized: DataFrame, plan: DataFrame, cap: int = CAP) -> DataFrame:
    """``sized`` (doc_id, source, size, tie and others) with source_size, target, rate and copies by ``plan``: a map over rows."""
    own = F.struct("_order", F.col("size").cast("long").alias("size"), F.col("tie").cast("long").alias("tie")) if "tie" in sized.columns else F.struct("_order", F.col("size").cast("long").alias("size"), F.lit(0).cast("long").alias("tie"))
    kept = [*sized.columns, "source_size", "target", "rate"]
    out = _keyed(sized).join(_few(plan), "_source").withColumn("_own", own)
    more = F.col("_own") <= F.col("_cut")
    if plan.filter("_some IS NOT NULL").limit(1).count():
        # equal rows at a cut, written and numbered along ranges: nothing else tells them apart
        among = F.col("_some").isNotNull() & (F.col("_own") == F.col("_cut"))
        few = materialize(out.filter(among).withColumn("_i", F.monotonically_increasing_id()))
        numbered = running(few, "_source", ["_i"], {"_nth": F.lit(1)}).withColumn("_more", F.col("_nth") <= F.col("_some"))
        out = out.filter(~among).withColumn("_more", more).select(*kept, "_whole", "_more").union(numbered.select(*kept, "_whole", "_more"))
        more = F.col("_more")
    return out.withColumn("copies", F.least(F.col("_whole") + more.cast("long"), F.lit(cap))).select(*kept, "copies")


def plan_mix(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``sized`` (doc_id, source, size, perhaps tie, and any columns but those below) with source_size, target, rate and copies."""
    return with_copies(sized, plan_sources(sized, weights, share, cap), cap)


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    """``docs`` with size and tie, the hash of the text."""
    return docs.select("doc_id", "source", *more, word_count().alias("size"), F.xxhash64("text").alias("tie"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``docs`` (doc_id, source, text and any others) with each row as often as the mix takes it."""
    plan = plan_sources(materialize(_sized(docs)), weights, share, cap)
    row = docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return with_copies(_sized(row, "_row"), plan, cap).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_row.*")


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 7 over all documents."""
    sized = materialize(_sized(table(spark, sf_dir, "documents")))
    return plan_mix(sized).select("doc_id", "source", "size", "source_size", "target", "rate", (F.col("copies") * F.col("size")).alias("taken"))


_TARGETS_SQL = f"""
sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM {{docs}}),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM totals),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighed),
targets AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * max(lvl) OVER ()) AS target FROM levels),
ordered AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size + 1e-9) END AS whole,
    sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, CAST(least(whole + CASE WHEN upto - size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END, 2) AS BIGINT) AS copies FROM ordered)"""

ORACLE_SQL = f"WITH {_TARGETS_SQL.format(docs='documents')} SELECT doc_id, source, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate, CAST(copies * size AS BIGINT) AS taken FROM mixed"
