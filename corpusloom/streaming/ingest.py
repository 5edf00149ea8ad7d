"""Incremental ingest with Structured Streaming: an extension beyond batch loads, with the same results.

Nothing else in this library needs a stream; what arrives in batches may arrive in a stream just as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.sources.files import tokens


def read_events(spark: SparkSession, path: str, schema: str, files: int = 16) -> DataFrame:
    """New Parquet files below ``path`` as a stream, so many for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def read_lines(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """(value): the lines of new text files below ``path`` as a stream; a file that is there already is read once, whatever is started again."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(path)


def answer_pieces(lines: DataFrame) -> DataFrame:
    """(answer, seq, piece, done) of a stream of line-wise JSON (value), such as ``{"answer": 7, "seq": 0, "response": "The", "done": false}``. A broken line, or one without an answer or a number, is no piece; one that only ends the answer is an empty piece."""
    read = F.from_json("value", "answer long, seq long, done boolean", {"mode": "PERMISSIVE"})
    return lines.select(read.alias("r"), tokens(F.col("value")).alias("piece")).filter("r.answer IS NOT NULL AND r.seq IS NOT NULL").select("r.answer", "r.seq", "piece", F.coalesce("r.done", F.lit(False)).alias("done"))


def answer_parts(pieces: DataFrame, each: int = 100) -> DataFrame:
    """(answer, part, text, done): the text of every ``each`` numbers of an answer, put together in order, so that no list grows with the answer. Lines that came twice count once."""
    one = pieces.groupBy("answer", "seq").agg(F.max(F.struct("done", "piece")).alias("p"))
    parts = one.groupBy("answer", F.floor(F.col("seq") / each).alias("part")).agg(F.array_sort(F.collect_list(F.struct("seq", "p.piece"))).alias("x"), F.max("p.done").alias("done"))
    return parts.select("answer", "part", F.array_join(F.transform("x", lambda p: p.piece), "").alias("text"), "done")


def first_seen(stream: DataFrame, hash_: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose hash was not seen within ``late`` before: state is dropped behind the watermark, so it stays bounded."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([hash_])


def progress(stream: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, kind, n, value) of each window, once its time has passed."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), kind, "n", "value")


def run_once(out: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Takes all that is there now, and ends: exactly once into Parquet, by the checkpoint."""
    q = out.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    q.awaitTermination()
    return q
