import base64

import __spark_entry__ as entry


def test_all_part_files(spark, tmp_path):
    spark.range(40).selectExpr("cast(id as int) r_regionkey", "'x' r_name").repartition(4).write.parquet(str(tmp_path / "region.parquet"))
    spark.range(6).selectExpr("cast(id as int) n_nationkey", "'x' n_name").repartition(2).write.parquet(str(tmp_path / "nation.parquet"))
    names = {p.name for p in tmp_path.glob("*.parquet/*.parquet")}
    assert len(names) == 6
    assert {r.filename for r in entry.queries()["stored_files"](spark, str(tmp_path)).collect()} == names


def test_one_file_alone(spark, tmp_path):
    for name in ("region", "nation"):
        spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    row = entry.queries()["file_fetched"](spark, str(tmp_path)).first()
    parts = {p.name: p.read_bytes() for p in tmp_path.glob("*/*.parquet")}
    assert row.filename == min(parts) and base64.b64decode(row.content) == parts[row.filename] and row.size_bytes == len(parts[row.filename])
