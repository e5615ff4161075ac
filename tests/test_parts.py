import os

from pyspark.sql import functions as F

from skyweave.sources import parts


def _work(df):
    return df.groupBy(F.col("tile").cast("string").alias("part")).agg(F.sum("x").alias("s"))


def test_many_parts_lie_in_few_files(spark, tmp_path):
    """No folder or file for each part: their number grows with the table."""
    rows, folder = spark.range(3000).selectExpr("id", "id % 600 AS tile", "1e0 AS x"), str(tmp_path / "parts")
    found, n = parts.resume(rows, "tile", _work, folder)
    assert n == 600 and found.count() == 600 and {r.s for r in found.collect()} == {5.0}
    made = [f for _, folders, files in os.walk(folder) for f in folders + files]
    assert len(made) < 40
    more, n = parts.resume(rows.union(spark.range(1).selectExpr("id", "601L", "2e0")), "tile", _work, folder)
    assert n == 1 and more.count() == 601 and more.agg(F.sum("s")).first()[0] == 3002 and found.count() == 600


def test_results_before_and_after_a_change_in_one_query(spark, tmp_path):
    folder, rows = str(tmp_path / "parts"), spark.range(60).selectExpr("id", "id % 6 AS tile", "1e0 AS x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first, _ = parts.resume(rows, "tile", _work, folder)
        second, _ = parts.resume(rows.withColumn("x", F.when(F.col("id") == 7, 5e0).otherwise(F.col("x"))), "tile", _work, folder)
        other, _ = parts.resume(rows, "tile", _work, folder, {"radius": 8})
        sums = [df.agg(F.lit(k).alias("k"), F.count("*").alias("n"), F.sum("s").alias("s")) for k, df in enumerate((first, second, other))]
        assert sorted(map(tuple, sums[0].union(sums[1]).union(sums[2]).collect())) == [(0, 6, 60.0), (1, 6, 64.0), (2, 6, 60.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_rows_give_none(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 2.0)], "id long, tile long, x double")
    found, n = parts.resume(rows, "tile", _work, str(tmp_path / "parts"))
    assert n == 0 and found.count() == 0 and set(found.columns) == {"part", "digest", "s"}


def test_rows_of_a_run_that_broke_off_are_not_read(spark, tmp_path):
    rows, folder = spark.createDataFrame([(k, k % 3, 1.0) for k in range(9)], "id long, tile long, x double"), str(tmp_path / "parts")
    prints = parts.part_prints(rows, "tile")
    _work(rows).join(prints, "part").write.parquet(f"{folder}/rows/run=rbroken")  # no marker
    found, n = parts.resume(rows, "tile", _work, folder)
    assert n == 3 and sorted((r.part, r.s) for r in found.collect()) == [("0", 3.0), ("1", 3.0), ("2", 3.0)]
    twice = prints.withColumn("run", F.lit("rbroken"))  # two runs at once that both ended
    twice.write.mode("append").parquet(f"{folder}/done")
    found, n = parts.resume(rows, "tile", _work, folder)
    assert n == 0 and found.count() == 3
