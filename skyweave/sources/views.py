"""Catalogue views over the test tables: positions from integer keys, by the same text in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ra(k: str) -> str:
    return f"(({k} % 997) * 0.36e0)"


def dec(k: str, m: int | None = None) -> str:
    base = f"((({k} * 7) % 601) / 10e0 - 20e0)"
    return base if m is None else f"({base} + ((({k} * {m}) % 20) * 0.5e0 + 0.25e0) / 3600e0)"


#: name: (table, columns); catalogues differ in the step by which a row is displaced.
VIEWS = {
    "det": ("events", f"event_id AS id, user_id AS tile_id, {ra('event_id')} AS ra, {dec('event_id')} AS dec, value AS fwhm, event_id % 4 AS flags, (event_id * 31) % 100 AS snr, 1e0 + (event_id % 50) / 100e0 AS elong, ((event_id * 17) % 23) / 1000e0 - 0.005e0 AS spread, (event_id % 7) * 1e0 AS dx, ((event_id * 3) % 5) * 1e0 AS dy, CAST(user_id AS STRING) || ':' || CAST(event_id AS STRING) AS src_id, ts"),
    "cat_a": ("part", f"p_partkey AS id, {ra('p_partkey')} AS ra, {dec('p_partkey', 13)} AS dec, CASE WHEN p_partkey % 37 = 0 THEN -999e0 ELSE p_size * 1e0 END AS mag, p_size AS n_detections"),
    "cat_b": ("customer", f"c_custkey AS id, {ra('c_custkey')} AS ra, {dec('c_custkey', 17)} AS dec, CASE WHEN c_custkey % 10 <> 0 THEN (c_custkey % 401) - 200e0 END AS pmra, CASE WHEN c_custkey % 10 <> 0 THEN ((c_custkey * 3) % 401) - 200e0 END AS pmdec, c_nationkey AS band"),
    "cat_c": ("supplier", f"s_suppkey AS id, {ra('s_suppkey')} AS ra, {dec('s_suppkey', 11)} AS dec, 10e0 + s_suppkey % 8 AS rmag"),
    "ref": ("orders", f"o_orderkey AS id, {ra('o_orderkey')} AS ra, {dec('o_orderkey', 19)} AS dec, o_orderstatus AS status"),
    "plates": ("nation", "n_nationkey AS id, n_nationkey * 14.4e0 AS ra, ((n_nationkey * 11) % 60) - 20e0 AS dec"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(f"SELECT {columns} FROM {{source}}", source=df)


def cte(*names: str) -> str:
    """The same views as WITH clauses for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {VIEWS[n][1].replace('AS STRING', 'AS VARCHAR')} FROM {VIEWS[n][0]})" for n in names)
