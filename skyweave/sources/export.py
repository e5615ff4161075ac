"""Catalogue export as CSV, Parquet or both (A20), and summaries as JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

KINDS = ("none", "csv", "parquet", "both")


def export(df: DataFrame, folder: str, kind: str = "csv") -> list[str]:
    """Write df below folder and return the paths; CSV leaves out columns that are not scalars."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    paths = []
    if kind in ("csv", "both"):
        flat = [f.name for f in df.schema if not isinstance(f.dataType, ArrayType | MapType | StructType)]
        paths.append(f"{folder}/catalogue.csv")
        df.select(flat).write.mode("overwrite").option("header", True).csv(paths[-1])
    if kind in ("parquet", "both"):
        paths.append(f"{folder}/catalogue.parquet")
        df.write.mode("overwrite").parquet(paths[-1])
    return paths


def merged_facts(facts: DataFrame, extra: DataFrame) -> DataFrame:
    """Name, value (text) of a summary to which keys are added later; a later value replaces an earlier one."""
    both = facts.select("name", "value", F.lit(0).alias("_turn")).union(extra.select("name", "value", F.lit(1)))
    return both.groupBy("name").agg(F.max_by("value", F.struct("_turn", "value")).alias("value"))


def summary_texts(facts: DataFrame) -> DataFrame:
    """One row: a summary (a few names and values) as a JSON object and as a Markdown table, in order of names."""
    pair = F.to_json(F.create_map("name", "value"))
    rows = facts.agg(F.sort_array(F.collect_list(F.struct("name", "value", pair.alias("j")))).alias("r"))
    inner = F.transform("r", lambda x: F.substring(x["j"], F.lit(2), F.length(x["j"]) - 2))
    lines = F.transform("r", lambda x: F.concat(F.lit("| "), x["name"], F.lit(" | "), x["value"], F.lit(" |")))
    return rows.select(F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}")).alias("json"), F.concat(F.lit("| name | value |\n|---|---|\n"), F.array_join(lines, "\n")).alias("markdown"))


def write_summary(facts: DataFrame, folder: str) -> None:
    """Summary.json and summary.md below folder, each a text table of one file."""
    texts = summary_texts(facts)
    for name in ("json", "markdown"):
        texts.select(name).coalesce(1).write.mode("overwrite").text(f"{folder}/summary.{'md' if name == 'markdown' else name}")
