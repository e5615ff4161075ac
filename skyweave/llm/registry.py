"""Queries of this subpackage, with production parameters over whole tables, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licenses, merkle, spelling
from .common import table
from .embedding_dedup import embedding_links
from .fit_packing import fit_pack
from .html_text import extract
from .jaccard_join import jaccard_components
from .neighbours import nearest
from .packing import pack
from .quality_cnn import quality_scores
from .sentencepiece_codec import digest
from .suffix_dedup import suffix_dedup
from .toxicity_cnn import toxicity_scores


def _over(name: str, operator, *more: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*(table(spark, sf_dir, t) for t in (name, *more)))

    return query


QUERIES = {
    "op1_suffix_dedup": _over("documents", suffix_dedup),
    "op2_sentencepiece": _over("documents", digest),
    "op3_html_text": _over("pages", extract),
    "op4_quality_cnn": _over("documents", quality_scores, "labels"),
    "op5_embedding_dedup": _over("embeddings", embedding_links),
    "op6_licenses": _over("documents", licenses.license_scan),
    "op7_neighbours": _over("embeddings", nearest),
    "op8_packing": _over("documents", pack),
    "op9_toxicity_cnn": _over("documents", toxicity_scores, "labels"),
    "op10_jaccard_join": _over("documents", jaccard_components),
    "op11_fit_packing": _over("documents", fit_pack),
    "op12_merkle_manifest": _over("documents", merkle.manifest),
    "op13_spelling_variants": _over("documents", spelling.variants),
}

ORACLES = {
    "op6_licenses": licenses.oracle_sql(),
    "op12_merkle_manifest": merkle.oracle_sql(),
    "op13_spelling_variants": spelling.oracle_sql(),
}
