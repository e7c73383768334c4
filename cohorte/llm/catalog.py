"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorte.llm.common import table
from cohorte.llm import decontaminate, host_rules, mixing, near_dups, neighbours
from cohorte.llm import prefix_trie as trie
from cohorte.llm.decontaminate import contamination
from cohorte.llm.host_rules import host_quality
from cohorte.llm.html_text import extract
from cohorte.llm.licences import licences
from cohorte.llm.near_dups import near_duplicates
from cohorte.llm.neighbours import nearest
from cohorte.llm.personal_data import personal_data
from cohorte.llm.prefix_trie import prefix_trie
from cohorte.llm.quality import quality
from cohorte.llm.secret_scan import secrets
from cohorte.llm.toxicity import toxicity
from cohorte.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    spans = F.transform("passages", lambda p: F.concat_ws(":", p["start"], p["end"]))
    return scored.select("doc_id", "held_out", "score", "predicted", F.array_join(spans, ",").alias("passages"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents")).drop("detections")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_html_text, op2_near_duplicates, op3_personal_data, op4_toxicity, op5_mixing, op6_quality, op7_licences, op8_secrets, op9_nearest_neighbours, op10_decontamination, op11_prefix_trie, op12_host_rules, op13_whitening)}

#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {
    "op2_near_duplicates": near_dups.SQL,
    "op5_mixing": mixing.SQL,
    "op9_nearest_neighbours": neighbours.SQL,
    "op10_decontamination": decontaminate.SQL,
    "op11_prefix_trie": trie.SQL,
    "op12_host_rules": host_rules.SQL,
}
