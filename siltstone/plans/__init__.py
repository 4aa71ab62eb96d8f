"""Queries over the supplied tables, with the SQL that they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import evidence_queries, graph_queries, intake_queries, more_queries, record_queries, retrieval_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL


def all_queries():
    return QUERIES


def all_sql():
    return SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["J06_context_priority"](spark, sf_dir)
