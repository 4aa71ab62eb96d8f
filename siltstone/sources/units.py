"""Extracted units: identifiers, counts, assembly and the quality of a parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_id(ref: Column, kind: Column, index: Column, text: Column) -> Column:
    """Identifier of a unit, over its reference, type, index and first 160 characters."""
    parts = F.concat(ref, F.lit("\0"), kind, F.lit("\0"), index.cast("string"), F.lit("\0"), F.substring(text, 1, 160))
    return F.concat(F.lit("unit:"), kind, F.lit(":"), F.substring(F.sha1(parts), 1, 12))


def unit_counts(units: DataFrame) -> DataFrame:
    return units.groupBy("source_ref", "unit_type").agg(F.count("*").alias("n"))


def assembled_text(units: DataFrame) -> DataFrame:
    """The units' texts of each source in order, separated by blank lines."""
    found = F.array_sort(F.collect_list(F.struct("unit_index", "text")))
    return units.groupBy("source_ref").agg(F.array_join(F.transform(found, lambda u: u["text"]), "\n\n").alias("text"))


def parse_quality(chars: Column, units: Column, structured: Column, empty: Column, warnings: Column, media: Column, transcript: Column) -> Column:
    """Quality of a parse between 0 and 1, 0 without text."""
    base = (
        F.lit(0.35)
        + F.least(F.lit(0.35), chars / 6000.0)
        + F.least(F.lit(0.12), units / 80.0)
        + F.least(F.lit(0.12), structured / 40.0)
        - F.least(F.lit(0.2), empty / F.greatest(units, F.lit(1)) * 0.2)
    )
    heard = base + F.least(F.lit(0.1), transcript / 50.0)
    scored = F.when(~media, base).when(transcript > 0, heard).otherwise(F.least(base, F.lit(0.35)))
    return F.when(chars == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), scored - F.least(F.lit(0.25), warnings * 0.05)))
    )
