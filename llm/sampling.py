"""Bounded training samples, drawn by a hash so that every run draws the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored

_SCALE = 2**31


def stratified(rows: DataFrame, stratum: str, per_value: int, key: str) -> DataFrame:
    """About ``per_value`` rows of each value of ``stratum`` (all, where there are fewer); null is no value.

    Two passes: counts by value, then a filter by the key's hash.  Nothing is
    sorted or gathered by the stratum, however unevenly its values occur, and
    there may be any number of them.
    """
    known = rows.where(F.col(stratum).isNotNull())
    counts = stored(known.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n")), "strata")
    shares = counts.withColumn("__share", F.floor(F.lit(float(_SCALE)) * F.least(F.lit(1.0), F.lit(float(per_value)) / F.col("__n"))))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(_SCALE))
    return spread_join(known.withColumn("__draw", draw), shares, stratum, "__n").where("__draw < __share").select(*rows.columns)
