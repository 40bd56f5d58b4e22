"""Bitmasks and their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
QUALITY = {"MISSING_SENSOR": 1, "INVALID_TIMESTAMP": 2, "DUPLICATE_TIMESTAMP": 4, "NON_MONOTONIC_TIMESTAMP": 8, "ENCODING_WARNING": 16, "SCHEMA_REPAIR": 32, "GNSS_STALE": 64, "SYNC_UNRESOLVED": 128, "REFERENCE_LOW_CONFIDENCE": 256, "SEGMENT_BOUNDARY": 512}
NAVIGATION = {"ALIGNMENT_LOW_CONFIDENCE": 1, "ALIGNMENT_UNAVAILABLE": 2, "IRREGULAR_DT": 4, "DUPLICATE_TIMESTAMP": 8, "LARGE_TIME_GAP": 16, "INVALID_SENSOR": 32, "STATIONARY": 64}
MAGNETOMETER = {"MAGNITUDE_OUT_OF_RANGE": 1, "ABRUPT_DIRECTION_CHANGE": 2, "UNSTABLE_MAGNITUDE": 4, "DIP_INCONSISTENT": 8, "UNUSABLE": 16}
UNTRUSTWORTHY = 2 | 8 | 16 | 32


def names(mask: Column, flags: dict[str, int] = QUALITY, none: str = "VALID") -> Column:
    """Array of the names of the bits that are set, in bit order; [none] for 0."""
    found = F.filter(F.array(*[F.when(mask.bitwiseAND(bit) != 0, F.lit(name)) for name, bit in flags.items()]), lambda x: x.isNotNull())
    return F.when(mask == 0, F.array(F.lit(none))).otherwise(found)


def has(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(bit) != 0


def set_if(mask: Column, condition: Column, bit: int) -> Column:
    return mask.bitwiseOR(F.when(condition, bit).otherwise(0))  # names the mask once, so chains stay short


def counts(df, mask: str, flags: dict[str, int], by: list[str] | None = None):
    """(flag, n) of the bits that are set in any row; one aggregation, then one row for each flag."""
    sums = df.groupBy(*(by or [])).agg(*[F.count_if(has(F.col(mask), bit)).alias(name) for name, bit in flags.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("n")) for n in flags])).alias("p")
    return sums.select(*(by or []), pairs).select(*(by or []), "p.flag", "p.n").where("n > 0")
