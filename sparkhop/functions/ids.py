"""Column functions of projections: ids, weights, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ID = (1 << 32) - 1


def digits_of(key: Column) -> Column:
    """All digits of a string key, as an id; no digits at all is a cast error."""
    return F.regexp_replace(key.cast("string"), "[^0-9]", "").cast("bigint")


def checked_id(value: Column) -> Column:
    """A node id: a bigint between 0 and 2**32 - 1; others raise CSR-E002."""
    v = value.cast("bigint")
    bad = F.raise_error(F.concat(F.lit("CSR-E002: Invalid edge: node id out of range: "), v.cast("string"))).cast("bigint")
    return F.when((v < 0) | (v > MAX_ID), bad).otherwise(v)


def weight_of(value: Column) -> Column:
    """A float weight; null counts as 1."""
    return F.coalesce(value.cast("float"), F.lit(1.0).cast("float"))


def valid_at(valid_from: Column, valid_to: Column | None, at: str) -> Column:
    """Half-open validity: from <= at < to; an open end never expires."""
    holds = valid_from <= F.lit(at)
    return holds if valid_to is None else holds & (valid_to.isNull() | (valid_to > F.lit(at)))
