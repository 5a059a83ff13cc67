"""Logical table schemas and the guards applied where tables enter the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAJECTORY_ERRORS = T.StructType([
    T.StructField("match_id", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("log_file", T.StringType()),
    T.StructField("proc_set_file", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("horizon", T.StringType()),
    T.StructField("traj_id", T.LongType()),
    T.StructField("ade_traj", T.DoubleType()),
    T.StructField("fde_traj", T.DoubleType()),
    T.StructField("n_steps_pred", T.IntegerType()),
])

GAME_METRICS = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("log_file", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("teams", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("horizon", T.StringType()),
    T.StructField("value", T.StringType()),
])

DIVISION_MAP = T.StructType([
    T.StructField("proc_set_file", T.StringType()),
    T.StructField("division", T.StringType()),
])

TRACK_FRAMES = T.StructType([
    T.StructField("game", T.StringType()),
    T.StructField("stop_id", T.LongType()),
    T.StructField("team", T.StringType()),
    T.StructField("robot_id", T.LongType()),
    T.StructField("idx", T.LongType()),
    T.StructField("t", T.DoubleType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("psi", T.DoubleType()),
    T.StructField("mask", T.BooleanType()),
])


class SchemaMismatch(ValueError):
    """A table lacks a column, or has it with another type."""


class KeyNotUnique(ValueError):
    """A join declared one-to-one met a repeated key."""


def validate_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Return the expected columns in order, or say which one does not fit."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    for field in expected.fields:
        if field.name not in actual:
            raise SchemaMismatch(f"column {field.name} is missing")
        if actual[field.name] != field.dataType:
            raise SchemaMismatch(
                f"column {field.name} is {actual[field.name].simpleString()}, "
                f"expected {field.dataType.simpleString()}")
    return df.select(*[f.name for f in expected.fields])


def finite(col: Column | str) -> Column:
    """True for values that are neither NULL, NaN nor infinite."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).count().where("count > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fail when a key repeats; the test stops at the first one found."""
    bad = repeated_keys(df, keys).limit(1).collect()
    if bad:
        raise KeyNotUnique(f"key {keys} repeats: {bad[0].asDict()}")
    return df
