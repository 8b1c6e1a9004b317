"""Compositions of steps from a table to a table (GRF08). Steps are lazy plans; only iteration writes what it goes on from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import stored

Step = Callable[[DataFrame], DataFrame]


def sequential(df: DataFrame, *steps: Step) -> DataFrame:
    """Each step takes what the one before gives."""
    for step in steps:
        df = step(df)
    return df


def parallel(df: DataFrame, **steps: Step) -> DataFrame:
    """All steps take the same table; their rows come out together, with branch, the step's name."""
    parts = [step(df).withColumn("branch", F.lit(name)) for name, step in steps.items()]
    return sequential(parts[0], *(lambda out, p=p: out.unionByName(p) for p in parts[1:]))


def conditional(df: DataFrame, test: Column, then: Step, otherwise: Step) -> DataFrame:
    """Rows for which the test holds take one step, all others (null too) the other."""
    holds = F.coalesce(test, F.lit(False))
    return then(df.where(holds)).unionByName(otherwise(df.where(~holds)))


def iterative(df: DataFrame, step: Step, open_: Column, most: int = 100) -> tuple[DataFrame, int]:
    """The step again and again while some row is open, `most` times at most; the table and how often. Rounds are stored, so plans don't grow."""
    df = stored(df, "round")
    for n in range(most):
        if df.where(open_).limit(1).count() == 0:
            return df, n
        df = stored(step(df), "round")
    return df, most
