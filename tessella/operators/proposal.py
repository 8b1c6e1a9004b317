"""Proposal arithmetic and coverage (AGG18-AGG27, JON16-JON18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(stated: DataFrame, parts: DataFrame, key: str, total: str, part: str, tolerance: float = 0.0) -> DataFrame:
    """AGG18: key, stated, summed, ok: totals against the sums of their parts; the parts are summed before the join."""
    sums = parts.groupBy(key).agg(F.sum(part).alias("summed"))
    rows = stated.select(key, F.col(total).alias("stated")).join(sums, key, "full")
    return rows.withColumn("ok", F.coalesce(F.abs(F.col("stated") - F.col("summed")) <= tolerance, F.lit(False)))


def three_totals(investment: DataFrame, roles: DataFrame, phases: DataFrame) -> DataFrame:
    """AGG18: one row: investment, sums of roles and phases, ok."""
    one = lambda d, n: d.agg(F.coalesce(F.sum("md"), F.lit(0)).alias(n))
    rows = one(investment, "investment").join(one(roles, "roles")).join(one(phases, "phases"))
    return rows.withColumn("ok", (F.col("investment") == F.col("roles")) & (F.col("roles") == F.col("phases")))


def coverage(requirements: DataFrame, codes: tuple[str, ...] = ("C", "PC", "NC+A")) -> DataFrame:
    """AGG19: area, a count per code, total."""
    g = requirements.groupBy("area").agg(*[F.count_if(F.col("code") == c).alias(c) for c in codes])
    return g.withColumn("total", sum((F.col(f"`{c}`") for c in codes), F.lit(0)))


def with_total(rows: DataFrame, by: str, *counts: Column) -> DataFrame:
    """AGG20: counts by group and a Total row."""
    return rows.rollup(by).agg(*counts, F.grouping(by).alias("g")).withColumn(by, F.when(F.col("g") == 1, "Total").otherwise(F.col(by))).drop("g")


def over_allocated(plan: DataFrame, most: float = 1.0) -> DataFrame:
    """AGG21: role, week, load above the limit."""
    return plan.groupBy("role", "week").agg(F.sum("allocation").alias("load")).where(F.col("load") > most)


def tally(rows: DataFrame, column: str, values: tuple[str, ...], *by: str) -> DataFrame:
    """AGG22-AGG24: a count per value."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def without_match(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """JON16-JON18: rows that the other side lacks."""
    return rows.join(others.select(key), key, "left_anti")


def leaked(out_of_scope: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """JON16: rows that are out of scope and yet planned."""
    return out_of_scope.join(plan.select(key), key, "left_semi")


def consensus(sources: DataFrame) -> DataFrame:
    """AGG26: claim, n_sources, n_values, contradiction, and a count per tier."""
    tiers = [F.count_if(F.col("tier") == t).alias(t) for t in ("T1", "T2", "T3", "T4")]
    g = sources.groupBy("claim").agg(F.count("*").alias("n_sources"), F.count_distinct("value").alias("n_values"), *tiers)
    return g.withColumn("contradiction", F.col("n_values") > 1)


def question_rules(questions: DataFrame, least: int = 15, most: int = 25) -> DataFrame:
    """AGG27: survey, n, duplicates, ok."""
    q = F.lower(F.trim("question"))
    g = questions.groupBy("survey").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(q)).alias("duplicates"))
    return g.withColumn("ok", F.col("n").between(least, most) & (F.col("duplicates") == 0))


def merged_concerns(*reports: DataFrame, by: str = "concern") -> DataFrame:
    """SET07: the concerns of several reports, each once."""
    out = reports[0].select(by)
    for more in reports[1:]:
        out = out.unionByName(more.select(by))
    return out.distinct()
