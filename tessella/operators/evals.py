"""Evaluation analytics: statistics per configuration and trigger scoring (W2, W3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import values as V

METRICS = ("pass_rate", "time_seconds", "tokens")


def stats(c: Column, digits: int = 4) -> list[Column]:
    """AGG01: mean, sample deviation (0 for one value), least and most, rounded; 0 for none."""
    spread = F.when(F.count(c) < 2, 0.0).otherwise(F.stddev_samp(c))
    return [F.coalesce(F.round(x, digits), F.lit(0.0)).alias(n) for x, n in ((F.avg(c), "mean"), (spread, "stddev"), (F.min(c), "min"), (F.max(c), "max"))]


def summary(runs: DataFrame, metrics: tuple[str, ...] = METRICS, by: str = "configuration") -> DataFrame:
    """AGG02: configuration, metric, mean, stddev, min, max, n; ungraded runs (null) don't count."""
    long_ = runs.unpivot([by], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    return long_.groupBy(by, "metric").agg(*stats(F.col("value")), F.count("value").alias("n"))


def delta(summaries: DataFrame, treatment: str | None = None, baseline: str | None = None, by: str = "configuration") -> DataFrame:
    """AGG03: metric, delta = mean of treatment - mean of baseline; without names the first two configurations by name."""
    if treatment is None or baseline is None:
        names = summaries.select(by).distinct().withColumn("place", F.row_number().over(Window.orderBy(by))).where("place <= 2")
        rows = summaries.join(F.broadcast(names), by)
    else:
        rows = summaries.where(F.col(by).isin(treatment, baseline)).withColumn("place", F.when(F.col(by) == treatment, 1).otherwise(2))
    first, second = (F.coalesce(F.max(F.when(F.col("place") == i, F.col("mean"))), F.lit(0.0)) for i in (1, 2))
    return rows.groupBy("metric").agg((first - second).alias("delta"))


def load_runs(gradings: DataFrame, timings: DataFrame, compat: bool = False) -> DataFrame:
    """JON06: gradings with times and tokens. A timing row counts where the grading has no time.

    compat: tokens come from timing only in that case too, and output characters stand in where they are missing.
    """
    g = gradings.join(timings.select("run", F.col("total_duration_seconds").alias("t_time"), F.col("total_tokens").alias("t_tokens")), "run", "left")
    untimed = F.coalesce("time_seconds", F.lit(0.0)) == 0
    time = F.when(untimed, F.coalesce("t_time", F.lit(0.0))).otherwise(F.col("time_seconds"))
    if compat:
        tokens = F.coalesce(F.nullif(F.when(untimed, F.coalesce("t_tokens", F.lit(0))), F.lit(0)), "output_chars", F.lit(0))
    else:
        tokens = F.col("t_tokens")
    return g.withColumns({"time_seconds": time, "tokens": tokens.cast("long")}).drop("t_time", "t_tokens")


def placed(rows: DataFrame, column: str, bins: int = 64, sample: int = 10_000) -> DataFrame:
    """Adds place, from 0, by a column of distinct values: ranges sort on their own, and move on by the sizes of those before.

    The cuts come from `sample` values of least hash; they only balance the ranges, the places are exact.
    """
    cuts = rows.select(F.col(column).alias("v")).orderBy(F.xxhash64("v")).limit(sample).agg(F.array_sort(F.collect_list("v")).alias("v"))
    cuts = cuts.select(F.filter("v", lambda x, i: i % max(1, sample // bins) == 0).alias("cuts"))
    ranged = rows.join(F.broadcast(cuts), how="cross").withColumn("range", F.size(F.filter("cuts", lambda x: x <= F.col(column)))).drop("cuts")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row per range
    place = F.row_number().over(Window.partitionBy("range").orderBy(column)) - 1
    return ranged.withColumn("place", place).join(F.broadcast(before), "range").select(*rows.columns, (F.col("place") + F.col("before")).cast("long").alias("place"))


def eval_ids(rows: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """JON07, WIN04: eval_id of each directory: from its metadata, else the number in its name, else its place by name."""
    d = placed(rows.select("eval_dir").distinct(), "eval_dir")
    if meta is not None:
        d = d.join(meta.select("eval_dir", F.col("eval_id").alias("stated")), "eval_dir", "left")
    else:
        d = d.withColumn("stated", F.lit(None).cast("long"))
    number = F.regexp_extract("eval_dir", r"-(\d+)$", 1)
    return d.select("eval_dir", F.coalesce("stated", F.when(number != "", number.cast("long")), "place").cast("long").alias("eval_id"))


def bad_expectations(c: Column) -> Column:
    """PRJ23: whether an expectation lacks text or verdict."""
    return F.exists(c, lambda x: x["text"].isNull() | x["passed"].isNull())


def tool_histogram(runs: DataFrame, calls: str = "tool_calls") -> DataFrame:
    """AGG25, MAP03: tool, calls."""
    return runs.select(F.explode(calls).alias("tool", "n")).groupBy("tool").agg(F.sum("n").alias("calls"))


def trigger_rates(trials: DataFrame, threshold: float = 0.5, compat: bool = False) -> DataFrame:
    """AGG05, PRJ19, SET08: query, should_trigger, triggers, runs, errors, trigger_rate, pass. The last label by arrival counts.

    Failed trials are left out of the rate; with compat they count as not triggered.
    """
    error = F.col("error").isNotNull() if "error" in trials.columns else F.lit(False)
    counted = F.lit(True) if compat else ~error
    g = trials.groupBy("query").agg(
        F.max_by("should_trigger", "arrival").alias("should_trigger"),
        F.count_if(F.col("triggered") & ~error).alias("triggers"),
        F.count_if(counted).alias("runs"),
        F.count_if(error).alias("errors"),
    )
    rate = V.ratio(F.col("triggers"), F.col("runs"), 0.0)
    return g.withColumn("trigger_rate", rate).withColumn("pass", F.when(F.col("should_trigger"), rate >= threshold).otherwise(rate < threshold))


def confusion(results: DataFrame) -> DataFrame:
    """AGG07: one row of tp, fn, fp, tn weighted by runs, precision, recall (1 of nothing) and accuracy (0 of nothing)."""
    n = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).cast("long")
    pos, hit, miss = F.col("should_trigger"), F.col("triggers"), F.col("runs") - F.col("triggers")
    m = results.agg(n(pos, hit).alias("tp"), n(pos, miss).alias("fn"), n(~pos, hit).alias("fp"), n(~pos, miss).alias("tn"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return m.withColumns({"precision": V.ratio(tp, tp + fp, 1.0), "recall": V.ratio(tp, tp + fn, 1.0), "accuracy": V.ratio(tp + tn, tp + fn + fp + tn, 0.0)})


def pass_totals(results: DataFrame, *by: str) -> DataFrame:
    """AGG06, AGG08: total, passed, failed; by split and iteration where asked."""
    return results.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("pass")).alias("passed"), F.count_if(~F.col("pass")).alias("failed"))


def best_iteration(history: DataFrame, score: str, iteration: str = "iteration") -> DataFrame:
    """WIN02: the first of the iterations with the highest score, null as 0. One row by two aggregates, no global sort."""
    value = F.coalesce(F.col(score), F.lit(0))
    return history.agg(F.max(F.struct(value.alias("score"), (-F.col(iteration)).alias("order"))).alias("m")).select((-F.col("m.order")).alias(iteration), F.col("m.score").alias("score"))


def until_stop(history: DataFrame, failed: str = "train_failed", most: int = 5) -> DataFrame:
    """WIN03: the iterations that ran: up to the first without failures, or `most`."""
    end = history.agg(F.min(F.when(F.col(failed) == 0, F.col("iteration"))).alias("end"))
    return history.join(F.broadcast(end)).where((F.col("iteration") <= F.coalesce("end", F.lit(most))) & (F.col("iteration") <= most)).drop("end")


def stratified_split(rows: DataFrame, key: str, stratum: str, holdout: float = 0.4, seed: int = 42, digits: int = 3) -> DataFrame:
    """MTH04, MTH05: adds split: of each stratum the first max(1, floor(n * holdout)) by a seeded hash are test.

    Hashes fall into bins by their first `digits` hex digits. Counts of a stratum's bins tell the bin in which its
    test part ends; only the rows of that bin are ranked, so no task sorts a stratum.
    """
    binned = rows.withColumn("__rank", V.shuffle_rank(F.col(key), seed)).withColumn("__bin", F.substring("__rank", 1, digits))
    counts = rows.withColumn("__bin", F.substring(V.shuffle_rank(F.col(key), seed), 1, digits)).groupBy(stratum, "__bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy(stratum)  # 16 ** digits rows of a stratum at most
    counts = counts.withColumn("size", V.holdout_size(F.sum("n").over(by), holdout)).withColumn("before", F.sum("n").over(by.orderBy("__bin")) - F.col("n"))
    left = counts.select(F.col(stratum).alias("__s"), F.col("__bin").alias("__b"), (F.col("size") - F.col("before")).alias("__left"), "n")
    both = binned.join(left, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__bin") == F.col("__b"))).drop("__s", "__b")
    edge = (F.col("__left") > 0) & (F.col("__left") < F.col("n"))
    whole = both.where(~edge).withColumn("split", F.when(F.col("__left") > 0, "test").otherwise("train"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("__rank", key))
    cut = both.where(edge).withColumn("split", F.when(place <= F.col("__left"), "test").otherwise("train"))
    return whole.unionByName(cut).drop("__rank", "__bin", "__left", "n")


def blinded(df: DataFrame) -> DataFrame:
    """PRJ21: without the columns that tell test results."""
    return df.select(*[c for c in df.columns if not c.startswith("test_")])


def failure_kind(should: Column, passed: Column) -> Column:
    """PRJ20."""
    return F.when(passed, "none").when(should, "missed_trigger").otherwise("false_trigger")


def score_band(passed: Column, total: Column) -> Column:
    """PRJ24."""
    share = V.ratio(passed, total, 0.0)
    return F.when(share >= 0.8, "good").when(share >= 0.5, "ok").otherwise("bad")


def assertion_patterns(results: DataFrame, first: str, second: str) -> DataFrame:
    """AGG13: assertion, pattern over two configurations."""
    side = lambda name, f: f(F.when(F.col("configuration") == name, F.col("passed")))
    g = results.groupBy("assertion").agg(side(first, F.bool_and).alias("a_all"), side(first, F.bool_or).alias("a_any"), side(second, F.bool_and).alias("b_all"), side(second, F.bool_or).alias("b_any"))
    a1, a0, b1, b0 = F.col("a_all"), ~F.col("a_any"), F.col("b_all"), ~F.col("b_any")
    pattern = F.when(a1 & b1, "always_pass").when(a0 & b0, "always_fail").when(a1 & b0, "only_first").when(a0 & b1, "only_second").otherwise("variable")
    return g.select("assertion", pattern.alias("pattern"))


def outliers(rows: DataFrame, by: str, value: str, z: float = 2.0) -> DataFrame:
    """AGG14: adds z_score and is_outlier within the group."""
    w = Window.partitionBy(by)
    score = F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)), F.lit(0.0))
    return rows.withColumn("z_score", score).withColumn("is_outlier", F.abs("z_score") > z)


def rubric(scores: DataFrame) -> DataFrame:
    """AGG15: side, content, structure, overall: means of criteria per dimension, overall is their mean times two."""
    g = scores.groupBy("side").pivot("dimension", ["content", "structure"]).agg(F.avg("score"))
    return g.withColumn("overall", F.round((F.col("content") + F.col("structure")) / 2 * 2, 1))


def winner(a_overall: Column, b_overall: Column, a_rate: Column, b_rate: Column) -> Column:
    """AGG16: overall score, then pass rate, else a tie."""
    return F.when(a_overall > b_overall, "A").when(a_overall < b_overall, "B").when(a_rate > b_rate, "A").when(a_rate < b_rate, "B").otherwise("TIE")


def latest_label(rows: DataFrame, key: str, label: str, arrival: str) -> DataFrame:
    """SET08: one row per key with the label that arrived last."""
    return rows.groupBy(key).agg(F.max_by(label, arrival).alias(label))


def previous_outputs(runs: DataFrame, key: str = "run_id", order: str = "iteration", value: str = "output") -> DataFrame:
    """WIN12: adds the value of the iteration before."""
    return runs.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def verified_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """JON12: kind, claims, verified: how many claims of a kind (factual, process, quality) have evidence. The verdicts themselves are judged, and given."""
    known = evidence.select("claim_id").distinct().withColumn("has", F.lit(True))
    rows = claims.join(known, "claim_id", "left")
    return rows.groupBy("kind").agg(F.count("*").alias("claims"), F.count_if(F.col("has").isNotNull()).alias("verified"))
