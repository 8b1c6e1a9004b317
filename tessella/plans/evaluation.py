"""Queries of evaluation analytics (W2, W3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions import values as V
from tessella.operators import evals as E
from tessella.plans.registry import query, table

_STATS = "round(avg({c}), 4) AS mean, coalesce(round(stddev_samp({c}), 4), 0) AS stddev, round(min({c}), 4) AS min, round(max({c}), 4) AS max"
_RUNS = "SELECT event_type AS configuration, value AS time_seconds, CASE WHEN user_id % 9 = 0 THEN NULL ELSE value / 100 END AS pass_rate, CAST(user_id AS DOUBLE) AS tokens FROM events"


def _runs(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("configuration"), F.col("value").alias("time_seconds"), F.when(F.col("user_id") % 9 != 0, F.col("value") / 100).alias("pass_rate"), F.col("user_id").cast("double").alias("tokens"))


@query(" UNION ALL ".join(f"SELECT configuration, '{m}' AS metric, {_STATS.format(c=m)}, CAST(count({m}) AS BIGINT) AS n FROM ({_RUNS}) GROUP BY configuration" for m in E.METRICS))
def w2_config_summary(spark, sf):
    """AGG01, AGG02, MTH02, Q3: events stand in for runs, their type for the configuration."""
    return E.summary(_runs(spark, sf))


@query(f"""WITH s AS ({" UNION ALL ".join(f"SELECT configuration, '{m}' AS metric, round(avg({m}), 4) AS mean FROM ({_RUNS}) GROUP BY configuration" for m in E.METRICS)}),
p AS (SELECT *, dense_rank() OVER (ORDER BY configuration) AS place FROM s)
SELECT metric, round(max(CASE WHEN place = 1 THEN mean END) - max(CASE WHEN place = 2 THEN mean END), 6) AS delta FROM p GROUP BY metric""")
def w2_config_delta(spark, sf):
    """AGG03, Q2."""
    return E.delta(E.summary(_runs(spark, sf))).withColumn("delta", F.round("delta", 6))


@query("SELECT DISTINCT event_type AS configuration, upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) AS label FROM events")
def w2_config_label(spark, sf):
    """STR10."""
    return table(spark, sf, "events").select(F.col("event_type").alias("configuration")).distinct().withColumn("label", X.label(F.col("configuration")))


@query("SELECT l_orderkey, l_linenumber, round(avg(l_extendedprice), 4) AS mean_price FROM lineitem GROUP BY ALL")
def w2_rounded_means(spark, sf):
    """MTH01."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(V.rounded(F.avg("l_extendedprice"), 4).alias("mean_price"))


@query("""SELECT array_to_string(list(DISTINCT user_id ORDER BY user_id), ',') AS ids, CAST(count(DISTINCT user_id) AS BIGINT) AS n, event_type FROM events GROUP BY event_type""")
def w2_eval_ids(spark, sf):
    """AGG04, Q4."""
    g = table(spark, sf, "events").groupBy("event_type").agg(V.distinct_values("user_id").alias("s"))
    return g.select("event_type", F.array_join(F.col("s").cast("array<string>"), ",").alias("ids"), F.size("s").cast("long").alias("n"))


@query("""WITH d AS (SELECT DISTINCT 'eval-' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_brand || 'x' END AS eval_dir, max(CASE WHEN p_size % 10 = 0 THEN 1000 + p_size END) AS stated FROM part GROUP BY 1)
SELECT eval_dir, CAST(coalesce(stated, TRY_CAST(nullif(regexp_extract(eval_dir, '-(\\d+)$', 1), '') AS BIGINT), row_number() OVER (ORDER BY eval_dir) - 1) AS BIGINT) AS eval_id FROM d""")
def w2_eval_index(spark, sf):
    """JON07, WIN04, Q6."""
    p = table(spark, sf, "part")
    d = p.withColumn("eval_dir", F.concat(F.lit("eval-"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat("p_brand", F.lit("x")))))
    meta = d.groupBy("eval_dir").agg(F.max(F.when(F.col("p_size") % 10 == 0, F.col("p_size") + 1000)).alias("eval_id"))
    return E.eval_ids(d, meta)


@query("""SELECT o.o_orderkey AS run, round(CASE WHEN o_orderkey % 3 = 0 THEN coalesce(l.t, 0) ELSE o_totalprice END, 2) AS time_seconds, l.n AS tokens FROM orders o LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS t, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def w2_run_timing(spark, sf):
    """JON06, Q1: orders are gradings, every third without a time; line items give timings."""
    g = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("time_seconds"))
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("total_duration_seconds"), F.count("*").alias("total_tokens"))
    return E.load_runs(g, t).withColumn("time_seconds", F.round("time_seconds", 2))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS run, concat_ws(',', CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_totalprice > 200000 THEN 'large' END, o_orderpriority) AS notes FROM orders""")
def w2_notes(spark, sf):
    """SET06."""
    some = lambda cond, v: F.when(cond, F.array(F.lit(v)))
    notes = V.joined(some(F.col("o_orderstatus") == "O", "open"), some(F.col("o_totalprice") > 200000, "large"), F.array("o_orderpriority"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.array_join(notes, ",").alias("notes"))


@query("SELECT event_type AS tool, CAST(sum(user_id % 5) AS BIGINT) AS calls FROM events GROUP BY event_type")
def w2_tool_histogram(spark, sf):
    """AGG25, MAP03."""
    e = table(spark, sf, "events").select(F.create_map("event_type", F.col("user_id") % 5).alias("tool_calls"))
    return E.tool_histogram(e)


@query("""SELECT o_orderkey AS run, bool_or(l_discount = 0 OR l_tax = 0) AS bad FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def w2_expectation_shape(spark, sf):
    """PRJ23: discount and tax of 0 stand in for missing fields."""
    x = F.struct(F.nullif("l_discount", F.lit(0.0)).alias("text"), F.nullif("l_tax", F.lit(0.0)).alias("passed"))
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.collect_list(x).alias("expectations"))
    return g.select("run", E.bad_expectations(F.col("expectations")).alias("bad"))


_TRIALS = "SELECT source AS query, d.doc_id AS arrival, quality = 1 AS should_trigger, toxic = 0 AS triggered FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
_RATES = f"""SELECT query, arg_max(should_trigger, arrival) AS should_trigger, CAST(count(*) FILTER (triggered) AS BIGINT) AS triggers, CAST(count(*) AS BIGINT) AS runs, CAST(0 AS BIGINT) AS errors, round(count(*) FILTER (triggered) / count(*), 6) AS trigger_rate,
 CASE WHEN arg_max(should_trigger, arrival) THEN count(*) FILTER (triggered) / count(*) >= 0.5 ELSE count(*) FILTER (triggered) / count(*) < 0.5 END AS pass FROM ({_TRIALS}) GROUP BY query"""


def _trials(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return d.select(F.col("source").alias("query"), F.col("doc_id").alias("arrival"), (F.col("quality") == 1).alias("should_trigger"), (F.col("toxic") == 0).alias("triggered"))


@query(_RATES)
def w3_trigger_rate(spark, sf):
    """AGG05, PRJ19, SET08, Q9, Q24."""
    return E.trigger_rates(_trials(spark, sf)).withColumn("trigger_rate", F.round("trigger_rate", 6))


@query(f"SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (pass) AS BIGINT) AS passed, CAST(count(*) FILTER (NOT pass) AS BIGINT) AS failed FROM ({_RATES})")
def w3_pass_totals(spark, sf):
    """AGG06."""
    return E.pass_totals(E.trigger_rates(_trials(spark, sf)))


@query("""SELECT tp, fn, fp, tn, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6) AS recall, round((tp + tn) / (tp + fn + fp + tn), 6) AS accuracy
FROM (SELECT CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) tp, CAST(sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) fn, CAST(sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) fp, CAST(sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) tn FROM labels)""")
def w3_confusion(spark, sf):
    """AGG07, MTH03."""
    l = table(spark, sf, "labels").select((F.col("quality") == 1).alias("should_trigger"), (F.col("toxic") == 0).cast("long").alias("triggers"), F.lit(1).cast("long").alias("runs"))
    return E.confusion(l).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "accuracy")})


@query("SELECT day AS iteration, n AS score FROM (SELECT day(ts) AS day, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS n FROM events GROUP BY 1) ORDER BY n DESC, day LIMIT 1")
def w3_best_iteration(spark, sf):
    """WIN02."""
    h = table(spark, sf, "events").groupBy(F.dayofmonth("ts").cast("long").alias("iteration")).agg(F.count_if(F.col("event_type") == "purchase").alias("passed"))
    return E.best_iteration(h, "passed")


@query("""WITH h AS (SELECT day(ts) AS iteration, CAST(count(*) FILTER (user_id % 50 = 0 AND value > 80) AS BIGINT) AS train_failed FROM events GROUP BY 1)
SELECT iteration, train_failed FROM h WHERE iteration <= coalesce((SELECT min(iteration) FROM h WHERE train_failed = 0), 20) AND iteration <= 20""")
def w3_early_stop(spark, sf):
    """WIN03."""
    h = table(spark, sf, "events").groupBy(F.dayofmonth("ts").cast("long").alias("iteration")).agg(F.count_if(F.expr("user_id % 50 = 0 AND value > 80")).alias("train_failed"))
    return E.until_stop(h, most=20)


@query("""SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '-42'), doc_id) <= greatest(1, CAST(floor(count(*) OVER (PARTITION BY quality) * 0.4) AS BIGINT)) THEN 'test' ELSE 'train' END AS split FROM labels""")
def w3_stratified_split(spark, sf):
    """MTH04, MTH05, Q8."""
    return E.stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query("""WITH s AS (SELECT doc_id, quality, toxic, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '-42'), doc_id) <= greatest(1, CAST(floor(count(*) OVER (PARTITION BY quality) * 0.4) AS BIGINT)) THEN 'test' ELSE 'train' END AS split FROM labels)
SELECT split, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (quality + toxic = 1) AS BIGINT) AS passed, CAST(count(*) FILTER (quality + toxic <> 1) AS BIGINT) AS failed, CASE WHEN count(*) FILTER (quality + toxic = 1) / count(*) >= 0.8 THEN 'good' WHEN count(*) FILTER (quality + toxic = 1) / count(*) >= 0.5 THEN 'ok' ELSE 'bad' END AS band FROM s GROUP BY split""")
def w3_split_results(spark, sf):
    """AGG08, JON08, PRJ24, SET04, SET05."""
    s = E.stratified_split(table(spark, sf, "labels"), "doc_id", "quality").withColumn("pass", F.col("quality") + F.col("toxic") == 1)
    return E.pass_totals(s, "split").withColumn("band", E.score_band(F.col("passed"), F.col("total")))


@query("""SELECT doc_id, CASE WHEN quality + toxic = 1 THEN 'none' WHEN quality = 1 THEN 'missed_trigger' ELSE 'false_trigger' END AS failure FROM labels""")
def w3_failures(spark, sf):
    """PRJ20, PRJ21."""
    l = table(spark, sf, "labels").withColumn("test_pass", F.lit(1))
    return E.blinded(l.withColumn("failure", E.failure_kind(F.col("quality") == 1, F.col("quality") + F.col("toxic") == 1)).drop("quality", "toxic"))


@query("SELECT doc_id, length(text) > 1024 AS too_long, substr(text, 1, 60) AS shown FROM documents")
def w3_description_guard(spark, sf):
    """PRJ22, LIM02."""
    from tessella.operators.validate import too_long

    return table(spark, sf, "documents").select("doc_id", too_long(F.col("text")).alias("too_long"), X.cut(F.col("text"), 60).alias("shown"))


@query("""WITH a AS (SELECT l_suppkey AS assertion, l_returnflag = 'A' AS one, l_quantity > CASE l_suppkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 100 WHEN 2 THEN CASE l_returnflag WHEN 'A' THEN 0 ELSE 100 END WHEN 3 THEN CASE l_returnflag WHEN 'A' THEN 100 ELSE 0 END ELSE 25 END AS passed FROM lineitem)
SELECT assertion, CASE WHEN bool_and(passed) FILTER (one) AND bool_and(passed) FILTER (NOT one) THEN 'always_pass' WHEN NOT bool_or(passed) FILTER (one) AND NOT bool_or(passed) FILTER (NOT one) THEN 'always_fail'
 WHEN bool_and(passed) FILTER (one) AND NOT bool_or(passed) FILTER (NOT one) THEN 'only_first' WHEN NOT bool_or(passed) FILTER (one) AND bool_and(passed) FILTER (NOT one) THEN 'only_second' ELSE 'variable' END AS pattern FROM a GROUP BY assertion""")
def w3_assertion_patterns(spark, sf):
    """AGG13: suppliers are assertions; those of each rest by five have a pattern of their own."""
    one, kind = F.col("l_returnflag") == "A", F.col("l_suppkey") % 5
    least = F.when(kind == 0, 0).when(kind == 1, 100).when(kind == 2, F.when(one, 0).otherwise(100)).when(kind == 3, F.when(one, 100).otherwise(0)).otherwise(25)
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("assertion"), F.when(one, "first").otherwise("second").alias("configuration"), (F.col("l_quantity") > least).alias("passed"))
    return E.assertion_patterns(rows, "first", "second")


@query("""SELECT event_id, coalesce(abs((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0)) > 2, false) AS is_outlier FROM events WINDOW w AS (PARTITION BY user_id)""")
def w3_outliers(spark, sf):
    """AGG14."""
    return E.outliers(table(spark, sf, "events"), "user_id", "value").select("event_id", "is_outlier")


@query("""SELECT c_nationkey AS side, round(avg(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END), 4) AS content, round(avg(CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END), 4) AS structure, round(avg(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END) + avg(CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END), 1) AS overall FROM customer GROUP BY c_nationkey""")
def w3_rubric(spark, sf):
    """AGG15."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("side"), F.when(F.col("c_custkey") % 2 == 0, "content").otherwise("structure").alias("dimension"), F.col("c_acctbal").alias("score"))
    return E.rubric(c).select("side", F.round("content", 4).alias("content"), F.round("structure", 4).alias("structure"), "overall")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'A' WHEN o_totalprice < 100000 THEN 'B' WHEN o_orderkey % 3 = 0 THEN 'A' WHEN o_orderkey % 3 = 1 THEN 'B' ELSE 'TIE' END AS winner FROM orders""")
def w3_winner(spark, sf):
    """AGG16."""
    p, k = F.col("o_totalprice"), F.col("o_orderkey") % 3
    a = F.when(p > 150000, 2).when(p < 100000, 0).otherwise(1)
    return table(spark, sf, "orders").select("o_orderkey", E.winner(a, F.lit(1), F.when(k == 0, 2).otherwise(1), F.when(k == 1, 2).otherwise(1)).alias("winner"))


@query("""SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events""")
def w3_previous_outputs(spark, sf):
    """WIN12."""
    return E.previous_outputs(table(spark, sf, "events"), "user_id", "event_id", "event_type").select("user_id", "event_id", "previous")
