"""Queries of the rule systems (W5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions import values as V
from tessella.operators import knowledge as K
from tessella.operators import proposal as P
from tessella.operators import rules as R
from tessella.plans.registry import query, table
from tessella.streaming.events import tumbling_counts


@query("""WITH c AS (SELECT doc_id, md5(text) AS claim_id, 'T' || (1 + n_chars % 4) AS tier, CASE doc_id % 6 WHEN 0 THEN 'public' WHEN 1 THEN 'specs' WHEN 2 THEN 'fragment' WHEN 3 THEN 'reviewed' WHEN 4 THEN 'llm' ELSE 'human' END AS class, doc_id % 3 AS recency, source AS value FROM documents),
r AS (SELECT *, rank() OVER (PARTITION BY claim_id ORDER BY tier, recency DESC, CASE class WHEN 'public' THEN 1 WHEN 'specs' THEN 2 WHEN 'fragment' THEN 3 WHEN 'reviewed' THEN 4 WHEN 'llm' THEN 5 ELSE 6 END) AS place FROM c)
SELECT doc_id, claim_id, min(value) OVER (PARTITION BY claim_id) <> max(value) OVER (PARTITION BY claim_id) AS contradiction FROM r WHERE place = 1""")
def w5_tier_conflict(spark, sf):
    """WIN08, Q7, Q16: copies of a text are sources of one claim."""
    d = table(spark, sf, "documents")
    cls = F.get(F.array(*[F.lit(x) for x in ("public", "specs", "fragment", "reviewed", "llm", "human")]), (F.col("doc_id") % 6).cast("int"))
    claims = d.select("doc_id", F.md5("text").alias("claim_id"), F.concat(F.lit("T"), (F.col("n_chars") % 4 + 1).cast("string")).alias("tier"), cls.alias("source_class"), (F.col("doc_id") % 3).alias("last_updated"), F.col("source").alias("value"))
    return R.resolve_conflicts(claims).select("doc_id", "claim_id", "contradiction")


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'T3' WHEN lines > 0 AND bad / lines > 0.9 THEN CASE WHEN doc_id % 2 = 0 THEN 'T4' ELSE 'T3' END WHEN lang = 'en' THEN CASE WHEN doc_id % 5 = 0 THEN 'T1' ELSE 'T2' END ELSE 'T4' END AS tier
FROM (SELECT doc_id, lang, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND (regexp_matches(x, '^\\s*[-*•] ') OR contains(x, '—') OR contains(lower(x), 'in summary')))) AS bad FROM documents)""")
def w5_inferred_tier(spark, sf):
    """PRJ11, STR27."""
    n = F.col("doc_id")
    commit = F.when(n % 11 == 0, "Import notes").otherwise("edit")
    return table(spark, sf, "documents").select("doc_id", R.inferred_tier(commit, X.slop_ratio(F.col("text")), n % 2 == 0, F.col("lang") == "en", n % 5 == 0).alias("tier"))


_CANDIDATES = """SELECT label % 3 AS topic, label AS candidate, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS score, CAST(count(*) AS BIGINT) AS fit FROM embeddings GROUP BY label"""


@query(f"""WITH c AS ({_CANDIDATES}), v AS (SELECT a.topic, CASE WHEN a.score >= b.score THEN a.candidate ELSE b.candidate END AS candidate FROM c a JOIN c b ON a.topic = b.topic AND a.candidate < b.candidate),
w AS (SELECT topic, candidate, count(*) AS wins FROM v GROUP BY ALL), r AS (SELECT c.topic, c.candidate, coalesce(wins, 0) AS wins, row_number() OVER (PARTITION BY c.topic ORDER BY coalesce(wins, 0) DESC, fit DESC, c.candidate) AS place FROM c LEFT JOIN w USING (topic, candidate))
SELECT topic, candidate, CAST(wins AS BIGINT) AS wins, place, CASE place WHEN 1 THEN 'winner' WHEN 2 THEN 'runner_up' ELSE 'rejected' END AS role FROM r""")
def w5_condorcet(spark, sf):
    """JON20, AGG17: labels are candidates, the mean of a first component decides a pair."""
    e = table(spark, sf, "embeddings")
    c = e.groupBy((F.col("label") % 3).alias("topic"), F.col("label").alias("candidate")).agg(F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("score"), F.count("*").alias("domain_fit"))
    both = R.pairs(c).join(c.select("topic", F.col("candidate").alias("left"), F.col("score").alias("ls")), ["topic", "left"]).join(c.select("topic", F.col("candidate").alias("right"), F.col("score").alias("rs")), ["topic", "right"])
    votes = both.select("topic", F.when(F.col("ls") >= F.col("rs"), F.col("left")).otherwise(F.col("right")).alias("winner"))
    out = R.condorcet(votes, c.withColumns({"signal": F.lit("HELD"), "complexity": F.lit(0)}))
    return out.select("topic", "candidate", "wins", F.col("place").cast("long").alias("place"), "role")


_WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> ''))"


@query(f"""WITH t AS (SELECT conv_id, turn, {_WORDS} AS w, lag({_WORDS}) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(w, p))) = 0 THEN 0 ELSE len(list_intersect(w, p)) / len(list_distinct(list_concat(w, p))) END, 6) AS overlap FROM t WHERE p IS NOT NULL""")
def w5_convergence(spark, sf):
    """MTH06, WIN09: word overlap of consecutive turns."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda x: x != ""))
    t = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("w"))
    t = t.withColumn("p", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("p IS NOT NULL")
    return t.select("conv_id", "turn", F.round(V.overlap(F.col("w"), F.col("p")), 6).alias("overlap"))


@query("""SELECT topic, CAST(count(*) FILTER (overlap > 0.8) AS BIGINT) AS n_over, CASE WHEN count(*) FILTER (overlap > 0.8) = count(*) THEN 'CONVERGE-ALL' WHEN count(*) FILTER (overlap > 0.8) > 0 THEN 'CONVERGE-PARTIAL' ELSE 'DIVERGENT' END AS class,
 count(*) FILTER (overlap > 0.8) > 1 AND count(*) FILTER (overlap > 0.8) < count(*) AS ambiguous FROM (SELECT l_orderkey AS topic, 1 - l_discount * 3 AS overlap FROM lineitem) GROUP BY topic""")
def w5_convergence_class(spark, sf):
    """GRF09."""
    return R.convergence(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("topic"), (1 - F.col("l_discount") * 3).alias("overlap")))


@query("""WITH v AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS last, lag(turn) OVER (PARTITION BY conv_id, text ORDER BY turn) AS seen FROM conversations),
p AS (SELECT *, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS a, list_distinct(regexp_split_to_array(lower(last), '\\s+')) AS b FROM v),
w AS (SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'correct because|already handles|doesn''t apply because|intentional design choice|justified by') THEN 'DEFENSE' WHEN last IS NOT NULL AND len(list_intersect(a, b)) > 0.95 * len(list_distinct(list_concat(a, b))) THEN 'CONVERGE' WHEN seen < turn - 1 THEN 'CYCLE' WHEN turn >= 6 THEN 'TIMEOUT' END AS reason FROM p)
SELECT conv_id AS solution_id, min(turn) AS iteration, arg_min(reason, turn) AS reason FROM w WHERE reason IS NOT NULL GROUP BY conv_id""")
def w5_terminations(spark, sf):
    """WIN09, GRF10: whole turns, with the operator's own similarity."""
    v = table(spark, sf, "conversations").select(F.col("conv_id").alias("solution_id"), F.col("turn").alias("iteration"), "text")
    return R.terminations(v, 6)


@query("""SELECT o_custkey, score, CASE WHEN score <= 1 THEN 'A' WHEN score <= 3 THEN 'B' WHEN score <= 5 THEN 'C' ELSE 'D' END AS profile FROM (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) + max(CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END) + max(CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END) + max(CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 0 END) + max(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END) AS score FROM orders GROUP BY o_custkey)""")
def w5_profile_score(spark, sf):
    """PRJ25."""
    has = lambda c: F.bool_or(c)
    s = F.col("o_orderstatus")
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(has(s == "F").alias("a"), has(s == "O").alias("b"), has(s == "P").alias("c"), has(F.startswith("o_orderpriority", F.lit("1"))).alias("d"), has(F.col("o_totalprice") > 400000).alias("e"))
    return g.select("o_custkey", R.composition(*[F.col(c) for c in "abcde"]).alias("r")).select("o_custkey", "r.score", "r.profile")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'GENERATE' WHEN 'P' THEN 'COMPLETE' ELSE 'CHALLENGE' END AS instruction, CASE WHEN m <= 8 THEN 'none' WHEN m <= 12 THEN '1-2 weeks' ELSE '20-25%' END AS impact, CASE WHEN m <= 1 THEN 'inline' WHEN m <= 3 THEN 'parallel' WHEN m <= 6 THEN 'batched' ELSE 'waves' END AS dispatch,
 CASE WHEN o_orderpriority LIKE '1%' AND m > 6 THEN 'refine_all' WHEN o_orderpriority LIKE '1%' THEN 'refine_until_defense' WHEN o_orderpriority LIKE '2%' THEN 'refine_winner' ELSE 'skip' END AS refine, CASE WHEN o_orderpriority LIKE '1%' AND m > 6 THEN 'multi_candidate' WHEN o_orderpriority LIKE '1%' THEN 'single_self_refine' WHEN m = 3 THEN 'tot' WHEN m = 4 THEN 'cod_sot' ELSE 'cot' END AS method
FROM (SELECT *, o_orderkey % 15 AS m FROM orders)""")
def w5_cascades(spark, sf):
    """PRJ26-PRJ30: keys and priorities of orders stand in for the rules' dimensions."""
    m, top = F.col("o_orderkey") % 15, F.startswith("o_orderpriority", F.lit("1"))
    stakes = F.when(top, "high").when(F.startswith("o_orderpriority", F.lit("2")), "medium").otherwise("low")
    state = F.when(F.col("o_orderstatus") == "O", "ABSENT").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("PRESENT")
    none = F.lit("none")
    method = F.get(R.methods(stakes, F.when(m > 6, "high").otherwise("low"), F.when(m == 3, "high").otherwise("low"), F.lit("unknown"), none, F.when(m == 4, "tight").otherwise("generous"), none), F.lit(0))
    return table(spark, sf, "orders").select("o_orderkey", R.instruction(state).alias("instruction"), R.timeline_impact(m).alias("impact"), R.dispatch(m).alias("dispatch"), R.refine_level(stakes, F.when(m > 6, 3).otherwise(1)).alias("refine"), method.alias("method"))


@query("""SELECT o_orderkey, CASE WHEN m % 4 = 0 THEN 'OPEN' WHEN m % 4 = 1 THEN 'INVOKE' ELSE 'FALLBACK' END AS gate, CASE WHEN m % 3 = 0 THEN 'done' WHEN m % 3 = 1 THEN 'continuation' ELSE 'handoff' END AS next, CASE WHEN m = 0 THEN 'flaw' WHEN m IN (1, 2) THEN 'strong' WHEN m IN (3, 4) THEN 'adequate' END AS signal, CASE WHEN m < 3 THEN 'drop' WHEN m = 3 THEN 'replace' WHEN m < 6 THEN 'alternative' ELSE 'add' END AS finding,
 m >= 5 OR (m >= 3 AND o_orderstatus <> 'O') AS checked, CASE WHEN m = 1 THEN 'Ontology' WHEN m = 2 THEN 'Procedure' WHEN m = 3 THEN 'Concept' WHEN m = 4 THEN 'Fact' ELSE 'Narrative' END AS artifact, m = 9 OR m = 0 AS high_stakes, CASE WHEN m = 9 THEN 'defer' WHEN m % 2 = 0 THEN 'create' ELSE 'defer' END AS materialize FROM (SELECT *, o_orderkey % 10 AS m FROM orders)""")
def w5_decisions(spark, sf):
    """PRJ31, PRJ35-PRJ37, PRJ39, PRJ40, PRJ43, PRJ52."""
    m = F.col("o_orderkey") % 10
    f = F.lit(False)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        R.gate(m % 4 == 0, m % 4 == 1).alias("gate"),
        R.continuation(m % 3 == 0, m % 3 == 1, F.lit(True)).alias("next"),
        R.signal(F.when(m.isin(1, 2), "CONVERGE").when(m.isin(3, 4), "DRIFTING").otherwise("SOFTENING"), F.when(m == 0, "FAILED").otherwise("HELD")).alias("signal"),
        R.merge_finding(F.when(m >= 3, "u"), F.when(m == 3, "T1").otherwise("T2"), m < 6).alias("finding"),
        R.checklist(m, F.lit(3), F.col("o_orderstatus") == "O").alias("checked"),
        R.artifact_type(m == 1, m == 2, m == 3, m == 4).alias("artifact"),
        R.high_stakes(F.when(m == 9, "health").when(m > 0, "games"), ("health", "law")).alias("high_stakes"),
        R.materialize(m % 2 == 0, f, f, f, m == 9).alias("materialize"),
    )


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS stated, round(s, 2) AS summed, coalesce(abs(o_totalprice - s) <= 1, false) AS ok FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def w5_reconcile(spark, sf):
    """AGG18."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").cast("decimal(18,2)").alias("part"))
    r = P.reconcile(o, l, "o_orderkey", "o_totalprice", "part", 1.0)
    return r.select("o_orderkey", F.round("stated", 2).alias("stated"), F.round(F.col("summed").cast("double"), 2).alias("summed"), "ok")


@query("""SELECT coalesce(o_orderstatus, 'Total') AS status, CAST(count(*) FILTER (o_orderpriority LIKE '1%') AS BIGINT) AS must, CAST(count(*) FILTER (o_orderpriority LIKE '2%') AS BIGINT) AS should, CAST(count(*) FILTER (o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%') AS BIGINT) AS could FROM orders GROUP BY ROLLUP (o_orderstatus)""")
def w5_rollup_counts(spark, sf):
    """AGG20."""
    p = F.substring("o_orderpriority", 1, 1)
    o = table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status")
    return P.with_total(o, "status", F.count_if(p == "1").alias("must"), F.count_if(p == "2").alias("should"), F.count_if(~p.isin("1", "2")).alias("could"))


@query("""SELECT l_suppkey AS area, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS "C", CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS "PC", CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS "NC+A", CAST(count(*) FILTER (l_returnflag IN ('A', 'R', 'N')) AS BIGINT) AS total FROM lineitem GROUP BY l_suppkey""")
def w5_coverage(spark, sf):
    """AGG19."""
    code = F.when(F.col("l_returnflag") == "A", "C").when(F.col("l_returnflag") == "R", "PC").when(F.col("l_returnflag") == "N", "NC+A")
    return P.coverage(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("area"), code.alias("code")))


@query("""SELECT l_suppkey AS role, CAST(week(l_shipdate) AS BIGINT) AS week, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 2) AS load FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 500""")
def w5_over_allocation(spark, sf):
    """AGG21."""
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("role"), F.weekofyear("l_shipdate").cast("long").alias("week"), F.col("l_quantity").cast("decimal(18,2)").alias("allocation"))
    return P.over_allocated(l, 500).withColumn("load", F.round(F.col("load").cast("double"), 2))


@query("""SELECT l_linestatus AS status, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS "A", CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS "N", CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS "R" FROM lineitem GROUP BY 1""")
def w5_tally(spark, sf):
    """AGG22-AGG24."""
    return P.tally(table(spark, sf, "lineitem").withColumnRenamed("l_linestatus", "status"), "l_returnflag", ("A", "N", "R"), "status")


@query("""SELECT source AS claim, CAST(count(*) AS BIGINT) AS n_sources, CAST(count(DISTINCT lang) AS BIGINT) AS n_values, """ + ", ".join(f"CAST(count(*) FILTER (n_chars % 4 = {i}) AS BIGINT) AS \"T{i + 1}\"" for i in range(4)) + """, count(DISTINCT lang) > 1 AS contradiction FROM documents GROUP BY source""")
def w5_consensus(spark, sf):
    """AGG26."""
    return P.consensus(table(spark, sf, "documents").select(F.col("source").alias("claim"), F.col("lang").alias("value"), F.concat(F.lit("T"), (F.col("n_chars") % 4 + 1).cast("string")).alias("tier")))


@query("""SELECT conv_id AS survey, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT lower(trim(text))) AS BIGINT) AS duplicates, count(*) BETWEEN 4 AND 8 AND count(*) = count(DISTINCT lower(trim(text))) AS ok FROM conversations GROUP BY conv_id""")
def w5_question_rules(spark, sf):
    """AGG27: whole questions."""
    return P.question_rules(table(spark, sf, "conversations").select(F.col("conv_id").alias("survey"), F.col("text").alias("question")), 4, 8)


_LINKS = "SELECT DISTINCT unnest(regexp_extract_all(html, '<a href=\"/([^\"]*)\"', 1)) AS target FROM pages"


@query(f"SELECT target FROM ({_LINKS}) WHERE target NOT IN (SELECT lower(n_name) FROM nation) AND target NOT IN (SELECT DISTINCT lower(substr(target, 1, 3)) FROM ({_LINKS}))")
def w5_backlog_links(spark, sf):
    """JON14: links whose target isn't one of the artifacts."""
    links = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("target")).distinct()
    artifacts = table(spark, sf, "nation").select(F.lower("n_name").alias("artifact")).unionByName(links.select(F.lower(F.substring("target", 1, 3)).alias("artifact"))).distinct()
    return K.backlog(links, artifacts)


@query("SELECT p_partkey AS artifact FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) AND p_partkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def w5_isolated(spark, sf):
    """JON15: parts that no relation of suppliers and customers names."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("target")).where("source IS NOT NULL")
    rel = s.select("source", F.col("source").alias("target")).unionByName(table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), F.col("o_custkey").alias("target")))
    return K.isolated(table(spark, sf, "part").select(F.col("p_partkey").alias("artifact")), rel)


@query("""WITH r AS (SELECT DISTINCT o_custkey AS source, o_orderkey % 150 AS target FROM orders) SELECT source, target FROM r WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.source = r.target AND b.target = r.source)""")
def w5_supersession(spark, sf):
    """JON13."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 150).alias("target")).distinct()
    rel = o.withColumn("relation", F.lit("supersedes")).unionByName(o.withColumn("relation", F.lit("superseded_by")))
    return K.one_sided(rel, "supersedes", "superseded_by").select("source", "target")


@query("""SELECT user_id AS artifact, event_id AS note, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rev, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS current FROM events""")
def w5_revision_log(spark, sf):
    """WIN06, WIN07."""
    r = K.revision_log(table(spark, sf, "events").select(F.col("user_id").alias("artifact"), "ts", F.col("event_id").alias("note")))
    return r.select("artifact", "note", F.col("rev").cast("long").alias("rev"), "current")


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id AS artifact, CAST(n AS BIGINT) AS n FROM n WHERE user_id % 3 = 0 AND n > 1""")
def w5_immutable(spark, sf):
    """PRJ34."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("artifact"))
    arts = e.distinct().withColumn("type", F.when(F.col("artifact") % 3 == 0, "Narrative").otherwise("Fact"))
    return K.immutable_violations(e, arts).select("artifact", "n")


@query("""SELECT c_custkey AS artifact FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1))""")
def w5_unverified_facts(spark, sf):
    """PRJ42."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("artifact"), F.when(F.col("c_custkey") % 2 == 0, "Fact").otherwise("Narrative").alias("type"))
    rel = table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"), F.lit("verified_by").alias("relation"))
    return K.unverified_facts(c, rel).select("artifact")


@query("""SELECT DISTINCT o_custkey AS subject, p.s AS relation FROM orders CROSS JOIN (SELECT unnest(['F', 'O', 'P']) AS s) p WHERE o_custkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = orders.o_custkey AND x.o_orderstatus = p.s)""")
def w5_triple_gaps(spark, sf):
    """GRF02: customers of even key must have an order in each status."""
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("relation"), F.when(F.col("o_custkey") % 2 == 0, "a").otherwise("b").alias("type"))
    return K.triple_gaps(t, spark.createDataFrame([("a", "F"), ("a", "O"), ("a", "P")], "type string, relation string"))


_TRIPLES = "SELECT DISTINCT o_custkey AS subject, (o_custkey * 7 + o_orderkey) % 1500 AS object, 0.6 AS relevance FROM orders"


@query(f"""WITH RECURSIVE t AS ({_TRIPLES}), w(node, d) AS (SELECT s_suppkey, 0 FROM supplier UNION SELECT t.object, w.d + 1 FROM w JOIN t ON t.subject = w.node WHERE w.d < 2)
SELECT node, CAST(min(d) AS BIGINT) AS depth FROM w GROUP BY node""")
def w5_expand(spark, sf):
    """GRF03: relevance 0.6 a step, so two steps stay above 0.3."""
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 1500).alias("object"), F.lit(0.6).alias("relevance")).distinct()
    seeds = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    return K.expand(t, seeds).select("node", F.col("depth").cast("long").alias("depth"))


@query("""WITH RECURSIVE w(root, node, step, seen) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 0, [CAST(n_nationkey AS BIGINT)] FROM nation UNION ALL SELECT root, (node * 3 + 1) % 25, step + 1, list_append(seen, (node * 3 + 1) % 25) FROM w WHERE step < 10 AND NOT list_contains(seen, (node * 3 + 1) % 25))
SELECT root, node, CAST(step AS BIGINT) AS step FROM w""")
def w5_why_chain(spark, sf):
    """GRF04."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    return K.why_chain(n.select(F.col("node").alias("question"), ((F.col("node") * 3 + 1) % 25).alias("answer")), n).select("root", "node", F.col("step").cast("long").alias("step"))


@query("""WITH RECURSIVE t(version, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 1 UNION ALL SELECT p_partkey, depth + 1 FROM t JOIN part ON p_partkey // 2 = t.version AND p_partkey > 1)
SELECT version, CAST(depth AS BIGINT) AS depth, version = (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1) AS is_current_best FROM t""")
def w5_version_tree(spark, sf):
    """GRF05, WIN10."""
    v = table(spark, sf, "part").where("p_partkey >= 1").select(F.col("p_partkey").alias("version"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2).cast("long")).alias("parent"), F.col("p_retailprice").alias("rate"))
    return K.version_tree(v).select("version", F.col("depth").cast("long").alias("depth"), "is_current_best")


@query("""SELECT DISTINCT n_nationkey AS fragment, CASE WHEN r_regionkey < 3 THEN 'T' || (r_regionkey + 1) ELSE 'T2' END AS tier FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def w5_inherited_tier(spark, sf):
    """GRF06."""
    src = table(spark, sf, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("source_file"), F.concat(F.lit("T"), (F.col("r_regionkey") + 1).cast("string")).alias("tier"))
    return K.inherited_tier(table(spark, sf, "nation").select(F.col("n_nationkey").alias("fragment"), F.col("n_regionkey").alias("source_file")), src)


@query("""SELECT s_suppkey AS id FROM supplier WHERE (s_suppkey % 3 IN (1, 2) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)) OR (s_suppkey % 3 = 2 AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))""")
def w5_challenges(spark, sf):
    """GRF07: nations are specs; goals of region 0 and premises of region 1 are challenged."""
    name = F.get(F.array(*[F.lit(x) for x in ("goal", "premise", "constraint")]), (F.col("s_suppkey") % 3).cast("int"))
    parts = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("spec_id"), name.alias("component"))
    hit = table(spark, sf, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("spec_id"), F.when(F.col("n_regionkey") == 0, "goal").otherwise("premise").alias("component"))
    return K.challenged(parts, hit).select("id")


@query("""SELECT conv_id AS doc, turn AS line, last_value(CASE WHEN role = 'user' THEN substr(text, 1, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def w5_sections(spark, sf):
    """WIN13: user turns stand in for headings."""
    lines = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"), F.when(F.col("role") == "user", F.concat(F.lit("## "), F.substring("text", 1, 20))).otherwise("x").alias("text"))
    return K.sections(lines).select("doc", "line", "section")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS id, CASE WHEN b.doc_id IS NULL THEN 'inferred' WHEN a.doc_id IS NULL THEN 'missed' WHEN a.lang <> b.t THEN 'drifted' ELSE 'kept' END AS status FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS t FROM documents WHERE doc_id % 4 <> 0) b ON a.doc_id = b.doc_id""")
def w5_registry(spark, sf):
    """JON19."""
    d = table(spark, sf, "documents")
    return K.registry_status(d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("text")), d.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")).alias("text")))


@query("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size % 4, p_partkey) AS place FROM part) SELECT p_brand AS topic, p_partkey AS finding, place, place <= 5 AS final FROM r WHERE place <= 10""")
def w5_funnel(spark, sf):
    """LIM03: a top-k report."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("topic"), F.col("p_partkey").alias("finding"), F.col("p_retailprice").alias("relevance"), F.concat(F.lit("T"), (F.col("p_size") % 4 + 1).cast("string")).alias("tier"))
    return R.funnel(p, "topic").select("topic", "finding", F.col("place").cast("long").alias("place"), "final")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 AND s_acctbal < 5000 THEN 'premise_incomplete' WHEN s_suppkey % 3 = 1 AND s_acctbal < 5000 THEN 'constraint_without_source' WHEN s_suppkey % 3 = 2 AND s_acctbal < 5000 THEN 'mission_sentences' END AS violation FROM supplier WHERE s_acctbal < 5000""")
def w5_spec_violations(spark, sf):
    """PRJ45."""
    kind = F.get(F.array(*[F.lit(x) for x in ("premise", "constraint", "mission")]), (F.col("s_suppkey") % 3).cast("int"))
    poor = F.col("s_acctbal") < 5000
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), kind.alias("component"), F.when(~poor, "s").alias("source"), F.lit("r").alias("risk"), F.when(poor, "One. Two.").otherwise("One only.").alias("text"))
    return R.spec_violations(s).select("id", "violation")


@query("""SELECT c_nationkey AS proposal, CASE WHEN min(c_acctbal) < -950 THEN 'NO-GO' WHEN min(c_acctbal) < -800 THEN 'GO with conditions' ELSE 'GO' END AS verdict FROM customer GROUP BY 1""")
def w5_feasibility(spark, sf):
    """PRJ50."""
    v = F.when(F.col("c_acctbal") < -950, "NO-GO").when(F.col("c_acctbal") < -800, "GO with conditions").otherwise("GO")
    return R.feasibility(table(spark, sf, "customer").select(F.col("c_nationkey").alias("proposal"), v.alias("verdict")))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def w5_scope_gaps(spark, sf):
    """JON16-JON18: in-scope items that no deliverable covers."""
    return P.without_match(table(spark, sf, "part").select("p_partkey"), table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size > 40 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def w5_scope_leaks(spark, sf):
    """JON16: out-of-scope items that are planned."""
    return P.leaked(table(spark, sf, "part").where("p_size > 40").select("p_partkey"), table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def w5_props_lookup(spark, sf):
    """MAP01, JSN01."""
    return table(spark, sf, "events").select("event_id", V.json_long(F.col("props"), "$.k", -1).alias("k"))


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 10 ELSE p_size END AS listed, CASE WHEN p_retailprice > 1000 THEN 'system_rule' ELSE 'skill' END AS kind FROM part")
def w5_read_plan(spark, sf):
    """PRJ54, PRJ57."""
    return table(spark, sf, "part").select("p_partkey", R.read_plan(F.col("p_size"), F.lit(100))["listed"].alias("listed"), R.rule_kind(F.col("p_retailprice") > 1000).alias("kind"))


@query("SELECT date_trunc('hour', ts) AS start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def ext_tumbling_window(spark, sf):
    """An extension beyond the surveyed operators: counts per hour."""
    return tumbling_counts(table(spark, sf, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")
