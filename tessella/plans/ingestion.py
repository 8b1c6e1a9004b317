"""Queries of incremental ingestion (W1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions import values as V
from tessella.operators import ingest as I
from tessella.operators import knowledge as K
from tessella.operators import rules as R
from tessella.plans.registry import query, table

# A document's state in a manifest is played by its id and text: some entries are missing, changed or failed.
STATUS = "CASE WHEN doc_id % 17 = 0 THEN 'error' WHEN doc_id % 13 = 0 THEN 'markdown_only' WHEN doc_id % 19 = 0 THEN 'images_only' ELSE 'complete' END"
ACTION_SQL = """SELECT coalesce(c.key, m.key) AS key, CASE WHEN c.key IS NULL THEN 'orphan' WHEN m.key IS NULL THEN 'new' WHEN c.hash <> m.hash THEN 'changed'
 WHEN m.status IN ({retried}) THEN 'retry' ELSE 'unchanged' END AS action
FROM (SELECT doc_id AS key, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0) c
FULL JOIN (SELECT doc_id AS key, sha256(text) AS hash, {status} AS status FROM documents WHERE doc_id % 10 <> 0) m ON c.key = m.key"""


def _manifest(spark, sf):
    d = table(spark, sf, "documents")
    current = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("key"), V.content_hash(F.when(F.expr("doc_id % 7 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    manifest = d.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("key"), V.content_hash(F.col("text")).alias("hash"), F.expr(STATUS).alias("status"))
    return current, manifest


@query(ACTION_SQL.format(retried="'error','failed','pending','markdown_only'", status=STATUS))
def w1_manifest_diff(spark, sf):
    """JON01, JON02, PRJ02, HSH01."""
    return I.manifest_diff(*_manifest(spark, sf))


@query(ACTION_SQL.format(retried="'error','failed','pending'", status=STATUS))
def w1_manifest_diff_video(spark, sf):
    """PRJ03."""
    return I.manifest_diff(*_manifest(spark, sf), retried=I.RETRIED_VIDEO)


@query(f"SELECT action AS outcome, CAST(count(*) AS BIGINT) AS n FROM ({ACTION_SQL.format(retried="'error','failed','pending','markdown_only'", status=STATUS)}) GROUP BY action")
def w1_run_counters(spark, sf):
    """AGG09."""
    return I.counters(w1_manifest_diff(spark, sf).withColumnRenamed("action", "outcome"))


@query("""SELECT doc_id AS key FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 11 = 0 AND doc_id % 4 = 0""")
def w1_orphans(spark, sf):
    """JON02: entries whose key isn't current and whose source (here: ids that 4 doesn't divide) is gone."""
    d = table(spark, sf, "documents")
    m = d.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("key"), F.col("doc_id").alias("source"))
    return I.orphans(m, d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("key")), d.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("source"))).select("key")


@query("""WITH o AS (SELECT o_custkey AS cust FROM orders GROUP BY 1 HAVING count(*) > 12)
SELECT DISTINCT key FROM (SELECT 'c' || cust AS key FROM o UNION ALL SELECT 'o' || o_orderkey FROM orders JOIN o ON o_custkey = cust)""")
def w1_orphan_children(spark, sf):
    """JON03, Q11, Q12: a customer is an archive, its orders are the children."""
    o = table(spark, sf, "orders")
    archives = o.groupBy(F.concat(F.lit("c"), "o_custkey").alias("key")).agg(F.collect_list(F.concat(F.lit("o"), "o_orderkey")).alias("archive_contents"))
    return I.orphan_closure(archives, archives.where(F.size("archive_contents") > 12))


@query("""WITH RECURSIVE o(key, n) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey IN (3, 5) UNION SELECT p_partkey, n + 1 FROM o JOIN part ON p_partkey // 2 = o.key AND p_partkey > 1) SELECT DISTINCT key FROM o""")
def w1_nested_orphans(spark, sf):
    """JON03: parts are archives in archives, to any depth; those of part 3 and 5 are gone."""
    p = table(spark, sf, "part").where("p_partkey > 1")
    m = p.groupBy(F.floor(F.col("p_partkey") / 2).cast("long").alias("key")).agg(F.collect_list("p_partkey").alias("archive_contents"))
    return I.orphan_closure(m, spark.createDataFrame([(3,), (5,)], "key long"), compat=True)


@query("""SELECT status, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN status IN ('complete','markdown_only','images_only') THEN 1 ELSE 0 END) AS BIGINT) AS succeeded FROM
(SELECT CASE WHEN l.doc_id IS NOT NULL AND n_chars >= 2000 THEN 'complete' WHEN l.doc_id IS NOT NULL THEN 'markdown_only' WHEN n_chars >= 2000 THEN 'images_only' ELSE 'failed' END AS status
 FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id) GROUP BY status""")
def w1_status_rollup(spark, sf):
    """PRJ04, PRJ07, AGG09."""
    l = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("has")).distinct()
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(l, "doc_id", "left")
    status = I.document_status(F.col("has").isNotNull(), F.col("n_chars") >= 2000)
    return d.groupBy(status.alias("status")).agg(F.count("*").alias("n")).withColumn("succeeded", F.when(I.is_success(F.col("status")), F.col("n")).otherwise(0))


@query("""SELECT conv_id, CASE WHEN u > 1 AND a > 1 THEN 'complete' WHEN u > 1 THEN 'vtt_only' WHEN a > 1 THEN 'images_only' ELSE 'failed' END AS status, CASE WHEN s > 0 THEN 'complete' ELSE 'empty' END AS archive
FROM (SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) u, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) a, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) s FROM conversations GROUP BY conv_id)""")
def w1_video_status(spark, sf):
    """PRJ05, PRJ06."""
    n = lambda r: F.count_if(F.col("role") == r)
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(n("user").alias("u"), n("assistant").alias("a"), F.collect_list(F.when(F.col("role") == "system", F.col("turn"))).alias("s"))
    return g.select("conv_id", I.video_status(F.col("u") > 1, F.col("a") > 1).alias("status"), I.archive_status(F.col("s")).alias("archive"))


@query("""WITH p AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS first, count(*) OVER (PARTITION BY conv_id) AS total FROM (SELECT DISTINCT conv_id, turn FROM conversations))
SELECT doc, first, least(first + 2, total) AS last, printf('p%03d-%03d', first, least(first + 2, total)) AS name FROM p WHERE first <= greatest(1, total - 2)""")
def w1_sliding_windows(spark, sf):
    """WIN01, STR07."""
    return I.sliding_windows(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page")))


@query("""SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY md5(text)) > 1 THEN substr(md5(source), 1, 6) || '-' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS display FROM documents""")
def w1_collision_names(spark, sf):
    """AGG12, STR06."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("stem"))
    return I.display_names(d, F.col("stem"), F.substring(F.md5("source"), 1, 6), F.col("doc_id").cast("string")).select("doc_id", "display")


@query("""SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(trim(' ' || c_name || ' / ' || c_mktsegment || ' - '), '[\\s/]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS prefix, lower(regexp_replace(c_mktsegment, '[^A-Za-z0-9]+', '-', 'g')) AS slug FROM customer""")
def w1_clean_prefix(spark, sf):
    """STR04, STR26."""
    raw = F.concat(F.lit(" "), "c_name", F.lit(" / "), "c_mktsegment", F.lit(" - "))
    return table(spark, sf, "customer").select("c_custkey", X.clean_prefix(raw).alias("prefix"), X.slug(F.col("c_mktsegment")).alias("slug"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages""")
def w1_html_text(spark, sf):
    """STR01, STR02."""
    return table(spark, sf, "pages").select("page_id", X.squeeze(X.strip_tags(F.col("html"))).alias("text"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages""")
def w1_link_edges(spark, sf):
    """GRF01: page to link target."""
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target"))


_PATHS = "CASE WHEN page_id % 5 = 0 THEN 'a/node_modules/' WHEN page_id % 7 = 0 THEN '__SPECS__/x/' WHEN page_id % 11 = 0 THEN 'a/.hidden/' ELSE 'docs/' END || page_id || CASE WHEN page_id % 3 = 0 THEN '.PDF' WHEN page_id % 3 = 1 THEN '.tar.gz' WHEN page_id % 2 = 0 THEN '.md' ELSE '.xlsx' END"


@query(f"""SELECT page_id, path, CASE WHEN path LIKE '%.tar.gz' THEN 'archive' WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN path LIKE '%.xlsx' THEN 'excel' END AS kind,
 path LIKE '%node_modules/%' OR path LIKE '%/.hidden/%' AS pruned, regexp_extract(path, '[^/]+$') AS name, CASE WHEN path LIKE '__SPECS__/%' THEN 'T2' END AS tier, CASE WHEN path LIKE 'docs/%' THEN substr(path, 6) ELSE regexp_extract(path, '[^/]+$') END AS key
FROM (SELECT page_id, {_PATHS} AS path FROM pages)""")
def w1_path_prune_classify(spark, sf):
    """SRC02, SRC04, SRC05, PRJ01, PRJ10, STR03."""
    p = table(spark, sf, "pages").select("page_id", F.expr(_PATHS).alias("path"))
    path = F.col("path")
    tier = R.default_tier(path, F.lit(None).cast("string"))["tier"]
    return p.select("page_id", "path", I.kind(path).alias("kind"), I.pruned(path).alias("pruned"), X.basename(path).alias("name"), tier.alias("tier"), I.manifest_key(path, F.lit("docs/")).alias("key"))


@query("""SELECT o_custkey, array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 3), ',') AS listed, CAST(greatest(0, count(*) - 3) AS BIGINT) AS more FROM orders GROUP BY o_custkey""")
def w1_index_listing(spark, sf):
    """SNK03, LIM01."""
    rows = I.index_listing(table(spark, sf, "orders"), "o_custkey", "o_orderkey")
    return rows.select("o_custkey", F.array_join(F.col("listed").cast("array<string>"), ",").alias("listed"), "more")


@query("SELECT DISTINCT source AS key FROM documents UNION SELECT DISTINCT lang FROM documents")
def w1_current_keys(spark, sf):
    """SET01, SET02."""
    d = table(spark, sf, "documents")
    return I.current_keys(d.select(F.col("source").alias("key")), d.select(F.col("lang").alias("key")))


_STEMS = "SELECT s_nationkey % 5 AS dir, repeat('lecture ' || n_name || ' ', 4) || s_suppkey % 7 AS stem, n_name, s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey"


@query(f"""WITH v AS (SELECT dir, CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE stem END AS stem FROM ({_STEMS})), s AS (SELECT dir, CASE WHEN s_suppkey % 2 = 0 THEN n_name || '.en' ELSE stem END AS stem FROM ({_STEMS}))
SELECT DISTINCT v.dir, v.stem AS video, s.stem AS subtitle FROM v JOIN s ON v.dir = s.dir AND (v.stem = s.stem OR starts_with(s.stem, substr(v.stem, 1, 40)))""")
def w1_subtitle_companions(spark, sf):
    """SRC22: videos and subtitles named after a supplier's nation, with long and with short stems."""
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    stem = F.concat(F.repeat(F.concat(F.lit("lecture "), "n_name", F.lit(" ")), F.lit(4)), (F.col("s_suppkey") % 7).cast("string"))
    rows = rows.select((F.col("s_nationkey") % 5).alias("dir"), "s_suppkey", "n_name", stem.alias("stem"))
    videos = rows.select("dir", F.when(F.col("s_suppkey") % 3 == 0, F.col("n_name")).otherwise(F.col("stem")).alias("stem"))
    return I.companions(videos, rows.select("dir", F.when(F.col("s_suppkey") % 2 == 0, F.concat("n_name", F.lit(".en"))).otherwise(F.col("stem")).alias("stem")))


@query("""SELECT d.doc_id AS video FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def w1_missing_transcripts(spark, sf):
    """JON11, SRC24."""
    l = table(spark, sf, "labels")
    side = lambda c: l.where(f"{c} = 1").select(F.col("doc_id").alias("video"))
    return I.missing_transcripts(table(spark, sf, "documents").select(F.col("doc_id").alias("video")), side("quality"), side("toxic"))


@query("""SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'manual' WHEN quality = 1 THEN 'fragment' WHEN doc_id % 2 = 0 THEN 'generate' ELSE 'none' END AS source FROM labels""")
def w1_transcript_order(spark, sf):
    """UDF13, UDF14."""
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, sf, "labels").select("doc_id", I.transcript_source(q & t, q, F.expr("doc_id % 2 = 0")).alias("source"))


_STYLES = "['ellipse;cylinder', 'rhombus;cloud', 'shape=diamond', 'ellipse;cloud', 'cloud;x', 'shape=mxgraph.aws4.ec2', 'shape=mxgraph.azure.vm', 'edgeStyle=x', 'edgeLabel', 'rounded=1']"
_SHAPES = "['database', 'decision', 'decision', 'actor', 'cloud', 'cloud-service', 'cloud-service', 'component', 'component', 'component']"


@query(f"""SELECT p_partkey, {_SHAPES}[1 + p_size % 10] AS shape, p_size % 10 = 7 OR p_size > 40 AS is_edge, p_size % 10 = 8 OR p_size = 7 AS is_label FROM part""")
def w1_shapes(spark, sf):
    """PRJ12-PRJ14: a part's size stands in for attributes; a style for each shape, and some that hold two parts."""
    size = F.col("p_size")
    p = table(spark, sf, "part").withColumn("style", F.get(F.expr("array" + _STYLES.replace("[", "(").replace("]", ")")), (size % 10).cast("int")))
    return p.select("p_partkey", K.shape(F.col("style")).alias("shape"), K.edge_is(F.col("style"), F.when(size > 40, "1"), F.lit(None), F.lit(None)).alias("is_edge"), K.edge_label_is(F.col("style"), F.when(size == 7, "0")).alias("is_label"))


def _diagram(spark, sf):
    """Nations are nodes (every sixth without a label), suppliers edges with missing or unknown ends; some edges look like labels. Labels stand on edges, and on nodes, where they are nodes."""
    null = F.lit(None).cast("string")
    cell = lambda pos, id, value, style=null, source=null, target=null, parent=null, connectable=null: [F.lit("f").alias("file"), F.lit("d").alias("diagram"), pos.cast("int").alias("pos"), id.alias("id"), value.alias("value"), style.alias("style"), source.alias("source"), target.alias("target"), parent.alias("parent"), null.alias("edge"), connectable.alias("connectable")]
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    key, at, nation = F.col("s_suppkey"), F.col("s_nationkey"), F.col("n_nationkey")
    other = F.when(key % 3 == 0, null).when(key % 3 == 1, "n99").otherwise(F.concat(F.lit("n"), (at * 7 % 25).cast("string")))
    style = F.get(F.array(*[F.lit(x) for x in ("ellipse", "cylinder", "diamond", "cloud", "x")]), (nation % 5).cast("int"))
    nodes = n.select(*cell(nation, F.concat(F.lit("n"), nation), F.when(nation % 6 != 5, F.concat(F.lit("<b>"), "n_name", F.lit("</b>"))), style))
    edges = s.select(*cell(key, F.concat(F.lit("e"), "s_suppkey"), F.when(key % 2 == 0, "own"), F.lit("edgeStyle=a"), F.concat(F.lit("n"), "s_nationkey"), other, connectable=F.when(key % 5 == 0, "0")))
    mark = lambda off, text: s.where("s_suppkey % 4 = 0").select(*cell(key + off, F.concat(F.lit(f"l{off}-"), "s_suppkey"), F.lit(text), F.lit("edgeLabel"), parent=F.concat(F.lit("e"), "s_suppkey"), connectable=F.lit("0")))
    loose = n.select(*cell(nation + 3_000_000, F.concat(F.lit("k"), nation), F.lit("note"), F.lit("edgeLabel"), parent=F.concat(F.lit("n"), nation), connectable=F.lit("0")))
    root = spark.createDataFrame([("f", "d", -1, "0")], "file string, diagram string, pos int, id string").select("file", "diagram", "pos", "id", *[null.alias(c) for c in ("value", "style", "source", "target", "parent", "edge", "connectable")])
    return root.unionByName(nodes).unionByName(edges).unionByName(mark(1_000_000, "first")).unionByName(mark(2_000_000, "second")).unionByName(loose)


@query("""WITH n AS (SELECT n_nationkey AS id, n_name AS label FROM nation WHERE n_nationkey % 6 <> 5), e AS (SELECT s_suppkey AS id, s_nationkey AS a, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 99 ELSE (s_nationkey * 7) % 25 END AS b FROM supplier)
SELECT 'f' AS file, 'd' AS diagram, 'e' || e.id AS edge_id, CASE WHEN e.id % 4 = 0 THEN 'second' WHEN e.id % 2 = 0 THEN 'own' END AS label, coalesce(x.label, 'n' || e.a, '?') AS source, coalesce(y.label, 'n' || e.b, '?') AS target
FROM e LEFT JOIN n x ON x.id = e.a LEFT JOIN n y ON y.id = e.b""")
def w1_diagram_edges(spark, sf):
    """GRF01, JON04, JON05, PRJ13-PRJ15."""
    return K.diagram_edges(_diagram(spark, sf))


@query("""SELECT 'f' AS file, 'd' AS diagram, 'n' || n_nationkey AS id, n_name AS label, ['actor', 'database', 'decision', 'cloud', 'component'][1 + n_nationkey % 5] AS shape FROM nation WHERE n_nationkey % 6 <> 5
UNION ALL SELECT 'f', 'd', 'k' || n_nationkey, 'note', 'component' FROM nation""")
def w1_diagram_nodes(spark, sf):
    """GRF01, PRJ12, PRJ15: labels of nodes are nodes themselves, cells without a label aren't."""
    return K.diagram_nodes(_diagram(spark, sf)).drop("pos")
