"""Queries of validation, quality and presentation (W4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions import values as V
from tessella.operators import validate as C
from tessella.plans.registry import query, table

_ISSUES = "(CASE WHEN n_chars * 20 < 10240 THEN 1 ELSE 0 END + CASE WHEN n_chars * 20 > 20971520 THEN 1 ELSE 0 END + CASE WHEN least(n_chars, 300) < 100 THEN 1 ELSE 0 END + CASE WHEN greatest(n_chars, 300) > 8192 THEN 1 ELSE 0 END)"


def _images(spark, sf):
    d = table(spark, sf, "documents")
    return C.verify_images(d.select("doc_id", "source", (F.col("n_chars") * 20).alias("size_bytes"), F.col("n_chars").alias("width"), F.lit(300).cast("long").alias("height"), (F.col("doc_id") % 23 != 0).alias("readable")))


@query(f"SELECT doc_id, CAST({_ISSUES} AS BIGINT) AS n_issues, CAST(CASE WHEN greatest(n_chars, 300) > 4096 THEN 1 ELSE 0 END AS BIGINT) AS n_warnings, {_ISSUES} = 0 AND doc_id % 23 <> 0 AS suitable FROM documents")
def w4_suitability(spark, sf):
    """PRJ16, Q22: lengths stand in for bytes and pixels."""
    return _images(spark, sf).select("doc_id", F.size("issues").cast("long").alias("n_issues"), F.size("warnings").cast("long").alias("n_warnings"), "suitable")


@query(f"""SELECT source, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (ok) AS BIGINT) AS suitable, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS issues, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS success
FROM (SELECT source, {_ISSUES} = 0 AND doc_id % 23 <> 0 AS ok FROM documents) GROUP BY source""")
def w4_image_summary(spark, sf):
    """AGG10, AGG11, SNK05."""
    return C.image_summary(_images(spark, sf), "source").withColumn("success", F.round("success", 6))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative_balance' WHEN c_mktsegment = 'BUILDING' THEN 'segment' WHEN length(c_name) > 18 THEN 'name_long' ELSE 'valid' END AS verdict FROM customer""")
def w4_validation_first_error(spark, sf):
    """PRJ17."""
    return table(spark, sf, "customer").select("c_custkey", C.first_error((F.col("c_acctbal") < 0, "negative_balance"), (F.col("c_mktsegment") == "BUILDING", "segment"), (F.length("c_name") > 18, "name_long")).alias("verdict"))


_NAME = "CASE WHEN p_size % 6 = 0 THEN upper(p_name) WHEN p_size % 6 = 1 THEN '-' || replace(p_name, ' ', '-') WHEN p_size % 6 = 2 THEN repeat('a', 65) ELSE lower(replace(p_name, ' ', '-')) END"


@query(f"""SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'unexpected_keys' WHEN p_size % 7 = 0 THEN 'missing_description' WHEN name <> '' AND NOT regexp_matches(name, '^[a-z0-9-]+$') THEN 'name_not_kebab' WHEN regexp_matches(name, '^-|-$|--') THEN 'name_hyphens'
 WHEN length(name) > 64 THEN 'name_too_long' WHEN p_size % 5 = 0 THEN 'description_brackets' ELSE 'valid' END AS error FROM (SELECT p_partkey, p_size, {_NAME} AS name FROM part)""")
def w4_frontmatter_rules(spark, sf):
    """PRJ17, STR17: front matter made of a part's name and size."""
    entry = lambda cond, k, v: F.when(cond, F.create_map(F.lit(k), v)).otherwise(F.create_map().cast("map<string,string>"))
    n = F.col("p_size")
    matter = F.map_concat(F.create_map(F.lit("name"), F.expr(_NAME)), entry(n % 7 != 0, "description", F.when(n % 5 == 0, "a <b>").otherwise("plain")), entry(n % 11 == 0, "extra", F.lit("x")))
    return table(spark, sf, "part").select("p_partkey", C.frontmatter_error(matter).alias("error"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS run_id, d.n_chars AS output, l.feedback FROM (SELECT doc_id, n_chars FROM documents WHERE n_chars > 1000) d FULL JOIN (SELECT doc_id, 'quality ' || quality AS feedback FROM labels WHERE doc_id % 3 <> 0) l ON d.doc_id = l.doc_id")
def w4_feedback_merge(spark, sf):
    """JON10, SNK08."""
    runs = table(spark, sf, "documents").where("n_chars > 1000").select(F.col("doc_id").alias("run_id"), F.col("n_chars").alias("output"))
    words = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("quality "), "quality")).otherwise(" \n")
    return C.merge_feedback(runs, table(spark, sf, "labels").select(F.col("doc_id").alias("run_id"), words.alias("feedback")))


@query("SELECT day(ts) AS day, " + ", ".join(f"CAST(nullif(count(*) FILTER (event_type = '{t}'), 0) AS BIGINT) AS \"{t}\"" for t in ("click", "purchase", "view")) + " FROM events GROUP BY 1")
def w4_pivot_report(spark, sf):
    """SNK06, JON09."""
    e = table(spark, sf, "events").select(F.dayofmonth("ts").cast("long").alias("day"), "event_type")
    return C.pivot_report(e, "day", "event_type", ["click", "purchase", "view"], F.count(F.lit(1)))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def w4_html_escape(spark, sf):
    """STR14."""
    return table(spark, sf, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"))


@query("SELECT page_id, replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/', '-') AS run_id FROM pages")
def w4_run_id(spark, sf):
    """STR11."""
    return table(spark, sf, "pages").select("page_id", X.run_id(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")).alias("run_id"))


_FILES = "['a.svg', 'b.PDF', 'c.xlsx', 'd.py', 'e.zzz', 'noext', 'f.js', 'g.css', 'h.csv', 'i.xml', 'j.md', 'k.html', 'l.json', 'm.tar.gz', 'n.docx', 'o.webp', 'p.txt', 'q.tgz', 'r.pptx', 's.sh']"
_MIMES = """['image/svg+xml', 'application/pdf', 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'text/x-python', 'application/octet-stream', 'application/octet-stream', 'text/javascript', 'text/css', 'text/csv', 'text/xml', 'text/markdown', 'text/html', 'application/json',
 'application/x-tar', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'image/webp', 'text/plain', 'application/x-tar', 'application/vnd.openxmlformats-officedocument.presentationml.presentation', 'application/x-sh']"""
_KINDS = "['image', 'pdf', 'xlsx', 'text', 'binary', 'binary', 'text', 'text', 'text', 'text', 'text', 'text', 'text', 'binary', 'binary', 'image', 'text', 'binary', 'binary', 'text']"


@query(f"""SELECT p_partkey, {_MIMES}[1 + p_partkey % 20] AS mime, {_KINDS}[1 + p_partkey % 20] AS kind, CASE p_partkey % 20 WHEN 5 THEN 'noext' WHEN 13 THEN 'm.tar' ELSE substr({_FILES}[1 + p_partkey % 20], 1, 1) END AS stem FROM part""")
def w4_media_types(spark, sf):
    """STR03, STR12, SRC20."""
    f = F.get(F.expr("array" + _FILES.replace("[", "(").replace("]", ")")), (F.col("p_partkey") % 20).cast("int"))
    return table(spark, sf, "part").select("p_partkey", C.media_type(f).alias("mime"), C.embed_kind(f).alias("kind"), X.stem(f).alias("stem"))


@query("SELECT doc_id, 'data:text/plain;base64,' || to_base64(encode(text)) AS uri FROM documents")
def w4_data_uri(spark, sf):
    """STR13."""
    return table(spark, sf, "documents").select("doc_id", X.data_uri(F.lit("text/plain"), F.encode("text", "UTF-8")).alias("uri"))


_PACKAGED = "CASE p_size % 6 WHEN 0 THEN 'pkg/evals/x.json' WHEN 1 THEN 'pkg/sub/evals/x.json' WHEN 2 THEN 'pkg/__pycache__/x.py' WHEN 3 THEN 'pkg/m.pyc' WHEN 4 THEN 'pkg/.DS_Store' ELSE 'pkg/SKILL.md' END"


@query("SELECT p_partkey, p_size % 6 IN (0, 2, 3, 4) AS left_out FROM part")
def w4_package_filter(spark, sf):
    """PRJ18, SNK09."""
    return table(spark, sf, "part").select("p_partkey", C.left_out_of_package(F.expr(_PACKAGED)).alias("left_out"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN role = 'user' THEN role ELSE 'none' END AS prompt FROM conversations")
def w4_prompt_lookup(spark, sf):
    """SRC19, SRC23, WIN05."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", C.first_text(F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(" \n"), F.when(F.col("role") == "user", F.col("role")), F.lit("none")).alias("prompt"))


@query("""SELECT page_id, trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS heading FROM pages""")
def w4_tagged_text(spark, sf):
    """STR15."""
    return table(spark, sf, "pages").select("page_id", X.tagged(F.col("html"), "h1").alias("heading"))


@query("""SELECT doc_id, coalesce(lang, 'T3') AS tier, 'llm' AS source_class, CAST(2 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_keys FROM documents""")
def w4_additive_merge(spark, sf):
    """MAP02, SET03, Q15: existing keys keep their values."""
    have = F.map_concat(F.create_map(F.lit("tier"), F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("own"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>")))
    merged = V.merge_missing(have, F.create_map(*[F.lit(x) for x in ("tier", "T3", "source_class", "llm")]))
    return table(spark, sf, "documents").select("doc_id", merged["tier"].alias("tier"), merged["source_class"].alias("source_class"), F.size(merged).cast("long").alias("n_keys"))


@query("""WITH a AS (SELECT DISTINCT doc_id AS doc, unnest(regexp_split_to_array(lower(text), '[^\\w]+')) AS term FROM documents), b AS (SELECT DISTINCT item_id AS doc, unnest(regexp_split_to_array(lower(text), '[^\\w]+')) AS term FROM benchmark),
g AS (SELECT doc, term, 'first' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT doc, term, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
SELECT doc, only_in, CAST(count(*) AS BIGINT) AS n FROM g WHERE term <> '' GROUP BY doc, only_in""")
def w4_converter_gaps(spark, sf):
    """JON21: documents and benchmark items stand in for two converters of the files that their ids name; whole tables, whole texts, both directions."""
    side = lambda name, id: table(spark, sf, name).select(F.col(id).alias("doc"), "text")
    return C.converter_gaps(side("documents", "doc_id"), side("benchmark", "item_id")).groupBy("doc", "only_in").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS number, 'B' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS id FROM orders""")
def w4_question_order(spark, sf):
    """WIN11, PRJ47."""
    rows = C.numbered(table(spark, sf, "orders"), "o_custkey", F.col("o_orderpriority"), F.lit("B"), "o_orderkey")
    return rows.select("o_custkey", "o_orderkey", F.col("number").cast("long").alias("number"), "id")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k') IS NOT NULL, false) AS has_k FROM events")
def w4_valid_json(spark, sf):
    """JSN01."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").isNotNull().alias("has_k"))


@query("SELECT event_id, event_id % 4 IN (0, 3) AS valid FROM events")
def w4_feedback_body(spark, sf):
    """SNK08: bodies that are objects with reviews, lists, without reviews, and with an empty list of them."""
    body = F.get(F.array(F.concat(F.lit('{"reviews": ['), "props", F.lit("]}")), F.concat(F.lit('[{"reviews": '), "props", F.lit("}]")), F.concat(F.lit('{"review": '), "props", F.lit("}")), F.lit(' {"reviews": []}')), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf, "events").select("event_id", C.valid_feedback(body).alias("valid"))


@query("SELECT o_orderkey AS run_id, CAST(CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS BIGINT) AS eval_id, row_number() OVER (ORDER BY CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END NULLS LAST, o_orderkey) AS place FROM orders")
def w4_run_order(spark, sf):
    """SRT02: places of runs by eval id, those without one last; the report's order, numbered within ranges and moved on by the rows of the ranges before."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).cast("long").alias("eval_id"))
    return C.placed_runs(o)
