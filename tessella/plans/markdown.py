"""Queries of Markdown parsing and formatting. The driver's tables hold no Markdown, so it is built from their rows; the SQL states what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions import values as V
from tessella.operators import evals as E
from tessella.operators import ingest as I
from tessella.operators import proposal as P
from tessella.operators import rules as R
from tessella.operators import validate as C
from tessella.plans.registry import query, table
from tessella.sources import files as S
from tessella.streaming import events as T


def _concat(*parts):
    return F.concat(*[p if not isinstance(p, str) or p.startswith(("c_", "o_", "p_", "n_", "s_")) else F.lit(p) for p in parts])


@query("""SELECT c_custkey, 'fact' AS category, c_name AS statement, lower(c_mktsegment) AS tag, CAST(2 AS BIGINT) AS n FROM customer""")
def w5_observations(spark, sf):
    """STR18."""
    t = _concat("# x\n- [fact] ", "c_name", " #", F.lower("c_mktsegment"), "\nno line\n- [risk] slow")
    o = table(spark, sf, "customer").select("c_custkey", X.observations(t).alias("o"))
    return o.select("c_custkey", F.col("o")[0]["category"].alias("category"), F.col("o")[0]["statement"].alias("statement"), F.col("o")[0]["tags"][0].alias("tag"), F.size("o").cast("long").alias("n"))


@query("SELECT c_custkey, 'requires' AS relation, 'Procedure' AS kind, c_name AS name FROM customer")
def w5_wiki_links(spark, sf):
    """STR19."""
    t = _concat("- requires [[Procedure - ", "c_name", "]] # later\n- see [[broken]]")
    return table(spark, sf, "customer").select("c_custkey", F.explode(X.wiki_links(t)).alias("x")).select("c_custkey", "x.*")


@query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS rev, o_orderdate AS at, o_orderpriority AS note FROM orders")
def w5_revision_lines(spark, sf):
    """STR20, DAT03."""
    t = _concat("- [r", F.col("o_custkey").cast("string"), "] ", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), " — ", "o_orderpriority")
    x = table(spark, sf, "orders").select("o_orderkey", F.explode(X.revisions(t)).alias("x"))
    return x.select("o_orderkey", F.col("x.rev").cast("long").alias("rev"), F.col("x.at").cast("timestamp_ntz").alias("at"), "x.note")


@query("SELECT n_nationkey, n_name AS source, 'T' || (1 + n_nationkey % 4) AS tier, n_name || ' grows' AS claim, 'u' || n_nationkey AS url FROM nation")
def w5_citations(spark, sf):
    """STR21."""
    tier = F.concat(F.lit("T"), (F.col("n_nationkey") % 4 + 1).cast("string"))
    t = F.concat(F.lit("It does (Source: "), "n_name", F.lit(", "), tier, F.lit(")."))
    u = F.concat("n_name", F.lit(" grows — [a]("), F.lit("u"), F.col("n_nationkey").cast("string"), F.lit(")"))
    return table(spark, sf, "nation").select("n_nationkey", X.citations(t)[0].alias("c"), X.cited_claims(u)[0].alias("d")).select("n_nationkey", "c.source", "c.tier", "d.claim", "d.url")


@query("SELECT s_suppkey, 'AR-' || s_suppkey AS id, s_name AS text, 'law' AS source, 'fine' AS consequence FROM supplier")
def w5_anti_requirements(spark, sf):
    """STR22."""
    t = _concat("- [AR-", F.col("s_suppkey").cast("string"), "]: ", "s_name", " | Source: law | Consequence: fine")
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(X.anti_requirements(t)).alias("x")).select("s_suppkey", "x.*")


_ID = "CASE p_size % 5 WHEN 0 THEN 'FR-AUTH-0' || p_size % 10 WHEN 1 THEN 'NFR-0' || p_size % 10 WHEN 2 THEN 'CON-0' || p_size % 10 WHEN 3 THEN 'AMB-1' ELSE p_name END"


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'FR' WHEN 1 THEN 'NFR' WHEN 2 THEN 'CTR' END AS kind FROM part")
def w5_requirement_ids(spark, sf):
    """STR23."""
    return table(spark, sf, "part").select("p_partkey", X.requirement_kind(F.expr(_ID)).alias("kind"))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS defends, c_custkey % 3 = 1 AS hedges, 'HANDOFF' AS kind, c_name AS payload, CASE c_custkey % 3 WHEN 0 THEN 'file_flag' WHEN 1 THEN 'path' ELSE 'topic' END AS argument FROM customer")
def w5_markers(spark, sf):
    """STR24, STR25, STR26."""
    k = F.col("c_custkey") % 3
    said = F.when(k == 0, "This is Correct because x").when(k == 1, "you could consider y").otherwise("z")
    crumb = X.breadcrumbs(_concat("<!-- HANDOFF: ", "c_name", " -->"))[0]
    arg = F.when(k == 0, "--file x.md").when(k == 1, "a/b").otherwise("topic")
    return table(spark, sf, "customer").select("c_custkey", X.has_any(said, X.DEFENSE).alias("defends"), X.has_any(said, X.HEDGES).alias("hedges"), crumb["kind"].alias("kind"), crumb["payload"].alias("payload"), X.argument_kind(arg).alias("argument"))


@query("SELECT c_custkey, 'in 2026 ' || c_name AS query, c_name || ' notes' AS described, c_name AS prompt FROM customer")
def w4_small_texts(spark, sf):
    """STR16, STR28, STR29."""
    prompt = X.transcript_prompt(_concat("# t\n## Eval Prompt\n\n", "c_name", "\n## Next\n"))
    return table(spark, sf, "customer").select("c_custkey", X.with_year(_concat("in {current_year} ", "c_name"), F.lit(2026)).alias("query"), X.default_description(_concat("a/", "c_name", "_notes.md")).alias("described"), prompt.alias("prompt"))


@query("SELECT c_custkey, c_name AS name, lower(c_mktsegment) AS segment, CAST(2 AS BIGINT) AS n, '---' || chr(10) || 'tier: T2' || chr(10) || '---' || chr(10) || chr(10) || c_name AS fragment, c_name || ' and more' AS folded FROM customer")
def w4_frontmatter(spark, sf):
    """SRC14, SRC15, SNK02, PRJ09. Rows are dear and their file small, so they are dealt out first."""
    text = _concat("---\nname: ", "c_name", "\nsegment: '", F.lower("c_mktsegment"), "'\n# note\n---\nbody: x")
    folded = _concat("---\nname: x\ndescription: >\n  ", "c_name", "\n  and more\n---\n")
    d = S.frontmatter_blocks(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition("c_custkey").select("c_custkey", "c_name", S.frontmatter(text).alias("m"), folded.alias("text")).withColumnRenamed("c_name", "who"))
    return d.select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"), F.size("m").cast("long").alias("n"), I.fragment(F.create_map(F.lit("tier"), F.lit("T2")), F.col("who")).alias("fragment"), F.col("description").alias("folded"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'Red' WHEN 2 THEN 'Acme-Inc' ELSE 'team' END AS prefix FROM customer")
def w1_partner_prefix(spark, sf):
    """STR05."""
    k = F.col("c_custkey") % 4
    path = F.when(k == 0, _concat("r/11-journey/US/", "c_mktsegment", "/x.pdf")).when(k == 1, "r/11-journey/Red/x.pdf").when(k == 2, "r/Acme Inc/docs/x.pdf").otherwise("r/team/notes/x.pdf")
    return table(spark, sf, "customer").select("c_custkey", X.partner_prefix(path, "journey", ["US"], ["acme"], ["docs", "notes"]).alias("prefix"))


@query("SELECT o_orderkey, printf('%+.0f', CAST(o_orderkey - 500 AS DOUBLE)) AS delta, printf('%03d', o_orderkey % 1000) AS number FROM orders")
def w2_formats(spark, sf):
    """STR07, STR08: whole numbers, whose rounding no dialect disputes."""
    return table(spark, sf, "orders").select("o_orderkey", X.signed(F.col("o_orderkey") - 500, 0).alias("delta"), F.format_string("%03d", (F.col("o_orderkey") % 1000).cast("int")).alias("number"))


@query("SELECT event_type AS query, CAST(max(event_id) AS BIGINT) % 2 = 0 AS label FROM events GROUP BY event_type")
def w3_latest_label(spark, sf):
    """SET08."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("query"), (F.col("event_id") % 2 == 0).alias("label"), "event_id")
    return E.latest_label(e, "query", "label", "event_id")


@query("SELECT CAST(user_id AS VARCHAR) AS trial_id, arg_min(event_type, event_id) = 'purchase' AS triggered FROM events GROUP BY user_id")
def w3_stream_decision(spark, sf):
    """STM02, SRC18, JSN02: a user's events become NDJSON lines; the first tool decides."""
    line = lambda **f: F.to_json(F.struct(F.lit("stream_event").alias("type"), F.struct(*[v.alias(k) for k, v in f.items()]).alias("event")))
    e = table(spark, sf, "events")
    start = e.select(F.col("user_id").cast("string").alias("trial_id"), (F.col("event_id") * 3).alias("seq"), line(type=F.lit("content_block_start"), content_block=F.struct(F.lit("tool_use").alias("type"), F.col("event_type").alias("name"))).alias("line"))
    piece = lambda n, text: e.select(F.col("user_id").cast("string").alias("trial_id"), (F.col("event_id") * 3 + n).alias("seq"), line(type=F.lit("content_block_delta"), delta=F.struct(F.lit("x").alias("type"), F.lit(text).alias("partial_json"))).alias("line"))
    bad = e.select(F.col("user_id").cast("string").alias("trial_id"), (F.col("event_id") * 3 - 1).alias("seq"), F.lit("{oops").alias("line"))
    return T.decide(T.parse(start.unionByName(piece(1, '{"skill": "my-')).unionByName(piece(2, 'tool"}')).unionByName(bad)), "my-tool", ("purchase",))


@query("SELECT page_id, sha256(html) AS hash, CASE WHEN page_id % 3 = 0 THEN 'team' ELSE substr(md5('docs/' || page_id % 5), 1, 6) END || '-' || page_id || '.pdf' AS display FROM pages")
def w1_hashes(spark, sf):
    """HSH01, HSH02, STR06."""
    path = F.concat(F.lit("docs/"), (F.col("page_id") % 5).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".pdf"))
    return table(spark, sf, "pages").select("page_id", V.content_hash(F.col("html")).alias("hash"), X.unique_name(path, F.when(F.col("page_id") % 3 == 0, "team")).alias("display"))


@query("SELECT doc_id FROM documents WHERE source = 'src1'")
def w1_pick_named(spark, sf):
    """PRJ08: documents of the name win over archives of that name."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("name"))
    return I.pick_named(d, d, "src1").select("doc_id")


@query("SELECT conv_id, turn, lower(trim(text)) AS query FROM conversations WHERE trim(text) <> ''")
def w4_export_evals(spark, sf):
    """SNK10, SRT03."""
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("position"), "turn", F.lower("text").alias("query"), (F.col("role") == "user").alias("should_trigger"))
    return C.export_evals(c).select("conv_id", "turn", "query")


@query("""SELECT conv_id AS "round", count(*) FILTER (role = 'user') = count(*) OR max(conv_id) >= 50 AS over FROM conversations GROUP BY conv_id""")
def w5_round_over(spark, sf):
    """PRJ39."""
    s = table(spark, sf, "conversations").select(F.col("conv_id").alias("round"), F.when(F.col("role") == "user", "HELD").alias("signal"))
    return R.round_over(s, 50)


@query("SELECT path, len(string_split(text, chr(10))) > 500 AS long, array_to_string(list_filter(['quick', 'degradation'], lambda s: NOT regexp_matches(text, '(?im)^#+ .*' || s)), ',') AS missing FROM (SELECT doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN '# Quick start' || chr(10) ELSE '' END || text AS text FROM documents)")
def w5_skill_audit(spark, sf):
    """PRJ53."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.concat(F.when(F.col("doc_id") % 2 == 0, "# Quick start\n").otherwise(""), "text").alias("text"))
    return C.skill_audit(d, ("quick", "degradation")).select("path", "long", F.array_join("missing", ",").alias("missing"))


@query("SELECT DISTINCT source AS concern FROM documents UNION SELECT DISTINCT event_type FROM events")
def w5_saturation_merge(spark, sf):
    """SET07."""
    a = table(spark, sf, "documents").select(F.col("source").alias("concern"))
    return P.merged_concerns(a, table(spark, sf, "events").select(F.col("event_type").alias("concern")))
