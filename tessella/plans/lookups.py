"""Queries of the rule tables (W5): a part's number stands in for the key, so that each row of a table, and a key that it lacks, occurs. The SQL states the tables' values itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import rules as R
from tessella.operators import validate as C
from tessella.plans.registry import query, table


def _keys(spark: SparkSession, sf: str, name: str, *keys: str) -> DataFrame:
    """p_partkey and one of the keys, or one that no table has."""
    options = F.array(*[F.lit(k) for k in (*keys, "unheard of")])
    return table(spark, sf, "part").select("p_partkey", F.get(options, (F.col("p_partkey") % (len(keys) + 1)).cast("int")).alias(name))


@query("""SELECT p_partkey, ['simple', 'complicated', 'complex', 'chaotic', 'unheard of'][1 + p_partkey % 5] AS domain, ['L0-L2', 'L0-L3', 'L0-L4', 'L0-L4 + consequences', 'N/A'][1 + p_partkey % 5] AS depth FROM part""")
def w5_domain_depths(spark, sf):
    """PRJ32."""
    keys = _keys(spark, sf, "domain", "simple", "complicated", "complex", "chaotic")
    return R.framework(keys, R.dimension(spark, R.DEPTHS, "domain string, depth string"), "domain", "depth")


@query("""SELECT p_partkey, ['slide decks', 'spreadsheets', 'requirements', 'supporting', 'architecture', 'unheard of'][1 + p_partkey % 6] AS content, CAST([4, 3, 1, 5, 2, NULL][1 + p_partkey % 6] AS BIGINT) AS priority, ['both converters and images', 'one converter', 'full read', 'targeted read', 'targeted read and images', 'N/A'][1 + p_partkey % 6] AS reading FROM part""")
def w5_fragment_priorities(spark, sf):
    """PRJ33."""
    keys = _keys(spark, sf, "content", "slide decks", "spreadsheets", "requirements", "supporting", "architecture")
    return R.framework(keys, R.dimension(spark, R.PRIORITIES, "content string, priority long, reading string"), "content", "reading")


@query("""SELECT p_partkey, ['Narrative', 'Fact', 'Ontology', 'Concept', 'Procedure', 'unheard of'][1 + p_partkey % 6] AS artifact, ['immutable', 'revision', 'revision', 'revision', 'revision', 'N/A'][1 + p_partkey % 6] AS strategy FROM part""")
def w5_revision_strategies(spark, sf):
    """PRJ34."""
    keys = _keys(spark, sf, "artifact", "Narrative", "Fact", "Ontology", "Concept", "Procedure")
    return R.framework(keys, R.dimension(spark, R.STRATEGIES, "artifact string, strategy string"), "artifact", "strategy")


@query("""SELECT p_partkey, ['maximum', 'quick', 'deep', 'standard', 'unheard of'][1 + p_partkey % 5] AS depth, CAST([5, 1, 5, 3, NULL][1 + p_partkey % 5] AS BIGINT) AS queries_from, CAST([8, 2, 8, 5, NULL][1 + p_partkey % 5] AS BIGINT) AS queries_to,
 CAST([NULL, 1, 3, 2, NULL][1 + p_partkey % 5] AS BIGINT) AS rounds_from, CAST([NULL, 1, 5, 3, NULL][1 + p_partkey % 5] AS BIGINT) AS rounds_to, CAST([10, 7, 10, 7, 0][1 + p_partkey % 5] AS BIGINT) AS agents FROM part""")
def w5_depth_rows(spark, sf):
    """PRJ38: rounds go on until convergence where they are null."""
    keys = _keys(spark, sf, "depth", "maximum", "quick", "deep", "standard")
    return R.framework(keys, R.dimension(spark, R.DEPTH_ROWS, "depth string, queries_from long, queries_to long, rounds_from long, rounds_to long, agents long"), "depth", "agents", 0)


@query("""SELECT p_partkey, ['chaotic', 'simple', 'complex', 'complicated', 'unheard of'][1 + p_partkey % 5] AS domain, ['Narrative', 'Fact,Procedure', 'Concept,Narrative', 'Procedure,Concept', NULL][1 + p_partkey % 5] AS artifacts, ['act', 'categorize', 'probe', 'analyze', 'N/A'][1 + p_partkey % 5] AS approach FROM part""")
def w5_domain_artifacts(spark, sf):
    """PRJ41."""
    keys = _keys(spark, sf, "domain", "chaotic", "simple", "complex", "complicated")
    return R.framework(keys, R.dimension(spark, R.ARTIFACTS, "domain string, artifacts string, approach string"), "domain", "approach")


@query("""SELECT p_partkey, ['mixed', 'transcript', 'product brief', 'specification', 'repository', 'unheard of'][1 + p_partkey % 6] AS input, ['each source by itself', 'statements and hedges', 'text and signals', 'normative sections', 'files beyond the readme', 'N/A'][1 + p_partkey % 6] AS sources FROM part""")
def w5_input_types(spark, sf):
    """PRJ44."""
    keys = _keys(spark, sf, "input", "mixed", "transcript", "product brief", "specification", "repository")
    return R.framework(keys, R.dimension(spark, R.INPUTS, "input string, sources string"), "input", "sources")


@query("""SELECT p_partkey, ['eu data processing', 'pharma', 'general software', 'medical devices', 'healthcare data', 'financial systems', 'unheard of'][1 + p_partkey % 7] AS domain,
 ['GDPR', 'GxP, FDA 21 CFR Part 11, EU Annex 11, ALCOA+', 'N/A', 'FDA QSR, ISO 13485, IEC 62304', 'HIPAA, HITECH', 'SOX, PCI-DSS', 'N/A'][1 + p_partkey % 7] AS frameworks FROM part""")
def w5_frameworks(spark, sf):
    """PRJ46: always stated, if only as not applicable."""
    keys = _keys(spark, sf, "domain", "eu data processing", "pharma", "general software", "medical devices", "healthcare data", "financial systems")
    return R.framework(keys, R.dimension(spark, R.FRAMEWORKS, "domain string, frameworks string"), "domain", "frameworks")


@query("""WITH k AS (SELECT p_partkey, p_brand, p_retailprice, ['information', 'contradiction', 'ambiguity', 'external'][1 + p_size % 4] AS category, ['GAP', 'CTR', 'AMB', 'EXT'][1 + p_size % 4] AS prefix FROM part)
SELECT p_partkey, category, prefix || '-' || row_number() OVER (PARTITION BY category, p_brand ORDER BY p_retailprice DESC, p_partkey) AS id FROM k""")
def w5_gap_ids(spark, sf):
    """PRJ47, WIN11: gaps of a brand, numbered within their category by price."""
    name = F.get(F.array(*[F.lit(k) for k in ("information", "contradiction", "ambiguity", "external")]), (F.col("p_size") % 4).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", name.alias("category"))
    rows = R.framework(rows, R.dimension(spark, R.GAPS, "category string, prefix string"), "category", "prefix").withColumn("list", F.concat("category", "p_brand"))
    return C.numbered(rows, "list", F.desc("p_retailprice"), F.concat("prefix", F.lit("-")), "p_partkey").select("p_partkey", "category", "id")


@query("""SELECT p_partkey, ['proof of concept', 'web applications', 'managed services', 'data platforms', 'iot / engineering', 'low-code / dashboards', 'enterprise integration', 'mobile applications', 'unheard of'][1 + p_partkey % 9] AS project,
 ['minimum viable feature set, success metrics', 'screens, navigation, RBAC, form validation', 'SLA definitions, monitoring, DR procedures', 'dashboards, KPIs, ETL/ELT, data quality', 'sensor flows, edge processing, telemetry', 'widget types, filters, real-time updates',
  'interface contracts, mapping rules, retry logic', 'platform capabilities, offline sync, push', 'N/A'][1 + p_partkey % 9] AS focus FROM part""")
def w5_project_types(spark, sf):
    """PRJ51."""
    keys = _keys(spark, sf, "project", "proof of concept", "web applications", "managed services", "data platforms", "iot / engineering", "low-code / dashboards", "enterprise integration", "mobile applications")
    return R.framework(keys, R.dimension(spark, R.PROJECT_TYPES, "project string, focus string"), "project", "focus")


@query("""SELECT p_partkey, ['generous', 'tight', 'standard', 'unheard of'][1 + p_partkey % 4] AS budget, CAST([5, 2, 3, NULL][1 + p_partkey % 4] AS BIGINT) AS rounds_from, CAST([10, 3, 5, NULL][1 + p_partkey % 4] AS BIGINT) AS rounds_to, CAST([10, 4, 6, NULL][1 + p_partkey % 4] AS BIGINT) AS agents_from, CAST([20, 6, 10, 0][1 + p_partkey % 4] AS BIGINT) AS agents_to FROM part""")
def w5_budgets(spark, sf):
    """PRJ55."""
    keys = _keys(spark, sf, "budget", "generous", "tight", "standard")
    return R.framework(keys, R.dimension(spark, R.BUDGETS, "budget string, rounds_from long, rounds_to long, agents_from long, agents_to long"), "budget", "agents_to", 0)


@query("""SELECT p_partkey, ['cyclic', 'predictable', 'unknown', 'adaptive', 'unheard of'][1 + p_partkey % 5] AS pipeline, ['cached + delta', 'full cascade', 'unsealing', 'one-step', 'N/A'][1 + p_partkey % 5] AS mode,
 ['complex', 'capable', 'structured', 'limited', 'unheard of'][1 + p_partkey % 5] AS downstream, ['enriched', 'skeleton', 'parameterized', 'full', 'N/A'][1 + p_partkey % 5] AS detail FROM part""")
def w5_handoff_modes(spark, sf):
    """PRJ56: how handoffs are generated, and how detailed their templates are."""
    modes = R.framework(_keys(spark, sf, "pipeline", "cyclic", "predictable", "unknown", "adaptive"), R.dimension(spark, R.HANDOFFS, "pipeline string, mode string"), "pipeline", "mode")
    details = R.framework(_keys(spark, sf, "downstream", "complex", "capable", "structured", "limited"), R.dimension(spark, R.DETAIL, "downstream string, detail string"), "downstream", "detail")
    return modes.join(details, "p_partkey")


@query("""SELECT p_partkey, p_partkey % 7 < 5 AS vague FROM part""")
def w5_vague_defaults(spark, sf):
    """PRJ48: default assumptions that say nothing, and two that do."""
    said = F.get(F.array(*[F.lit(x) for x in ("TBD", " unknown ", "to be determined later", "", None, "assume two weeks", "the unknown party pays")]), (F.col("p_partkey") % 7).cast("int"))
    return table(spark, sf, "part").select("p_partkey", R.vague(said).alias("vague"))


@query("""SELECT p_partkey, ['schema', 'code', 'pseudo_code', 'structured', 'natural'][1 + p_partkey % 5] AS structure FROM part""")
def w5_prompt_structures(spark, sf):
    """PRJ49: the strictest need decides; each case also holds all that come after it."""
    k = F.col("p_partkey") % 5
    return table(spark, sf, "part").select("p_partkey", R.prompt_structure(k == 0, k < 2, k < 3, F.when(k < 4, 3).otherwise(1)).alias("structure"))


@query("""SELECT p_partkey, p_size % 3 = 0 OR p_size % 5 = 0 AS any_of, p_size % 3 = 0 AND p_size % 5 = 0 AS all_of, p_size % 4 = 0 AS overlaps FROM part""")
def w4_memberships(spark, sf):
    """ARR02."""
    from tessella.functions import values as V

    n = F.col("p_size")
    marks = F.array((n % 3 == 0).cast("int"), (n % 5 == 0).cast("int"))
    return table(spark, sf, "part").select("p_partkey", V.any_of(marks, lambda x: x == 1).alias("any_of"), V.all_of(marks, lambda x: x == 1).alias("all_of"), V.any_in(F.array((n % 4).cast("string")), ("0", "x")).alias("overlaps"))


@query("""SELECT p_partkey, ['soffice', 'mammoth+chrome', 'docx2pdf', 'none'][1 + p_partkey % 4] AS strategy, CAST([120, 60, NULL, NULL][1 + p_partkey % 4] AS BIGINT) AS seconds FROM part""")
def w1_office_strategies(spark, sf):
    """UDF05, WIN05: the first strategy of office conversion that is there, and its time limit; the converters themselves are external."""
    from tessella.operators import convert as V

    k = F.col("p_partkey") % 4
    s = V.office_strategy(k == 0, k <= 1, k <= 2)
    return table(spark, sf, "part").select("p_partkey", s["strategy"].alias("strategy"), s["seconds"].alias("seconds"))


@query("""WITH RECURSIVE r(k, v) AS (SELECT o_orderkey, o_orderkey FROM orders UNION ALL SELECT k, v // 2 FROM r WHERE v >= 10), e AS (SELECT k, min(v) AS v FROM r GROUP BY k)
SELECT k, CASE WHEN v % 2 = 0 THEN v + 1 ELSE v * 10 END + 1 AS v, 'first' AS branch FROM e UNION ALL SELECT k, -v, 'second' FROM e""")
def w5_compositions(spark, sf):
    """GRF08: halved while it is 10 or more; then two branches, one of which treats even and odd numbers apart and goes on with a second step."""
    from tessella.operators import compose as P

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("v"))
    v = F.col("v")
    low, _ = P.iterative(o, lambda d: d.withColumn("v", F.when(v >= 10, F.floor(v / 2).cast("long")).otherwise(v)), v >= 10)
    split = lambda d: P.conditional(d, v % 2 == 0, lambda x: x.withColumn("v", v + 1), lambda x: x.withColumn("v", v * 10))
    return P.parallel(low, first=lambda d: P.sequential(d, split, lambda x: x.withColumn("v", v + 1)), second=lambda d: d.withColumn("v", -v))
