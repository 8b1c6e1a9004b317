"""Rule systems (W5): ordered cascades and small tables, kept as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as X

#: fixed values: tiers and classes from strong to weak; reviewed and generated are older names of llm_human and llm
TIERS = ("T1", "T2", "T3", "T4")
CLASSES = ("public", "specs", "fragment", "llm_human", "llm")
CLASS_ALIASES = {"reviewed": "llm_human", "generated": "llm"}


def cascade(*rules: tuple[Column, object], default: object = None) -> Column:
    """The value of the first rule that holds."""
    out = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def rank_in(c: Column, order: tuple[str, ...]) -> Column:
    """The place in an ordered list, from 1; one past the end for other values."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), c)
    return F.coalesce(F.nullif(at, F.lit(0)), F.lit(len(order) + 1)).cast("int")


def band(c: Column, *bands: tuple[float, str], above: str) -> Column:
    """The label of the first band whose upper bound (included) isn't exceeded."""
    return cascade(*[(c <= most, name) for most, name in bands], default=above)


def dimension(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A rule table; its size is fixed, so joins may broadcast it."""
    return F.broadcast(spark.createDataFrame(rows, columns))


def default_tier(path: Column, source_tier: Column) -> Column:
    """PRJ10, GRF06: struct(tier, source_class) by path; fragments inherit the tier of their source; null calls for inference."""
    both = lambda t, c: F.struct((t if isinstance(t, Column) else F.lit(t)).alias("tier"), F.lit(c).alias("source_class"))
    under = lambda d: F.contains(F.concat(F.lit("/"), path), F.lit(f"/{d}/"))
    return cascade(
        (under("__SPECS__"), both("T2", "specs")),
        (under("__FRAGMENTS__"), both(source_tier, "fragment")),
        (under(".agents/memory") | under(".claude/memory"), both("T3", "llm")),
        (path.rlike(r"^[^/]*(survey|discovery|playbook)[^/]*\.md$"), both("T3", "llm")),
        default=F.lit(None),
    )


def inferred_tier(commit: Column, slop: Column, weak: Column, human: Column, cites_authority: Column) -> Column:
    """PRJ11: tier of a document without one, from its first commit's message, slop ratio and judged authorship."""
    return cascade(
        (F.coalesce(F.lower(commit).rlike("import|ingest|convert"), F.lit(False)), "T3"),
        (slop > 0.9, F.when(weak, "T4").otherwise("T3")),
        (human, F.when(cites_authority, "T1").otherwise("T2")),
        default="T4",
    )


def resolve_conflicts(claims: DataFrame, key: str = "claim_id") -> DataFrame:
    """WIN08: the strongest sources of each claim by tier, recency and class, with contradiction where their values differ.

    rank() keeps all that tie; nothing is resolved silently.
    """
    cls = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CLASS_ALIASES.items() for x in p]), F.col("source_class")), F.col("source_class"))
    order = [rank_in(F.col("tier"), TIERS), F.col("last_updated").desc_nulls_last(), rank_in(cls, CLASSES)]
    top = claims.withColumn("place", F.rank().over(Window.partitionBy(key).orderBy(*order))).where("place = 1").drop("place")
    by = Window.partitionBy(key)
    return top.withColumn("contradiction", F.min("value").over(by) != F.max("value").over(by))


def composition(architecture: Column, wbs: Column, team: Column, timeline: Column, cost: Column) -> Column:
    """PRJ25: struct(score, profile)."""
    n = lambda c, w: F.when(c, w).otherwise(0)
    score = n(architecture, 1) + n(wbs, 2) + n(team, 2) + n(timeline, 2) + n(cost, 1)
    return F.struct(score.alias("score"), band(score, (1, "A"), (3, "B"), (5, "C"), above="D").alias("profile"))


def instruction(state: Column) -> Column:
    """PRJ26."""
    return cascade((state == "ABSENT", "GENERATE"), (state == "PARTIAL", "COMPLETE"), (state == "PRESENT", "CHALLENGE"))


def methods(stakes: Column, divergence: Column, complexity: Column, structure: Column, freshness: Column, budget: Column, task: Column) -> Column:
    """PRJ27: all methods whose rule holds, in rule order; the default alone if none does. The first is element 0."""
    rules = [
        ((stakes == "high") & (divergence == "high"), "multi_candidate"),
        ((stakes == "high") & (divergence == "low"), "single_self_refine"),
        ((complexity == "high") & (structure == "known"), "plan_and_solve"),
        ((complexity == "high") & (structure == "unknown"), "tot"),
        (freshness == "high", "cok_tools"),
        (budget == "tight", "cod_sot"),
        (task == "code-generation", "code_prompting"),
        (task == "research", "cok_tot"),
        (task == "creative", "high_temperature_self_refine"),
    ]
    hits = F.array_compact(F.array(*[F.when(c, v) for c, v in rules]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("cot")))


def refine_level(stakes: Column, candidates: Column) -> Column:
    """PRJ28."""
    return cascade(((stakes == "high") & (candidates > 1), "refine_all"), (stakes == "high", "refine_until_defense"), (stakes == "medium", "refine_winner"), default="skip")


def prompt_structure(strict: Column, algorithm: Column, conditional: Column, parts: Column) -> Column:
    """PRJ49."""
    return cascade((strict, "schema"), (algorithm, "code"), (conditional, "pseudo_code"), (parts > 1, "structured"), default="natural")


def timeline_impact(weeks: Column) -> Column:
    """PRJ29: the bounds overlap in the rule; 8 and 12 belong to the lower band."""
    return band(weeks, (8, "none"), (12, "1-2 weeks"), above="20-25%")


def dispatch(subjects: Column) -> Column:
    """PRJ30."""
    return band(subjects, (1, "inline"), (3, "parallel"), (6, "batched"), above="waves")


def high_stakes(domain: Column, domains: tuple[str, ...]) -> Column:
    """PRJ31: an unknown domain escalates."""
    return F.coalesce(domain.isin(*domains), F.lit(True))


#: fixed values: rule tables by key
DEPTHS = [("simple", "L0-L2"), ("complicated", "L0-L3"), ("complex", "L0-L4"), ("chaotic", "L0-L4 + consequences")]  # PRJ32: domain, expansion levels
PRIORITIES = [("requirements", 1, "full read"), ("architecture", 2, "targeted read and images"), ("spreadsheets", 3, "one converter"), ("slide decks", 4, "both converters and images"), ("supporting", 5, "targeted read")]  # PRJ33
STRATEGIES = [("Fact", "revision"), ("Concept", "revision"), ("Procedure", "revision"), ("Ontology", "revision"), ("Narrative", "immutable")]  # PRJ34
DEPTH_ROWS = [("quick", 1, 2, 1, 1, 7), ("standard", 3, 5, 2, 3, 7), ("deep", 5, 8, 3, 5, 10), ("maximum", 5, 8, None, None, 10)]  # PRJ38: queries from, to, rounds from, to (until convergence: null), agents
ARTIFACTS = [("simple", "Fact,Procedure", "categorize"), ("complicated", "Procedure,Concept", "analyze"), ("complex", "Concept,Narrative", "probe"), ("chaotic", "Narrative", "act")]  # PRJ41
INPUTS = [("repository", "files beyond the readme"), ("specification", "normative sections"), ("product brief", "text and signals"), ("transcript", "statements and hedges"), ("mixed", "each source by itself")]  # PRJ44
FRAMEWORKS = [
    ("pharma", "GxP, FDA 21 CFR Part 11, EU Annex 11, ALCOA+"), ("medical devices", "FDA QSR, ISO 13485, IEC 62304"), ("financial systems", "SOX, PCI-DSS"),
    ("healthcare data", "HIPAA, HITECH"), ("eu data processing", "GDPR"), ("general software", "N/A"),
]  # fmt: skip  # PRJ46
GAPS = [("information", "GAP"), ("contradiction", "CTR"), ("ambiguity", "AMB"), ("external", "EXT")]  # PRJ47; no prefix is stated for external gaps
PROJECT_TYPES = [
    ("web applications", "screens, navigation, RBAC, form validation"), ("iot / engineering", "sensor flows, edge processing, telemetry"), ("enterprise integration", "interface contracts, mapping rules, retry logic"),
    ("mobile applications", "platform capabilities, offline sync, push"), ("data platforms", "dashboards, KPIs, ETL/ELT, data quality"), ("managed services", "SLA definitions, monitoring, DR procedures"),
    ("low-code / dashboards", "widget types, filters, real-time updates"), ("proof of concept", "minimum viable feature set, success metrics"),
]  # fmt: skip  # PRJ51
BUDGETS = [("tight", 2, 3, 4, 6), ("standard", 3, 5, 6, 10), ("generous", 5, 10, 10, 20)]  # PRJ55: iterations from, to, agents from, to
HANDOFFS = [("predictable", "full cascade"), ("adaptive", "one-step"), ("unknown", "unsealing"), ("cyclic", "cached + delta")]  # PRJ56
DETAIL = [("capable", "skeleton"), ("limited", "full"), ("structured", "parameterized"), ("complex", "enriched")]  # PRJ56


def checklist(searches: Column, sources: Column, stakes: Column) -> Column:
    """PRJ35: enough searches (5 where stakes are high, else 3) and at least three cited sources."""
    return (searches >= F.when(stakes, 5).otherwise(3)) & (sources >= 3)


def gate(evidence: Column, can_invoke: Column) -> Column:
    """PRJ36."""
    return cascade((evidence, "OPEN"), (can_invoke, "INVOKE"), default="FALLBACK")


def continuation(complete: Column, same_agent: Column, other_needed: Column) -> Column:
    """PRJ37."""
    return cascade((complete, "done"), (same_agent, "continuation"), (other_needed, "handoff"), default="done")


def signal(critique: Column, author: Column) -> Column:
    """PRJ39: quality by the pair of signals; null where none is agreed."""
    return cascade((author == "FAILED", "flaw"), ((critique == "CONVERGE") & (author == "HELD"), "strong"), ((critique == "DRIFTING") & (author == "HELD"), "adequate"))


def round_over(signals: DataFrame, budget: int) -> DataFrame:
    """PRJ39: round, over: all three candidates have signalled, or the budget is used up."""
    return signals.groupBy("round").agg((F.every(F.col("signal").isNotNull()) | (F.max("round") >= budget)).alias("over"))


def artifact_type(defines: Column, steps: Column, relates: Column, verifiable: Column) -> Column:
    """PRJ40: the first litmus test that holds."""
    return cascade((defines, "Ontology"), (steps, "Procedure"), (relates, "Concept"), (verifiable, "Fact"), default="Narrative")


def materialize(central: Column, explanatory: Column, actionable: Column, dependency: Column, tangential: Column) -> Column:
    """PRJ43."""
    return cascade((tangential, "defer"), (central | explanatory | actionable | dependency, "create"), default="defer")


def sentences(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"[.!?]+(?:\s+|$)"), lambda x: F.trim(x) != ""))


def spec_violations(components: DataFrame) -> DataFrame:
    """PRJ45: components without what they need: premises source and risk, constraints a source, missions one sentence."""
    c = F.col("component")
    bad = cascade(
        ((c == "premise") & (F.col("source").isNull() | F.col("risk").isNull()), "premise_incomplete"),
        ((c == "constraint") & F.col("source").isNull(), "constraint_without_source"),
        ((c == "mission") & (sentences(F.col("text")) != 1), "mission_sentences"),
    )
    return components.withColumn("violation", bad).where("violation IS NOT NULL")


def vague(c: Column) -> Column:
    """PRJ48: a default assumption that says nothing."""
    return c.isNull() | F.lower(X.strip(c)).rlike(r"^(tbd|unknown|n/?a|to be (determined|defined).*|)$")


def feasibility(areas: DataFrame) -> DataFrame:
    """PRJ50: the worst verdict of a proposal's areas; that the worst counts is this library's choice."""
    order = ("NO-GO", "GO with conditions", "GO")
    worst = F.min(rank_in(F.col("verdict"), order))
    return areas.groupBy("proposal").agg(F.get(F.array(*[F.lit(x) for x in order]), worst - 1).alias("verdict"))


def merge_finding(url: Column, tier: Column, contradicts: Column) -> Column:
    """PRJ52."""
    return cascade((url.isNull() | (url == ""), "drop"), (contradicts & (tier == "T1"), "replace"), (contradicts, "alternative"), default="add")


def framework(rows: DataFrame, table: DataFrame, key: str, value: str, default: str = "N/A") -> DataFrame:
    """PRJ32, PRJ33, PRJ38, PRJ41, PRJ44, PRJ46, PRJ47, PRJ51, PRJ55, PRJ56: looks a key up in a rule table; rows without a match get the default in `value`."""
    return rows.join(F.broadcast(table), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def read_plan(n_files: Column, n_lines: Column) -> Column:
    """PRJ54: how many files are listed, and lines read of each."""
    return F.struct(F.when(n_files > 20, 10).otherwise(n_files).alias("listed"), F.when(n_lines > 200, 80).otherwise(n_lines).alias("lines"))


def rule_kind(always: Column) -> Column:
    """PRJ57."""
    return F.when(always, "system_rule").otherwise("skill")


def pairs(candidates: DataFrame, by: str = "topic", name: str = "candidate") -> DataFrame:
    """JON20: every pair of a topic's candidates once; topics have few candidates."""
    a, b = candidates.select(by, F.col(name).alias("left")), candidates.select(by, F.col(name).alias("right"))
    return a.join(b, by).where("left < right")


def condorcet(votes: DataFrame, candidates: DataFrame, by: str = "topic") -> DataFrame:
    """AGG17: topic, candidate, wins, place, role: by wins, then signal strength, fit, simplicity and name."""
    wins = votes.groupBy(by, F.col("winner").alias("candidate")).agg(F.count("*").alias("wins"))
    rows = candidates.join(wins, [by, "candidate"], "left").withColumn("wins", F.coalesce("wins", F.lit(0)))
    strength = F.when(F.col("signal") == "HELD", 2).when(F.col("signal") == "CONVERGE", 1).otherwise(0)
    w = Window.partitionBy(by).orderBy(F.desc("wins"), strength.desc(), F.desc("domain_fit"), F.asc("complexity"), F.asc("candidate"))
    place = F.row_number().over(w)
    return rows.withColumn("place", place).withColumn("role", cascade((F.col("place") == 1, "winner"), (F.col("place") == 2, "runner_up"), default="rejected"))


def convergence(overlaps: DataFrame, by: str = "topic", least: float = 0.8) -> DataFrame:
    """GRF09: topic, n_over, class; two of three pairs count as partial and are flagged as ambiguous."""
    g = overlaps.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("overlap") > least).alias("n_over"))
    kind = cascade((F.col("n_over") == F.col("n"), "CONVERGE-ALL"), (F.col("n_over") > 0, "CONVERGE-PARTIAL"), default="DIVERGENT")
    return g.select(by, "n_over", kind.alias("class"), ((F.col("n_over") > 1) & (F.col("n_over") < F.col("n"))).alias("ambiguous"))


def terminations(versions: DataFrame, most: int, similarity: Column | None = None, by: str = "solution_id") -> DataFrame:
    """WIN09, GRF10: the first iteration of each solution that ends its refinement, and why.

    versions: by, iteration, text. DEFENSE by markers, CONVERGE by similarity (words in common, over 0.95) to the version
    before, CYCLE where an earlier version but the last recurs, TIMEOUT at `most`.
    """
    w = Window.partitionBy(by).orderBy("iteration")
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    last = F.lag("text").over(w)
    union = F.size(F.array_union(words(F.col("text")), words(F.col("last"))))
    same = similarity if similarity is not None else F.when(F.col("last").isNotNull(), F.size(F.array_intersect(words(F.col("text")), words(F.col("last")))) / union)
    rows = versions.withColumn("last", last).withColumn("hash", F.sha2("text", 256))
    recur = Window.partitionBy(by, "hash").orderBy("iteration")
    rows = rows.withColumn("similarity", same).withColumn("seen", F.lag("iteration").over(recur))
    why = cascade(
        (X.has_any(F.col("text"), X.DEFENSE), "DEFENSE"),
        (F.col("similarity") > 0.95, "CONVERGE"),
        (F.col("seen") < F.col("iteration") - 1, "CYCLE"),
        (F.col("iteration") >= most, "TIMEOUT"),
    )
    done = rows.withColumn("reason", why).where("reason IS NOT NULL")
    return done.groupBy(by).agg(F.min(F.struct("iteration", "reason")).alias("m")).select(by, "m.iteration", "m.reason")


def funnel(findings: DataFrame, by: str, first: int = 10, final: int = 5) -> DataFrame:
    """LIM03: adds shortlisted and final: the first by relevance, then tier, then name."""
    w = Window.partitionBy(by).orderBy(F.desc("relevance"), rank_in(F.col("tier"), TIERS), "finding")
    place = F.row_number().over(w)
    return findings.withColumn("place", place).where(F.col("place") <= first).withColumn("final", F.col("place") <= final)
