"""Knowledge artifacts, graphs and bounded iteration (GRF, JON13-JON15, WIN06, WIN07, WIN13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.session import stored


def revision_log(revisions: DataFrame, key: str = "artifact") -> DataFrame:
    """WIN06, WIN07: adds rev (r1 is the oldest) and current."""
    up, down = Window.partitionBy(key).orderBy("ts", "note"), Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("note"))
    return revisions.withColumn("rev", F.row_number().over(up)).withColumn("current", F.row_number().over(down) == 1)


def immutable_violations(revisions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """PRJ34: narratives with more than one revision."""
    n = revisions.groupBy("artifact").agg(F.count("*").alias("n"))
    return artifacts.where(F.col("type") == "Narrative").join(n, "artifact").where("n > 1")


def backlog(relations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """JON14: targets of relations that no artifact has."""
    return relations.select("target").distinct().join(artifacts.select(F.col("artifact").alias("target")), "target", "left_anti")


def isolated(artifacts: DataFrame, relations: DataFrame) -> DataFrame:
    """JON15: artifacts that no relation names on either side."""
    named = relations.select(F.explode(F.array("source", "target")).alias("artifact")).distinct()
    return artifacts.join(named, "artifact", "left_anti")


def one_sided(relations: DataFrame, relation: str, inverse: str) -> DataFrame:
    """JON13: relations whose inverse isn't stated."""
    back = relations.where(F.col("relation") == inverse).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return relations.where(F.col("relation") == relation).join(back, ["source", "target"], "left_anti")


def unverified_facts(artifacts: DataFrame, relations: DataFrame) -> DataFrame:
    """PRJ42: facts without a verification by a narrative that exists."""
    story = artifacts.where(F.col("type") == "Narrative").select(F.col("artifact").alias("target"))
    trail = relations.where(F.col("relation") == "verified_by").join(story, "target", "left_semi").select(F.col("source").alias("artifact"))
    return artifacts.where(F.col("type") == "Fact").join(trail, "artifact", "left_anti")


def triple_gaps(triples: DataFrame, patterns: DataFrame) -> DataFrame:
    """GRF02: (subject, relation) that the pattern of the subject's type asks for and no triple has. triples carry type."""
    wanted = triples.select("subject", "type").distinct().join(F.broadcast(patterns), "type").select("subject", "relation")
    return wanted.join(triples.select("subject", "relation"), ["subject", "relation"], "left_anti")


def expand(triples: DataFrame, seeds: DataFrame, least: float = 0.3, depth: int = 5) -> DataFrame:
    """GRF03: nodes reached from the seeds with their depth and the best product of relevances on the way.

    A level is one join and one aggregate over the stored level before; levels end at `depth`, below `least`, or without new nodes.
    """
    edges = stored(triples.select(F.col("subject").alias("node"), "object", F.col("relevance").alias("weight")), "triples")
    front = reached = stored(seeds.select("node", F.lit(1.0).alias("relevance"), F.lit(0).alias("depth")), "level")
    for d in range(1, depth + 1):
        step = front.join(edges, "node").select(F.col("object").alias("node"), (F.col("relevance") * F.col("weight")).alias("relevance"))
        step = step.where(F.col("relevance") >= least).groupBy("node").agg(F.max("relevance").alias("relevance")).withColumn("depth", F.lit(d))
        front = stored(step.join(reached.select("node"), "node", "left_anti"), "level")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def why_chain(edges: DataFrame, start: DataFrame, most: int = 10) -> DataFrame:
    """GRF04: root, node, step along answers, ended where one repeats. A recursive query with a visited list."""
    spark = edges.sparkSession
    edges.createOrReplaceTempView("tessella_why_edges")
    start.createOrReplaceTempView("tessella_why_start")
    return spark.sql(
        f"""WITH RECURSIVE walk(root, node, step, seen) AS (
          SELECT node, node, 0, array(node) FROM tessella_why_start
          UNION ALL
          SELECT w.root, e.answer, w.step + 1, array_append(w.seen, e.answer)
          FROM walk w JOIN tessella_why_edges e ON w.node = e.question
          WHERE w.step < {int(most)} AND NOT array_contains(w.seen, e.answer))
        SELECT root, node, step FROM walk"""
    )


def version_tree(versions: DataFrame) -> DataFrame:
    """GRF05, WIN10: version, parent, depth, is_current_best (the best rate, the first of equals).

    Parents are jumped over: each round doubles how far up every version looks, so a chain of any length takes as many rounds
    as its length has binary digits. Versions without a root above them (in a circle, or with a parent that isn't there) are left out.
    """
    up = stored(versions.select("version", "parent", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")), "tree")
    most = versions.count()
    while up.where("up IS NOT NULL").limit(1).count() and most > 0:
        above = up.select(F.col("version").alias("a"), F.col("up").alias("next"), F.col("depth").alias("more"))
        far = up.join(above, F.col("up") == F.col("a"), "left").where("up IS NULL OR a IS NOT NULL")
        up = stored(far.select("version", "parent", "next", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")).withColumnRenamed("next", "up"), "tree")
        most //= 2
    tree = up.where("up IS NULL").drop("up")
    best = versions.agg(F.min(F.struct((-F.coalesce("rate", F.lit(0.0))).alias("r"), "version"))["version"].alias("best"))
    return tree.join(F.broadcast(best)).withColumn("is_current_best", F.col("version") == F.col("best")).drop("best")


def inherited_tier(fragments: DataFrame, sources: DataFrame, default: str = "T2") -> DataFrame:
    """GRF06: fragment, tier of its source file."""
    return fragments.join(sources.select("source_file", "tier"), "source_file", "left").select("fragment", F.coalesce("tier", F.lit(default)).alias("tier"))


#: fixed values: what a challenge to a component puts in question
CASCADE = [("goal", "premise"), ("goal", "constraint"), ("premise", "constraint")]


def challenged(components: DataFrame, challenge: DataFrame) -> DataFrame:
    """GRF07: components of the same spec that a challenge reaches."""
    table = components.sparkSession.createDataFrame(CASCADE, "component string, reaches string")
    hit = challenge.join(F.broadcast(table), "component").select("spec_id", F.col("reaches").alias("component")).distinct()
    return components.join(hit, ["spec_id", "component"], "left_semi")


def sections(lines: DataFrame, key: str = "doc", order: str = "line", text: str = "text") -> DataFrame:
    """WIN13: adds section, the last heading at or above the line."""
    heading = F.when(F.col(text).rlike("^#+ "), F.regexp_replace(text, "^#+ +", ""))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def registry_status(recovered: DataFrame, registry: DataFrame, key: str = "id") -> DataFrame:
    """JON19: inferred, missed, drifted or kept."""
    both = recovered.select(key, F.col("text").alias("found")).join(registry.select(key, F.col("text").alias("stated")), key, "full")
    status = F.when(F.col("stated").isNull(), "inferred").when(F.col("found").isNull(), "missed").when(F.col("found") != F.col("stated"), "drifted").otherwise("kept")
    return both.select(key, status.alias("status"))


def edge_is(style: Column, edge: Column, source: Column, target: Column) -> Column:
    """PRJ13."""
    s = F.coalesce(style, F.lit(""))
    return (F.coalesce(edge, F.lit("")) == "1") | (source.isNotNull() & target.isNotNull()) | F.contains(s, F.lit("endArrow")) | F.contains(s, F.lit("edgeStyle"))


def edge_label_is(style: Column, connectable: Column) -> Column:
    """PRJ14."""
    return (F.coalesce(connectable, F.lit("1")) == "0") | F.contains(F.coalesce(style, F.lit("")), F.lit("edgeLabel"))


#: fixed values: shapes by parts of the style, in order, and that of any other style
SHAPES = ((("cylinder",), "database"), (("rhombus", "diamond"), "decision"), (("ellipse",), "actor"), (("cloud",), "cloud"), (("shape=mxgraph.aws", "shape=mxgraph.azure"), "cloud-service"))
OTHER_SHAPE = "component"


def shape(style: Column) -> Column:
    """PRJ12: the first parts of which the style holds one."""
    out = F.lit(OTHER_SHAPE)
    for parts, name in reversed(SHAPES):
        held = [F.contains(F.coalesce(style, F.lit("")), F.lit(p)) for p in parts]
        out = F.when(held[0] | held[-1], name).otherwise(out)
    return out


def _cells(cells: DataFrame) -> DataFrame:
    """Cells with label, is_edge and is_label, without structural roots (PRJ15). Of cells of one id in a diagram that are edges, the last counts."""
    c = cells.where(~(F.col("id").isin("0", "1") & (X.strip(F.coalesce("value", F.lit(""))) == "")))
    edge = edge_is(F.col("style"), F.col("edge"), F.nullif("source", F.lit("")), F.nullif("target", F.lit("")))
    return c.withColumns({"label": F.nullif(X.squeeze(X.strip_tags(F.col("value"))), F.lit("")), "is_edge": edge, "is_label": edge_label_is(F.col("style"), F.col("connectable"))})


def diagram_edges(cells: DataFrame) -> DataFrame:
    """GRF01, JON04, JON05, PRJ13-PRJ15: file, diagram, id, label, source and target labels of each edge.

    An edge cell is an edge even if it also looks like a label. An end without a labelled node shows its id, without an id
    a question mark. The last non-empty label cell of an edge, by position, replaces its own label.
    """
    where = ["file", "diagram"]
    c = _cells(cells)
    last = F.max_by(F.struct("label", "source", "target"), "pos").alias("e")
    edges = c.where("is_edge").groupBy(*where, F.col("id").alias("edge_id")).agg(last).select(*where, "edge_id", "e.*")
    labels = c.where("NOT is_edge AND is_label AND label IS NOT NULL").groupBy(*where, F.col("parent").alias("edge_id")).agg(F.max_by("label", "pos").alias("own"))
    nodes = diagram_nodes(cells).groupBy(*where, F.col("id").alias("node")).agg(F.max_by("label", "pos").alias("node_label"))
    end = lambda rows, side: rows.join(nodes.withColumnRenamed("node", side).withColumnRenamed("node_label", f"{side}_label"), [*where, side], "left")
    rows = end(end(edges.join(labels, [*where, "edge_id"], "left"), "source"), "target")
    name = lambda side: F.coalesce(f"{side}_label", F.nullif(side, F.lit("")), F.lit("?")).alias(side)
    return rows.select(*where, "edge_id", F.coalesce("own", "label").alias("label"), name("source"), name("target"))


def diagram_nodes(cells: DataFrame) -> DataFrame:
    """GRF01, PRJ12: file, diagram, id, pos, label, shape of each node: cells with a label that aren't edges, nor labels of an edge of their diagram."""
    where = ["file", "diagram"]
    c = _cells(cells)
    edges = c.where("is_edge").select(*where, F.col("id").alias("parent"), F.lit(True).alias("of_edge")).distinct()
    rows = c.where("NOT is_edge AND label IS NOT NULL").join(edges, [*where, "parent"], "left").where("NOT (is_label AND of_edge IS NOT NULL)")
    return rows.select(*where, "id", "pos", "label", shape(F.col("style")).alias("shape"))
