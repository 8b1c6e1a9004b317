"""Mixing sources to target weights (operator 3): Efraimidis-Spirakis sampling in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stored

#: fixed values: weights of the sources in code-point order, repeating
CYCLE = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, cap: int = MOST_EPOCHS, cycle: tuple = CYCLE) -> DataFrame:
    """source, source_size, target of each source, from rows (source, source_size), one a source.

    Sources share `share` times all sizes by weight; a target stops at `cap` times its source's size and
    the excess is shared by weight among the others until none is above. That ends where every target is
    min(cap * size, level * weight); the level follows from the sources in order of cap * size / weight. The
    one-partition windows are over sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(cycle)
    weight = F.get(F.array(*[F.lit(float(w)) for w in cycle]), rank)
    s = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    upward = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything) * float(share))
    s = s.withColumn("capped", F.coalesce(F.sum("most").over(upward), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upward), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    # the level is that of the first source whose cap lies above it; if there is none, all are capped
    s = s.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that depends on the keys alone, from 52 bits of their MD5."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, quality: DataFrame | None = None, text: str = "text", id: str = "doc_id", source: str = "source", share: float = SHARE, cap: int = MOST_EPOCHS, seed: str = "mix", bins: int = BINS, row: str | None = None) -> DataFrame:
    """How many words of each document a mix of the sources takes: id, size, source_size, target, taken, and n_copies.

    Efraimidis-Spirakis: documents of a source are sorted by -ln(u) / weight and taken until the source's
    budget is full. Whole epochs of a source come first: every document as often as the source fits into the
    target; the remainder is sampled. The document on the edge is taken if that comes nearer to the target.
    `quality` gives (id, quality) rows; the weight is 0.5 + their mean quality, 1 without any. u comes
    from a hash of seed, id and, for repeated ids, a count (of null ids also a hash of the text), so reruns agree and rows of
    one id stand or fall each on its own. `row` names a column with a unique key a row, which the result then has
    too, last: with repeated or null ids, only that key tells which row of docs a result belongs to.

    Sorted prefix sums without one task per source: keys fall into `bins` bins by size; sums per source and
    bin find the bin where the budget ends, and only that bin's documents are sorted one by one. Null texts
    have size 0; a null source is a source, sorted last; size 0 is taken 0 times. Other columns are dropped.
    """
    own = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(F.col(id).alias("__id"), own.alias("__row"), F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("__hash"))
    if quality is not None:
        q = quality.groupBy(F.col(id).alias("__qid")).agg(F.avg("quality").alias("q"))
        rows = rows.join(q, F.col("__id") == F.col("__qid"), "left").withColumn("weight", F.when(F.col("q").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.col("q")) + 0.5)).drop("__qid", "q")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    # null ids are counted by text, so that their rows don't all meet in one task
    null = F.col("__id").isNull()
    same = Window.partitionBy("__id", F.when(null, F.col("__hash"))).orderBy("__hash", F.col("source").asc_nulls_last(), "__row")
    rows = stored(rows.withColumn("__nth", F.row_number().over(same)), "sizes")
    u = F.when(null, uniform(F.lit(seed), F.col("__id"), F.col("__hash"), F.col("__nth"))).when(F.col("__nth") == 1, uniform(F.lit(seed), F.col("__id"))).otherwise(uniform(F.lit(seed), F.col("__id"), F.col("__nth")))
    key = -F.log(u) / F.col("weight")
    # exponential keys: 1 - exp(-key) is near to uniform, so bins are near to equal
    keyed = rows.withColumn("key", key).withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * bins), F.lit(bins - 1)).cast("int"))
    by_bin = stored(keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    plan = targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), share, cap)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(cap))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    up = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edges = by_bin.withColumn("below", F.coalesce(F.sum("bin_size").over(up), F.lit(0)))
    both = edges.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("p.*", "b.bin", "b.below", "b.bin_size")
    keyed = keyed.alias("k").join(both.alias("p"), F.col("k.source").eqNullSafe(F.col("p.source")) & (F.col("k.bin") == F.col("p.bin"))).select("k.*", "p.source_size", "p.target", "p.epochs", "p.budget", "p.below", "p.bin_size")
    edge = (F.col("below") < F.col("budget")) & (F.col("below") + F.col("bin_size") > F.col("budget"))
    at_edge = Window.partitionBy("source", "bin").orderBy("key", "__id", "size", "__row").rowsBetween(Window.unboundedPreceding, -1)
    inside, rest = keyed.where(edge), keyed.where(~edge)
    before = F.col("below") + F.coalesce(F.sum("size").over(at_edge), F.lit(0))
    inside = inside.withColumn("more", (before + F.col("size") / 2 <= F.col("budget")).cast("long"))
    rest = rest.withColumn("more", (F.col("below") + F.col("bin_size") <= F.col("budget")).cast("long"))
    copies = F.when(F.col("size") > 0, F.least(F.col("epochs") + F.col("more"), F.lit(cap))).otherwise(F.lit(0)).cast("long")
    out = inside.unionByName(rest).withColumn("n_copies", copies)
    return out.select(F.col("__id").alias(id), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies", *([] if row is None else [F.col("__row").alias(row)]))
