"""Document fingerprints (operator 5): one-permutation MinHash with optimal densification, in b-bit form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import ship
from tessella.llm.ragged import SPACES, U64, buffers, hashes, lower_ascii, mix64, shingle_sets, spans

BINS = 512
BITS = 4
SHINGLE = 5


class OnePermutation:
    """Bins shingle hashes once; a bin keeps its least hash, empty bins borrow from bins chosen by a universal hash."""

    def __init__(self, bins: int = BINS, bits: int = BITS):
        if bins & bins - 1 or 8 % bits:
            raise ValueError("bins is a power of two, bits divides 8")
        self.bins, self.bits = bins, bits
        self.shift = U64(64 - bins.bit_length() + 1)
        self._probes = np.zeros((0, bins), np.int64)

    def _probe(self, attempt: int, many: int = 16) -> np.ndarray:
        """The bins that each bin asks in `many` attempts from `attempt` on."""
        if attempt + many > len(self._probes):
            i = np.arange(max(64, 2 * (attempt + many)), dtype=U64)[:, None] * U64(self.bins) + np.arange(self.bins, dtype=U64)
            self._probes = (mix64(i + U64(0x51ED270B)) >> self.shift).astype(np.int64)
        return self._probes[attempt : attempt + many]

    def minima(self, shingles: np.ndarray) -> np.ndarray | None:
        """The least hash of each bin after densification; None for no shingle. `shingles` are sorted and distinct."""
        if not len(shingles):
            return None
        bin_of = (shingles >> self.shift).astype(np.int64)
        first = np.ones(len(shingles), bool)
        first[1:] = bin_of[1:] != bin_of[:-1]
        own = bin_of[first]
        out = np.zeros(self.bins, U64)
        out[own] = shingles[first]
        if len(own) == 1:
            out[:] = shingles[0]
            return out
        filled = np.zeros(self.bins, bool)
        filled[own] = True
        empty = np.flatnonzero(~filled)
        attempt = 0
        while len(empty):
            asked = self._probe(attempt)[:, empty]
            hit = filled[asked]
            first_hit = hit.argmax(0)
            found = hit.any(0)
            out[empty[found]] = out[asked[first_hit, np.arange(len(empty))][found]]
            empty = empty[~found]
            attempt += len(asked)
        return out

    def sketch(self, shingles: np.ndarray) -> bytes:
        """The low `bits` of each bin's mixed minimum, packed; empty for no shingle."""
        m = self.minima(shingles)
        if m is None:
            return b""
        low = (mix64(m) & U64((1 << self.bits) - 1)).astype(np.uint8).reshape(-1, 8 // self.bits)
        out = np.zeros(len(low), np.uint8)
        for j in range(8 // self.bits):
            out |= low[:, j] << np.uint8(j * self.bits)
        return out.tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """Estimated Jaccard similarity: equal bins, less those equal by chance (2^-bits), clipped to 0..1.

        Two texts without words are alike (1), one without and one with words are not (0).
        """
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        diff = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
        mask = (1 << self.bits) - 1
        same = sum(int(np.count_nonzero((diff >> np.uint8(j)) & mask == 0)) for j in range(0, 8, self.bits))
        chance = 2.0**-self.bits
        return min(1.0, max(0.0, (same / self.bins - chance) / (1 - chance)))


def sketches(family: OnePermutation, column: pa.Array) -> list[bytes]:
    data, offsets = buffers(column)
    data = lower_ascii(data)
    starts, ends, counts = spans(data, offsets, SPACES)
    return [family.sketch(s) for s in shingle_sets(hashes(data, starts, ends), counts, SHINGLE)]


def fingerprint(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every whole text: `keep` columns, fingerprint (hex). Words are lower-cased (A-Z), five to a shingle.

    Null and texts without words give an empty fingerprint; equal texts give equal ones; no shuffle.
    """
    ship(df.sparkSession)
    kept = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = OnePermutation(bins, bits)
        for b in batches:
            marks = [x.hex() for x in sketches(family, b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(marks, pa.string())], [*keep, "fingerprint"])

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, kept.add("fingerprint", "string"))


#: bytes of text of a slice, and most slices; rows of a slice stream past, so its size bounds no memory
SLICE_BYTES, MOST_SLICES = 64 << 20, 4096


def slices_for(df: DataFrame, text: str) -> int:
    """How many slices a table's texts make: they grow with its size, and are as many as shuffle partitions at least."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_SLICES, -(-size // SLICE_BYTES)))


def with_next(df: DataFrame, order: str, slices: int) -> DataFrame:
    """Deals df into slices by descending `order`, a column of any type that sorts: each with the first row of the following slice.

    Adds __slice and __guest (true for that extra row). The cuts are values of some rows, 16 a slice, that are least by
    hash; the driver holds those, and two values a slice. Rows travel once, the first row of a slice twice.
    """
    spark = df.sparkSession
    value = F.col(order)
    some = [r["v"] for r in df.select(value.alias("v")).orderBy(F.xxhash64("v")).limit(16 * slices).distinct().orderBy("v").collect()] if slices > 1 else []
    cuts = [some[i] for i in sorted({len(some) * i // slices for i in range(1, slices)})] if some else []
    kind = df.schema[order].dataType
    literal = lambda v: F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(v, kind.fields)])
    # slices go downwards: slice 0 holds the values from the greatest cut on, the last those below all cuts
    below = F.lit(0)
    if cuts:
        all_ = F.array(*[literal(c) for c in cuts])
        steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
        fits = lambda at: (at <= len(cuts)) & (F.get(all_, at - 1) <= value)
        below = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))
    marked = df.withColumn("__slice", F.lit(len(cuts)) - below)
    heads = sorted((r["__slice"], r["head"]) for r in marked.groupBy("__slice").agg(F.max(value).alias("head")).collect())
    # the head of each slice also goes to the slice before it, that of the first slice to the last
    schema = T.StructType().add("__s", T.IntegerType()).add("__head", kind).add("__before", T.IntegerType())
    to = spark.createDataFrame([(s, h, heads[i - 1][0]) for i, (s, h) in enumerate(heads)], schema)
    marked = marked.join(F.broadcast(to), (F.col("__slice") == F.col("__s")) & value.eqNullSafe(F.col("__head")), "left")
    guest = F.col("__before")
    both = F.filter(
        F.array(F.struct(F.col("__slice").alias("s"), F.lit(False).alias("g")), F.struct(guest.alias("s"), F.lit(True).alias("g"))),
        lambda x: x["s"].isNotNull(),
    )
    rows = marked.withColumn("__to", F.explode(both)).drop("__slice", "__s", "__head", "__before")
    return rows.withColumn("__slice", F.col("__to.s")).withColumn("__guest", F.col("__to.g")).drop("__to")


def edited(text: str, following: str) -> str:
    """The last third of the text's code points replaced by as many (or all) from the start of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_edits(df: DataFrame, text: str = "text", order: str = "doc_id", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of each text and of its edit with the next text in descending `order`, and how alike they are.

    Returns order, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts count as empty: their fingerprint is empty, alike (1) only to empty ones. `order` is of any type that
    sorts. Equal values follow each other by descending hash of the text, so they too are dealt into slices; null ones come last.
    Rows equal in both are alike, and stay in one slice. A table of one row is its own next. Other columns are dropped.
    """
    ship(df.sparkSession)
    docs = df.select(F.col(order).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    docs = docs.withColumn("__key", F.struct("__id", F.xxhash64("__text").alias("h")))
    n = slices_for(docs, "__text")
    # a guest is the first row of its slice: of several that are equal, one is used
    dealt = with_next(docs, "__key", n).repartition(n, "__slice")
    rows = dealt.sortWithinPartitions("__slice", "__guest", F.col("__key").desc_nulls_last(), "__text")
    kind = df.schema[order].dataType
    schema = T.StructType([T.StructField(order, kind)]).add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = OnePermutation(bins, bits)
        held: tuple | None = None
        out: list[tuple] = []

        def pair(a: tuple, b: tuple) -> tuple:
            (i, x, p), (_, y, q) = a, b
            return i, x, p, edited(x, y), family.likeness(p, q)

        def flush() -> pa.RecordBatch:
            ids, texts, marks, edits, near = zip(*out)
            changed = sketches(family, pa.array(edits, pa.string()))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, T_arrow),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits], pa.string()),
                    pa.array([m.hex() for m in marks], pa.string()),
                    pa.array([m.hex() for m in changed], pa.string()),
                    pa.array([family.likeness(a, b) for a, b in zip(marks, changed)], pa.float64()),
                    pa.array(near, pa.float64()),
                ],
                schema.names,
            )

        T_arrow = None
        alone = None
        closed = False
        for b in batches:
            T_arrow = b.column(0).type
            marks = sketches(family, b.column(1))
            size = 0
            for i, x, s, g, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), marks):
                row = (i, x, m)
                if s != alone:
                    alone, held, closed = s, None, False
                if held is not None and not closed:
                    out.append(pair(held, row))
                    size += len(x)
                    closed = g  # what follows the first guest are ties with it, whose own place is another slice
                held = row
                if size > 4 << 20:
                    yield flush()
                    size = 0
            if out:
                yield flush()

    return rows.select("__id", "__text", "__slice", "__guest").mapInArrow(run, schema)
