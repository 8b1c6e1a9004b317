"""N-gram Jaccard join (operator 10): token-combination prefixes over five-word shingles, verified by whole sets.

Tokens are hashes of a document's distinct shingles. Equal sets are one set. Every set orders its tokens alike, rarest
first, and the token universe is dealt into classes by frequency: tokens of one set alone, class 1 (rare, indexed
singly), class 2 (in PAIRS_FROM sets or more, indexed by pairs) and class 3 (indexed by triples).

Two sets of Jaccard >= t each lack at most tau = n - ceil(t n) of the other's tokens. In a prefix, a class-1 token is
lost by one of those errors; of class k, dealt into groups by hash, a group of g tokens keeps a shared k-combination
unless g - k + 1 errors fall on it. So a prefix whose tokens "cover" tau + 1 errors (each own or class-1 token one, each
group g - k + 1) holds a shared index key, for the set whose prefix ends first and so for both. The number of groups
follows the length; sets that can match are of the same length class or of neighbouring ones and meet under the larger.

How often a token occurs is counted over all sets: tokens travel once, as packed arrays to buckets by hash, and those
of several sets come back to their sets. A set with more than tau tokens of its own can't match and is done. What
remains are the live sets, and only their shared tokens, which is all that an overlap needs. Tokens that occur so often
that they would fill a bucket are known from counts over parts of the input, and don't travel to buckets.

Candidates of a key aren't paired: each set is first compared with the centre that most of its keys name, and
components of these links are taken. Only keys whose members still are of several components go on: their members
meet in blocks, everyone outside of the largest component of a cluster with all the others, by exact overlaps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, ship, stored, widened
from tessella.llm.ragged import SPACES, U64, buffers, hashes, lower_ascii, mix64, shingle_sets, spans

SHINGLE = 5
PERCENT = 75
#: sets in which a token occurs from which on it is of class 2, and times the least of hot tokens from which on of class 3
PAIRS_FROM = 64
TRIPLES_FROM = 8
#: tokens of a bucket on average; tokens that a task gathers before it sends them
BUCKET_TOKENS = 1 << 22
WINDOW_TOKENS = 1 << 21
#: a token is hot if it occurs HOT_LEAST times and is one in HOT_SHARE of all at least; so there are at most HOT_SHARE hot ones
HOT_LEAST = 256
HOT_SHARE = 1 << 18
#: times in a window from which on a token is reported as perhaps hot
HOT_LOCAL = 4
#: tokens of the sets that meet in a block
BLOCK_TOKENS = 1 << 21
#: bytes of a token on its way to a bucket, which knows its upper bits
PACKED = 6
#: most sets that a task remembers in order to send equal ones once
SEEN = 1 << 17


def token_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct tokens of each text; words are split at ASCII white space and A-Z lower-cased."""
    data, offsets = buffers(column)
    data = lower_ascii(data)
    starts, ends, counts = spans(data, offsets, SPACES)
    return shingle_sets(hashes(data, starts, ends), counts, k)


def set_id(tokens: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    both = np.array([tokens.sum(dtype=U64), np.bitwise_xor.reduce(mix64(tokens))], U64)
    return int(mix64(mix64(both[:1]) + both[1:] + U64(len(tokens))).view(np.int64)[0])


def most_missing(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set of n that a set which links with it can lack."""
    return n - -(-percent * n // 100)


def length_class(n: int, percent: int = PERCENT) -> int:
    """Sets that can match are at most one class apart."""
    c = int(math.log(n) / math.log(100 / percent))
    while (100 / percent) ** c > n:
        c -= 1
    while (100 / percent) ** (c + 1) <= n:
        c += 1
    return c


def groups_of(c: int, percent: int = PERCENT) -> tuple[int, int] | None:
    """Groups of class 2 and class 3 for sets that meet under length class c; none if they have too few tokens for combinations.

    A set that meets there has lo * percent / 100 tokens at least, of which percent must be shared: so many are
    there beyond tau. What m2 + 2 m3 takes of them is enough for a cover.
    """
    least = (100 / percent) ** c * (percent / 100) ** 2
    return (max(1, int(0.3 * least)), max(1, int(0.2 * least))) if least >= 9 else None


def combinations(tokens: np.ndarray, group: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Keys of all k-combinations (k is 2 or 3) of tokens of one group; tokens are in the common order."""
    order = np.argsort(group, kind="stable")
    f, group = tokens[order], group[order]
    ends = np.searchsorted(group, group, "right")

    def extend(last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each combination, by the place of its last token, with each later token of the group."""
        after = ends[last] - last - 1
        which = np.repeat(np.arange(len(last)), after)
        return which, last[which] + 1 + np.arange(len(which)) - np.repeat(np.cumsum(after) - after, after)

    place = np.arange(len(f))
    keys = mix64(f + U64(salt))
    for _ in range(k - 1):
        which, place = extend(place)
        keys = mix64(keys[which] + f[place] * U64(0xD1342543DE82EF95))
    return keys


def index_keys(tokens: np.ndarray, n: int, ones: int, twos: int, percent: int = PERCENT) -> np.ndarray:
    """The index keys of a live set of n tokens: those it shares with others are given in order, `ones` of class 1, then `twos` of class 2.

    Keys are 64-bit hashes; that two different ones agree only costs a candidate.
    """
    needed = most_missing(n, percent) + 1 - (n - len(tokens))  # errors to cover beyond the set's own tokens
    keys = [mix64(tokens[: min(ones, needed)] ^ U64(0x632BE59BD9B4E019))]
    needed -= ones
    if needed <= 0:
        return keys[0]
    frequent = tokens[ones:]
    own = length_class(n, percent)
    for c in (own, own + 1):
        groups = groups_of(c, percent)
        if groups is None:
            keys.append(mix64(frequent[:needed] ^ mix64(np.array([c + 1], U64))))
            continue
        m2, m3 = groups
        h = mix64(frequent + U64(0x8CB92BA72F3D8DD7))
        pairs = np.arange(len(frequent)) < twos
        group = np.where(pairs, h % U64(m2), U64(m2) + h % U64(m3)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        rank = np.empty(len(frequent), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(group[order], group[order])
        cover = np.cumsum(rank >= np.where(pairs, 1, 2))
        end = int(np.searchsorted(cover, needed)) + 1
        f, g, p = frequent[:end], group[:end], pairs[:end]
        keys.append(combinations(f[p], g[p], 2, c + 1))
        keys.append(combinations(f[~p], g[~p], 3, c + 1))
    return np.concatenate(keys)


def _packed(tokens: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.reshape(-1).view("<u8")


def _joined(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The bytes of all values of a binary column, one after the other."""
    parts = [np.zeros(0, np.uint8)]
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        _, offsets, data = c.cast(pa.large_binary()).buffers()
        o = np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int64)
        if o[-1] > o[0]:
            parts.append(np.frombuffer(data, np.uint8)[o[0] : o[-1]])
    return np.concatenate(parts)


def _binaries(column: pa.ChunkedArray | pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


class _Window:
    """Distinct sets of a task's texts, until they have WINDOW_TOKENS tokens."""

    def __init__(self) -> None:
        self.seen: set[int] = set()
        self.clear()

    def clear(self) -> None:
        self.sets: list[np.ndarray] = []
        self.sids: list[int] = []
        self.size = 0

    def add(self, tokens: np.ndarray, sid: int) -> bool:
        """Whether the window is full."""
        if sid not in self.seen:
            if len(self.seen) < SEEN:
                self.seen.add(sid)
            self.sets.append(tokens)
            self.sids.append(sid)
            self.size += len(tokens)
        return self.size >= WINDOW_TOKENS


def describe(docs: DataFrame, k: int) -> DataFrame:
    """A row per document (id, n, sid), and in rows of their own (token, hits) tokens that occur HOT_LOCAL times in a window."""
    schema = widened(docs.select("__id").schema, "n int, sid long, token long, hits int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = _Window()
        id_type = None

        def hits() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate([np.zeros(0, U64), *window.sets]), return_counts=True)
            keep = counts >= HOT_LOCAL
            window.clear()
            none = pa.nulls(int(keep.sum()))
            return pa.RecordBatch.from_arrays([none.cast(id_type), none.cast(pa.int32()), none.cast(pa.int64()), pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep].astype(np.int32))], schema.names)

        for b in batches:
            id_type = b.column(0).type
            sets = token_sets(b.column(1), k)
            sids = [set_id(s) if len(s) else None for s in sets]
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(sids, pa.int64()), none.cast(pa.int64()), none.cast(pa.int32())], schema.names)
            for s, i in zip(sets, sids):
                if i is not None and window.add(s, i):
                    yield hits()
        if id_type is not None:
            yield hits()

    return docs.select("__id", "__text").mapInArrow(run, schema)


class Hot:
    """Hot tokens, sorted, and the class of each; and how tokens are dealt into 2^bits buckets."""

    def __init__(self, tokens: np.ndarray, classes: np.ndarray, bits: int):
        self.bits = bits
        tokens = self.canonical(tokens)
        self.tokens, first = np.unique(tokens, return_index=True)
        self.classes = classes[first]

    def canonical(self, tokens: np.ndarray) -> np.ndarray:
        """What a bucket knows of a token: its first `bits` bits and its last 8 * PACKED."""
        if self.bits + 8 * PACKED >= 64:
            return tokens
        return tokens & (self.upper(U64((1 << self.bits) - 1)) | U64((1 << 8 * PACKED) - 1))

    def upper(self, bucket: np.uint64) -> np.uint64:
        return bucket << U64(64 - self.bits) if self.bits else U64(0)

    def bucket(self, tokens: np.ndarray) -> np.ndarray:
        return (tokens >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(tokens), np.int64)

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each is hot, its place among hot ones)."""
        if not len(self.tokens):
            return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return self.tokens[at] == tokens, at


def hot_tokens(described: DataFrame) -> Hot:
    """At most HOT_SHARE tokens reach the driver: each stands for one in HOT_SHARE of all."""
    total = described.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    least = max(HOT_LEAST, -(-total // HOT_SHARE))
    found = described.where("token IS NOT NULL").groupBy("token").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= least).toArrow()
    hits = found.column("hits").to_numpy()
    bits = max(0, math.ceil(math.log2(max(1, total / BUCKET_TOKENS))))
    return Hot(found.column("token").to_numpy().view(U64), np.where(hits >= TRIPLES_FROM * least, 3, 2).astype(np.uint8), bits)


RUNS = "tokens binary, freqs binary, sids binary, ns binary, counts binary"


def scatter(docs: DataFrame, hot, k: int) -> DataFrame:
    """(bucket, tokens, sids, ns, counts): the tokens of each bucket, set by set; of each set its sid, its size, and how many tokens stand here.

    Hot tokens go to one of as many further buckets, by their set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Hot = hot.value
        window = _Window()

        def rows() -> Iterator[pa.RecordBatch]:
            if not window.sets:
                return
            n = np.array([len(s) for s in window.sets], np.int64)
            sids = np.array(window.sids, np.int64)
            tokens = plan.canonical(np.concatenate(window.sets))
            owner = np.repeat(np.arange(len(n)), n)
            window.clear()
            bucket = plan.bucket(tokens)
            is_hot, _ = plan.find(tokens)
            bucket[is_hot] = (1 << plan.bits) + sids[owner[is_hot]] % (1 << plan.bits)
            order = np.argsort(bucket, kind="stable")
            tokens, owner, bucket = tokens[order], owner[order], bucket[order]
            run = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])])
            counts = np.diff(np.r_[run, len(tokens)]).astype(np.uint32)
            of = owner[run]
            begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[begin[1:], len(tokens)]
            for b, e in zip(begin.tolist(), ends.tolist()):
                number = int(bucket[b])
                i, j = np.searchsorted(run, (b, e))
                raw = _packed(tokens[b:e], PACKED if number < 1 << plan.bits else 8)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([number], pa.int32()), "tokens": [raw], "sids": [sids[of[i:j]].tobytes()], "ns": [n[of[i:j]].astype(np.uint32).tobytes()], "counts": [counts[i:j].tobytes()]})

        for b in batches:
            for s in token_sets(b.column(0), k):
                if len(s) and window.add(s, set_id(s)):
                    yield from rows()
        yield from rows()

    return docs.select("__text").mapInArrow(run, "bucket int, tokens binary, sids binary, ns binary, counts binary")


def count_bucket(table: pa.Table, plan: Hot) -> pa.Table:
    """What a bucket knows of its tokens that several sets have (or that are hot: frequency 0), dealt by set into as many homes."""
    number = table.column("bucket")[0].as_py()
    counted = number < 1 << plan.bits
    tokens = _joined(table.column("tokens"))
    tokens = _unpacked(tokens, PACKED) | plan.upper(U64(number)) if counted else tokens.view(U64)
    sids, ns, counts = (_joined(table.column(c)).view(t) for c, t in (("sids", np.int64), ("ns", np.uint32), ("counts", np.uint32)))
    counts = counts.astype(np.int64)
    first = np.zeros(len(sids), bool)
    first[np.unique(sids, return_index=True)[1]] = True  # equal sets of several tasks count once
    tokens = tokens[np.repeat(first, counts)]
    sids, ns, counts = sids[first], ns[first], counts[first]
    freqs = np.zeros(len(tokens), np.uint16)
    if counted:
        order = np.argsort(tokens)
        begin = np.flatnonzero(np.r_[True, tokens[order[1:]] != tokens[order[:-1]]])
        times = np.diff(np.r_[begin, len(tokens)])
        freqs[order] = np.repeat(np.minimum(times, 65535), times)
        keep = freqs > 1
        kept = np.add.reduceat(keep, np.cumsum(counts) - counts, dtype=np.int64)
        tokens, freqs, counts = tokens[keep], freqs[keep], kept
        some = counts > 0
        sids, ns, counts = sids[some], ns[some], counts[some]
    home = sids % (1 << plan.bits)
    order = np.argsort(home, kind="stable")
    start = np.cumsum(counts) - counts
    at = np.repeat(start[order] - (np.cumsum(counts[order]) - counts[order]), counts[order]) + np.arange(len(tokens))
    tokens, freqs, home, sids, ns, counts = tokens[at], freqs[at], home[order], sids[order], ns[order], counts[order]
    cut = np.flatnonzero(np.r_[True, home[1:] != home[:-1]]) if len(home) else np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    out: dict[str, list] = {c: [] for c in ("home", "tokens", "freqs", "sids", "ns", "counts")}
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(home)]):
        b, e = ends[i] - counts[i], ends[j - 1]
        out["home"].append(int(home[i]))
        out["tokens"].append(tokens[b:e].tobytes())
        out["freqs"].append(freqs[b:e].tobytes())
        for c, x in (("sids", sids), ("ns", ns), ("counts", counts.astype(np.uint32))):
            out[c].append(x[i:j].tobytes())
    return pa.table({c: pa.array(x, pa.int32() if c == "home" else pa.binary()) for c, x in out.items()})


LIVE = "sid long, n int, tokens binary, ones int, twos int"


def live_of_home(table: pa.Table, plan: Hot, percent: int) -> pa.Table:
    """The live sets of a home: shared tokens in order of class, frequency and hash, and how many are of class 1 and 2."""
    tokens, freqs, sids, ns, counts = (_joined(table.column(c)).view(t) for c, t in (("tokens", U64), ("freqs", np.uint16), ("sids", np.int64), ("ns", np.uint32), ("counts", np.uint32)))
    each, first, of = np.unique(sids, return_index=True, return_inverse=True)
    n = ns[first].astype(np.int64)
    shared = np.bincount(of, counts, len(each)).astype(np.int64)
    live = n - shared <= n - -(-percent * n // 100)
    owner = np.repeat(of, counts)
    keep = live[owner]
    tokens, freqs, owner = tokens[keep], freqs[keep], owner[keep]
    klass = np.where(freqs < PAIRS_FROM, 1, 2).astype(np.uint8)
    is_hot, at = plan.find(tokens)
    klass[is_hot] = plan.classes[at[is_hot]]
    freqs = np.where(is_hot, 0, freqs)
    order = np.lexsort((tokens, freqs, klass, owner))
    tokens, klass, owner = tokens[order], klass[order], owner[order]
    ones, twos = (np.bincount(owner, klass == x, len(each)).astype(np.int32) for x in (1, 2))
    ends = np.cumsum(np.where(live, shared, 0))
    which = np.flatnonzero(live)
    raw = [tokens[ends[i] - shared[i] : ends[i]].tobytes() for i in which.tolist()]
    return pa.table({"sid": each[which], "n": n[which].astype(np.int32), "tokens": pa.array(raw, pa.binary()), "ones": ones[which], "twos": twos[which]})


def live_sets(docs: DataFrame, plan: Hot, k: int, percent: int) -> DataFrame:
    """Sets that can match another, with the tokens they share with others: LIVE."""
    hot = docs.sparkSession.sparkContext.broadcast(plan)
    counted = scatter(docs, hot, k).groupBy("bucket").applyInArrow(lambda t: count_bucket(t, hot.value), "home int, " + RUNS)
    return counted.groupBy("home").applyInArrow(lambda t: live_of_home(t, hot.value, percent), LIVE)


def index(live: DataFrame, percent: int) -> DataFrame:
    """(key, sid) of every live set's index keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.unique(index_keys(t, *x, percent)) for t, *x in zip(_binaries(b.column(2), U64), *(b.column(i).to_pylist() for i in (1, 3, 4)))]
            sids = np.repeat(b.column(0).to_numpy(), [len(x) for x in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, U64), *keys]).view(np.int64)), pa.array(sids)], ["key", "sid"])

    return live.mapInArrow(run, "key long, sid long")


def shared_keys(rows: DataFrame) -> DataFrame:
    """Index rows whose key several sets have: key, sid, and centre, the set of the key that is least by hash.

    So most keys of a group of copies name the same few centres. Counts are stored before the join, so that both of its
    sides are shuffled and Spark can split skewed keys; so it is with the other sums that are joined back to their rows.
    """
    keys = rows.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("sid").alias("h"), "sid"))["sid"].alias("centre")).where("members > 1").select("key", "centre")
    return rows.join(stored(keys, "keys"), "key")


def _bins(size: DataFrame, column: str) -> int:
    total = size.agg(F.coalesce(F.sum(column), F.lit(0)).alias("t")).first()["t"]
    return max(1, -(-total // BLOCK_TOKENS))


def star_links(shared: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the sets that link with the centre that most of their keys name.

    Each set travels once, to its centre; the centre travels to as many salts as its sets need.
    """
    best = shared.where("sid != centre").groupBy("sid", "centre").count().groupBy("sid").agg(F.max(F.struct("count", "centre"))["centre"].alias("centre"))
    best = stored(best.join(live.select("sid", (F.length("tokens") / 8).cast("long").alias("size")), "sid"), "best")
    salts = stored(best.groupBy("centre").agg(F.ceil(F.sum("size") / BLOCK_TOKENS).cast("int").alias("salts")), "salts")
    bins = _bins(best, "size")
    salt = F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int").alias("salt")
    ways = best.join(salts, "centre").select("sid", "centre", salt).unionByName(salts.select(F.col("centre").alias("sid"), "centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    rows = ways.join(live.select("sid", "n", "tokens"), "sid").withColumn("bin", F.pmod(F.xxhash64("centre", "salt"), F.lit(bins)))

    def run(table: pa.Table) -> pa.Table:
        sid, centre, salt, n = (table.column(c).to_numpy() for c in ("sid", "centre", "salt", "n"))
        sets = _binaries(table.column("tokens"), U64)
        order = np.lexsort((sid != centre, salt, centre))  # of each centre and salt, the centre first
        a, b = [], []
        middle, inside = -1, np.zeros(0, U64)
        for i in order.tolist():
            if sid[i] == centre[i]:
                middle, inside = i, np.sort(sets[i])
                continue
            at = np.minimum(np.searchsorted(inside, sets[i]), len(inside) - 1)
            common = int(np.count_nonzero(inside[at] == sets[i]))
            if 100 * common >= percent * (int(n[i]) + int(n[middle]) - common):
                a.append(int(sid[i]))
                b.append(int(centre[i]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = stored(rows.groupBy("bin").applyInArrow(run, "a long, b long"), "star")
    discard(best, salts)
    return links


def components(links: DataFrame) -> DataFrame:
    """sid and comp, the least sid reachable, of every set with a link: labels spread to neighbours, then jump to their label's label."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("u").alias("sid")).agg(F.min("v").alias("m")).select("sid", F.least("sid", "m").alias("comp"), F.lit(True).alias("changed")), "labels")
    while True:
        near = edges.join(labels.select(F.col("sid").alias("v"), "comp"), "v").groupBy(F.col("u").alias("sid")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "sid").select("sid", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("sid").alias("low"), F.col("comp").alias("far"))
        after = lower.join(jump, "low").select("sid", F.least("low", "far").alias("next"), "comp")
        before, labels = labels, stored(after.select("sid", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("changed")), "labels")
        discard(before)
        if labels.where("changed").isEmpty():
            discard(edges)
            return labels


def open_members(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """sid, comp and cluster of the members of keys that still have several components.

    A cluster is what such keys connect, linked or not: pairs that can still link are of one cluster.
    """
    known = shared.join(labels.select("sid", "comp"), "sid", "left").select("key", "sid", "centre", F.coalesce("comp", "sid").alias("comp"))
    split = stored(known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "split")
    rows = stored(known.join(split, "key", "left_semi").select("sid", "comp", "centre").distinct(), "open")
    edges = rows.where("sid != centre").select(F.col("sid").alias("a"), F.col("centre").alias("b"))
    clusters = components(edges)
    out = stored(rows.select("sid", "comp").distinct().join(clusters.select("sid", F.col("comp").alias("cluster")), "sid"), "clusters")
    discard(rows, clusters, split)
    return out


def compare(sids: list[int], comps: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join components, of left sets with right ones: exact overlaps from a list of sets for each token.

    Members of components that a link has joined aren't linked again.
    """
    size = np.array([len(s) for s in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    role = np.repeat(right, size)
    order = np.argsort(codes[role], kind="stable")
    lists = np.repeat(np.arange(len(sets)), size)[role][order]
    begin = np.searchsorted(codes[role][order], np.arange(codes.max(initial=-1) + 2))
    root = np.unique(comps, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(left).tolist():
        if not (right & (root != root[i])).any():
            continue
        c = codes[ends[i] - size[i] : ends[i]]
        count = begin[c + 1] - begin[c]
        at = np.repeat(begin[c] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        common = np.bincount(lists[at], minlength=len(sets))
        for j in np.flatnonzero(100 * common >= percent * (n[i] + n - common)).tolist():
            if root[j] != root[i]:
                out.append((sids[i], sids[j]))
                root[root == root[j]] = root[i]
    return out


def block_links(members: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """(a, b) that link components of a cluster. Blocks have about BLOCK_TOKENS tokens, so a task's memory is bounded.

    Left are the members outside of the cluster's largest component, right all. A member goes to as many tasks as the other
    side has blocks, once if the cluster is of one block; nothing but links leaves a task.
    """
    sized = stored(members.join(live.select("sid", (F.length("tokens") / 8).cast("long").alias("size")), "sid"), "sized")
    parts = sized.groupBy("cluster", "comp").agg(F.sum("size").alias("size"))
    sides = parts.groupBy("cluster").agg(F.max(F.struct("size", "comp"))["comp"].alias("main"), F.max("size").alias("most"), F.sum("size").alias("all"))
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / BLOCK_TOKENS)).cast("int")
    sides = sides.select("cluster", "main", blocks(F.col("all") - F.col("most")).alias("lefts"), blocks(F.col("all")).alias("rights"))
    sides = stored(sides, "sides")
    h = F.xxhash64("sid")
    rows = sized.join(sides, "cluster").withColumn("left", F.col("comp") != F.col("main")).withColumn("l", F.pmod(h, "lefts").cast("int")).withColumn("r", F.pmod(h, "rights").cast("int"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda x: F.struct(x.alias("lo"), F.col("r").alias("hi")))
    as_left = F.transform(F.filter(F.sequence(F.lit(0), F.col("rights") - 1), lambda y: y != F.col("r")), lambda y: F.struct(F.col("l").alias("lo"), y.alias("hi")))
    rows = rows.withColumn("to", F.explode(F.when(F.col("left"), F.concat(as_right, as_left)).otherwise(as_right))).withColumn("lo", F.col("to.lo")).withColumn("hi", F.col("to.hi"))
    bins = _bins(sized, "size")
    rows = rows.select(F.pmod(F.xxhash64("cluster", "lo", "hi"), F.lit(bins)).alias("bin"), "cluster", "lo", "hi", "sid", "comp", (F.col("left") & (F.col("l") == F.col("lo"))).alias("left"), (F.col("r") == F.col("hi")).alias("right"))
    rows = rows.join(live.select("sid", "n", "tokens"), "sid")

    def run(table: pa.Table) -> pa.Table:
        cluster, lo, hi, sid, comp, n = (table.column(c).to_numpy() for c in ("cluster", "lo", "hi", "sid", "comp", "n"))
        left, right = (np.array(table.column(c).to_pylist(), bool) for c in ("left", "right"))
        sets = _binaries(table.column("tokens"), U64)
        order = np.lexsort((sid, hi, lo, cluster))  # a fixed order, as rows arrive in any
        key = np.stack([cluster, lo, hi])[:, order]
        cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        found: list[tuple[int, int]] = []
        for w in np.split(order, cut[1:]):
            found += compare(sid[w].tolist(), comp[w], left[w], right[w], n[w].astype(np.int64), [sets[i] for i in w.tolist()], percent)
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = stored(rows.groupBy("bin").applyInArrow(run, "a long, b long"), "blocks")
    discard(sized, sides)
    return links


def jaccard_join(df: DataFrame, text: str = "text", id: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links between similar texts, as classes: id, n_shingles, component_id, a row per document.

    Two documents link if 100 * |A and B| >= percent * |A or B| over their distinct k-word shingles (a text of fewer
    words is one shingle). component_id is the least id reachable by links, itself included. Equal sets are
    handled as one, so copies cost nothing beyond their row; no link between components is lost, as
    candidates are complete: sets are left out only when they are connected already, or when more than they may lack is
    in no other set. Shingles are told apart by hashes of 64 bits, or, in small corpora, by 48 bits and those of the
    bucket. Null texts and texts without words have no shingles and no links. Rows with equal ids keep a
    row each; a null id comes last among ids, so it is a component's id only if no other is. Other columns aren't read.
    The tables that the returned rows are made of stay in the checkpoint folder; others are deleted.
    """
    ship(df.sparkSession)
    docs = df.select(F.col(id).alias("__id"), F.col(text).cast("string").alias("__text"))
    described = stored(describe(docs, k), "described")
    rows = described.where("token IS NULL")
    live = stored(live_sets(docs, hot_tokens(described), k, percent), "live")
    keys = stored(index(live, percent), "index")
    shared = stored(shared_keys(keys), "shared")
    discard(keys)  # what counts its keys is small, and stays
    stars = star_links(shared, live, percent)
    labels = components(stars)
    members = open_members(shared, labels)
    discard(shared)
    if not members.isEmpty():
        blocks = block_links(members, live, percent)
        discard(labels)
        labels = components(stars.unionByName(blocks))
        discard(blocks)
    discard(stars, members, live)
    known = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("__id").alias("__rid")).join(labels.select("sid", "comp"), "sid", "left").select("sid", "__rid", F.coalesce("comp", "sid").alias("comp"))
    known = stored(known, "sets")
    discard(labels)
    least = stored(known.groupBy("comp").agg(F.min("__rid").alias("component_id")), "components")
    of_set = known.join(least, "comp").select("sid", "component_id")
    out = rows.select("__id", "n", "sid").join(of_set, "sid", "left")
    return out.select(F.col("__id").alias(id), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "__id").alias("component_id"))
