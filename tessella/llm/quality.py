"""Quality rules (operator 6): counts of words, symbols and repeats, and bands of zstandard ratios."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ship, widened
from tessella.llm.ragged import SPACES, buffers, hashes, separators, spans, windows

#: least and most bytes per compressed byte, by length in bytes from which they hold, where no labels tell better
BANDS = ((0, 0.0, 1e9), (128, 1.0, 2.4), (256, 1.12, 2.6), (512, 1.27, 2.8), (1024, 1.42, 3.0), (2048, 1.55, 3.2), (4096, 1.65, 3.5), (16384, 1.7, 3.9), (65536, 1.7, 4.3))
CHUNK = 4096
#: bytes of the smaller chunks, by length in bytes from which they are cut; a noisy passage can't hide among prose in them
SMALL = ((256, 256), (1024, 512), (4096, 1024))
#: share of a text's chunks of a size that may lie outside their band
OUTSIDE = 0.05
LEVEL = 3
#: fitted limits: length bands to a doubling, least good texts of a band, share of the good ones inside, and what is added to both limits
STEPS, LEAST_TEXTS, INSIDE, MARGIN = 2, 50, 0.998, 0.01
#: up to so many good ids are sent to all executors, so that only their texts are measured; of more, all texts are and the measures meet the ids
EARLY = 1 << 20
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_SYMBOL = separators(b"#*$%&|<>")
_NEWLINE = separators(b"\n")


def band(size: int, bands=BANDS) -> tuple[float, float]:
    """The limits for a text of `size` bytes."""
    least, most = bands[0][1:]
    for at, low, high in bands:
        if size >= at:
            least, most = low, high
    return least, most


class CompressionBands:
    """Ratios of the whole text and of its chunks against limits that depend on the length."""

    def __init__(self, bands=BANDS, chunk: int = CHUNK, outside: float = OUTSIDE, level: int = LEVEL, small=SMALL, chunk_bands=BANDS):
        self.bands, self.chunk_bands, self.chunk, self.outside, self.small = bands, chunk_bands, chunk, outside, small
        self.press = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.press.compress(raw)) if raw else 0.0

    def share(self, raw: bytes, size: int) -> float:
        """Share of the chunks of `size` bytes outside their band; the last one ends where the text ends, so it may overlap."""
        least, most = band(size, self.chunk_bands)
        starts = [*range(0, len(raw) - size, size), len(raw) - size]
        return sum(not least <= self.ratio(raw[i : i + size]) <= most for i in starts) / len(starts)

    def verdict(self, raw: bytes) -> tuple[float, float, bool]:
        """(ratio, largest share of chunks of a size outside their band, kept). Texts of less than the least chunk have none."""
        whole = self.ratio(raw)
        low, high = band(len(raw), self.bands)
        sizes = {n for at, n in self.small if len(raw) >= at and n <= len(raw)}
        sizes = {max(sizes)} if sizes else sizes
        if len(raw) >= self.chunk:
            sizes.add(self.chunk)
        share = max((self.share(raw, n) for n in sizes), default=0.0)
        return whole, share, low <= whole <= high and share <= self.outside


def _counts(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each span; spans are in order and don't overlap. Nothing of the flags' length is made."""
    out = np.zeros(len(starts), np.int64)
    some = ends > starts
    if some.any():
        cuts = np.stack([starts[some], ends[some]], 1).reshape(-1)
        last = cuts[-1] == len(flags)
        out[some] = np.add.reduceat(flags.view(np.uint8), cuts[:-1] if last else cuts, dtype=np.int64)[::2]
    return out


def _repeated(grams: np.ndarray) -> int:
    """Words in windows that occur twice; grams are the hashes of a text's windows."""
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams) + REPEAT_WINDOW, np.int32)
    twice[order[1:][same]] = twice[order[:-1][same]] = 1
    cover = np.cumsum(twice)
    cover[REPEAT_WINDOW:] -= cover[:-REPEAT_WINDOW].copy()
    return int(np.count_nonzero(cover[:-1]))


def measure(column: pa.Array, bands: CompressionBands, most: int = 1 << 20) -> dict[str, np.ndarray]:
    """Counts and verdicts of each text; texts go in runs of about `most` bytes, a longer one alone."""
    data, offsets = buffers(column)
    parts = []
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        parts.append(_measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bands))
        i = j
    empty = _measure(data[:0], np.zeros(1, np.int64), bands)
    return {k: np.concatenate([p[k] for p in parts]) if parts else empty[k] for k in empty}


def _measure(data: np.ndarray, offsets: np.ndarray, bands: CompressionBands) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, counts = spans(data, offsets, SPACES)
    h = hashes(data, starts, ends)
    last = np.cumsum(counts)
    in_words = np.concatenate([[0], np.cumsum(_counts((data & 0xC0) != 0x80, starts, ends))])
    grams, whole = windows(h, counts, REPEAT_WINDOW)
    line_start, line_end, lines = spans(data, offsets, _NEWLINE)
    line_hash = hashes(data, line_start, line_end)
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_last = np.cumsum(lines)
    repeat, dup, ratio, share, verdict = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    for i in range(n):
        b, e = last[i] - counts[i], last[i]
        if counts[i] > REPEAT_WINDOW:
            repeat[i] = _repeated(grams[b : e - REPEAT_WINDOW + 1])
        x = line_hash[line_last[i] - lines[i] : line_last[i]][worded[line_last[i] - lines[i] : line_last[i]]]
        dup[i] = len(x) - len(np.unique(x)) if len(x) > 1 else 0
        ratio[i], share[i], verdict[i] = bands.verdict(data[offsets[i] : offsets[i + 1]].tobytes())
    failed = (counts < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * counts)
    return {
        "n_words": counts.astype(np.int64),
        "word_chars": in_words[last] - in_words[last - counts],
        "n_symbols": _counts(_SYMBOL[data], offsets[:-1], offsets[1:]),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "base_failed": failed,
        "ratio": ratio,
        "chunks_outside": share,
        "kept": verdict & ~failed,
    }


def _limits(found: list[tuple[int, int]]) -> tuple[float, float] | None:
    """The ratios within which INSIDE of a band's texts lie, moved by MARGIN; found: (ratio in hundredths, texts that have it)."""
    cents, counts = (np.array(x) for x in zip(*sorted(found)))
    upto = np.cumsum(counts)
    n = int(upto[-1])
    if n < LEAST_TEXTS:
        return None
    cut = int((1 - INSIDE) * n)
    low, high = cents[np.searchsorted(upto, [cut, n - 1 - cut], "right")] / 100
    return float(low) - MARGIN, float(high) + MARGIN


def fit_bands(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", bands=BANDS) -> tuple:
    """Limits of the whole text's ratio by length, from labelled texts: BANDS narrowed to what good ones have.

    All rows whose id is labelled good (mean quality over a half) are used. In each of STEPS length bands to a
    doubling with LEAST_TEXTS good texts or more that pass the base rules and BANDS, INSIDE of them lie within the limits, which
    then are moved outwards by MARGIN. Ratios are counted to two decimals, so only counts reach the driver: some hundred a
    band, whatever the corpus. No text is shuffled. Without labels the limits stay. Null ids and labels don't count; each row of an id does.
    """
    ship(docs.sparkSession)
    good = labels.where(F.col("quality").isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("__lid")).agg(F.avg("quality").alias("q")).where("q > 0.5").select("__lid")
    rows = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("__id"), F.col(text).cast("string").alias("__text"))
    same = F.col("__id") == F.col("__lid")
    early = good.count() <= EARLY
    if early:
        rows = rows.join(F.broadcast(good), same, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = CompressionBands(bands)
        for b in batches:
            m = measure(b.column(1), judge)
            size = np.diff(buffers(b.column(1))[1])
            ok = m["kept"]
            step = np.floor(STEPS * np.log2(np.maximum(size[ok], 1)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(step.astype(np.int32)), pa.array(np.round(m["ratio"][ok] * 100).astype(np.int32))], ["__id", "step", "cents"])

    measured = rows.mapInArrow(run, widened(rows.select("__id").schema, "step int, cents int"))
    if not early:
        measured = measured.join(good, same, "left_semi")
    seen: dict[int, list[tuple[int, int]]] = {}
    for r in measured.groupBy("step", "cents").count().collect():
        seen.setdefault(r["step"], []).append((r["cents"], r["count"]))
    fitted = {step: limit for step, found in seen.items() if (limit := _limits(found))}
    edges = sorted({at for at, _, _ in bands} | {math.ceil(2 ** (s / STEPS)) for step in fitted for s in (step, step + 1)})
    out = []
    for at in edges:
        low, high = band(at, bands)
        limit = fitted.get(math.floor(STEPS * math.log2(max(at, 1))))
        out.append((at, max(low, limit[0]), min(high, limit[1])) if limit else (at, low, high))
    return tuple(out)


_TYPES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "ratio": "double", "chunks_outside": "double", "kept": "boolean"}


def quality(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bands=BANDS, chunk: int = CHUNK, outside: float = OUTSIDE) -> DataFrame:
    """Counts and verdict for every whole text: `keep` columns, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, chunks_outside, kept.

    Compression bands: a text is kept if the base rules hold, its zstandard ratio lies within the
    limits for its length (`bands`, or those that fit_bands() learns from labels), and at most `outside` of its chunks lie outside theirs: chunks of `chunk` bytes and
    smaller ones by length, to the end of the text. Null and empty
    texts have no words, so they fail the base rules. One pass without shuffle: ties and repeated rows
    are judged alike. `keep` may hold every column, so that a filter can follow; a kept column of a
    result's name is overwritten.
    """
    ship(df.sparkSession)
    keep = tuple(c for c in keep if c not in _TYPES)
    schema = df.select(*keep).schema
    for name, kind in _TYPES.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = CompressionBands(bands, chunk, outside)
        for b in batches:
            m = measure(b.column(b.num_columns - 1), judge)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(m[k]) for k in _TYPES)], [*keep, *_TYPES])

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
