"""License scans (operator 7): diagonal voting of word k-grams against short license texts."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ship, widened
from tessella.llm.ragged import NOT_ALNUM, U64, buffers, hashes, lower_ascii, mix64, spans

#: fixed values: phrases whose every place counts, and their labels
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: fixed values: further texts, found even if some of their words differ
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution share alike", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
K = 2
#: how far the diagonals of one notice may lie apart: words put in and left out between its first and its last
SPREAD = 8
#: share of a notice's k-grams that must be verified in order
LEAST = 0.8
#: k-grams that travel in a row
PIECE = 4096


def _grams(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, its k-grams, and for each k-gram two independent hashes."""
    data, offsets = buffers(column)
    data = lower_ascii(data)
    starts, ends, counts = spans(data, offsets, NOT_ALNUM)
    h = hashes(data, starts, ends)
    first, second = h.copy(), mix64(h ^ U64(0x5851F42D4C957F2D))
    n = len(h)
    a, b = np.zeros(n, U64), np.zeros(n, U64)
    for j in range(min(k, n)):
        a[: n - j] = a[: n - j] * U64(0x9FB21C651E98DF25) + first[j:]
        b[: n - j] = b[: n - j] * U64(0xD6E8FEB86659FD93) + second[j:]
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    whole = left >= k
    return counts, np.maximum(counts - k + 1, 0), mix64(a)[whole].view(np.int64), mix64(b)[whole].view(np.int64)


def templates(base=BASE, notices=NOTICES, k: int = K) -> list[tuple]:
    """(gram, check, template, position, k-grams of the template, label, is base) of every k-gram of every template."""
    out = []
    for t, (phrase, label, is_base) in enumerate([*((p, x, True) for p, x in base), *((p, x, False) for p, x in notices)]):
        _, n, a, b = _grams(pa.array([phrase]), k)
        if n[0] < 1:
            raise ValueError(f"{phrase!r} has fewer than {k} words")
        out += [(int(g), int(c), t, i, int(n[0]), label, is_base) for i, (g, c) in enumerate(zip(a, b))]
    return out


def in_order(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of (text position, template position) in which both rise."""
    ends: list[int] = []  # least template position that a run of each length ends with
    last: list[int] = []
    before = [-1] * len(hits)
    hits = sorted(hits, key=lambda x: (x[0], -x[1]))
    for i, (_, at) in enumerate(hits):
        j = bisect.bisect_left(ends, at)
        ends[j : j + 1] = [at]
        last[j : j + 1] = [i]
        before[i] = last[j - 1] if j else -1
    out = []
    i = last[-1] if last else -1
    while i >= 0:
        out.append(hits[i])
        i = before[i]
    return out[::-1]


def verify(hits: list[tuple[int, int, bool]], size: int, k: int = K, least: float = LEAST) -> tuple[int, int, float] | None:
    """(first word, last word, share of the template's k-grams) of a span, if it holds.

    hits: text position, template position, whether the second hash agrees. Of those that agree, enough must stand in the
    template's order, and the span must not be longer than the template by more than the share that may be missing.
    """
    run = in_order([(p, t) for p, t, ok in hits if ok])
    while run and len(run) >= least * size:
        first, last = run[0][0], run[-1][0] + k - 1
        if last - first + 1 <= (size + k - 1) * (2 - least) + 1:
            return first, last, len(run) / size
        # a stray hit far off at either end makes a span too long
        run = run[1:] if run[1][0] - run[0][0] > run[-1][0] - run[-2][0] else run[:-1]
    return None


def find_spans(df: DataFrame, text: str = "text", id: str = "doc_id", base=BASE, notices=NOTICES, k: int = K, spread: int = SPREAD, least: float = LEAST) -> DataFrame:
    """Spans of license texts: __row, __id, n_words, label, is_base, first_word, last_word, share; and for each text a row without a label.

    Diagonal voting: every k-gram hash of a text is joined to the templates' positions; a hit votes for the diagonal
    text position - template position. A base phrase stands where its diagonal has all votes. Of a notice, the
    diagonals in a stretch of 2 * `spread` merge (stretches overlap by half, so diagonals within `spread` meet in one of
    them), and what they hold, at most a hit for each diagonal and template position, is verified: by a second, independent
    hash of each k-gram, by order and by length. A span may be found in two stretches.
    """
    spark = ship(df.sparkSession)
    rows = df.select(F.col(id).alias("__id"), F.col(text).cast("string").alias("__text"), F.monotonically_increasing_id().alias("__row"))
    keys = rows.select("__row", "__id").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, grams, a, c = _grams(b.column(1), k)
            pieces = np.maximum(1, -(-grams // PIECE))  # a row for each text at least
            of = np.repeat(np.arange(len(grams)), pieces)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.clip(grams[of] - nth * PIECE, 0, PIECE)
            pairs = pa.StructArray.from_arrays([pa.array(a), pa.array(c)], ["g", "c"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pairs)
            words = pa.array(counts[of], pa.int32(), mask=nth > 0)
            which = pa.array(of)
            yield pa.RecordBatch.from_arrays([b.column(2).take(which), b.column(0).take(which), words, pa.array((nth * PIECE).astype(np.int32)), lists], ["__row", "__id", "n_words", "start", "grams"])

    table = spark.createDataFrame(templates(base, notices, k), "gram long, check long, template int, at int, size int, label string, is_base boolean")
    words = rows.mapInArrow(run, widened(keys, "n_words int, start int, grams array<struct<g:bigint,c:bigint>>"))
    grams = words.select("__row", "__id", "n_words", "start", F.posexplode_outer("grams").alias("i", "x"))
    grams = grams.select("__row", "__id", F.when(F.coalesce("i", F.lit(0)) == 0, F.col("n_words")).alias("n_words"), (F.col("start") + F.col("i")).alias("pos"), F.col("x.g").alias("g"), F.col("x.c").alias("c"))
    # the row of the first k-gram, or of none, also stands for the text itself
    hits = grams.join(F.broadcast(table), F.col("g") == F.col("gram"), "left").where("template IS NOT NULL OR n_words IS NOT NULL")
    diagonal = F.col("pos") - F.col("at")
    halves = F.floor(diagonal / spread).cast("int")
    part = F.when(F.col("template").isNull(), F.array(F.lit(0))).when(F.col("is_base"), F.array(diagonal)).otherwise(F.array(halves, halves - 1))
    hits = hits.withColumn("part", F.explode(part))
    hit = F.struct("pos", "at", (F.col("c") == F.col("check")).alias("ok"))
    groups = hits.groupBy("__row", "__id", "template", "size", "label", "is_base", "part").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("c") == F.col("check")).cast("int").alias("votes"), F.collect_list(F.when(~F.col("is_base"), hit)).alias("hits"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, label, is_base, at, n_words, votes, found = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("size", "label", "is_base", "part", "n_words", "votes", "hits"))
            spans_: list[tuple] = []
            for s, x, base_, d, n, v, h in zip(size, label, is_base, at, n_words, votes, found):
                hold = None
                if base_ and v == s:
                    hold = d, d + s + k - 2, 1.0
                elif base_ is False and v >= least * s:
                    hold = verify([(y["pos"], y["at"], y["ok"]) for y in h], s, k, least)
                spans_.append((n, x, base_, *hold) if hold else (n, None, None, None, None, 0.0))
            kinds = (pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(zip(*spans_), kinds))], ["__row", "__id", *_SPAN])

    return groups.select("__row", "__id", "size", "label", "is_base", "part", "n_words", "votes", "hits").mapInArrow(check, widened(keys, "n_words int, label string, is_base boolean, first_word int, last_word int, share double"))


_SPAN = ("n_words", "label", "is_base", "first_word", "last_word", "share")


def scan(df: DataFrame, text: str = "text", id: str = "doc_id", base=BASE, notices=NOTICES, k: int = K, spread: int = SPREAD, least: float = LEAST) -> DataFrame:
    """License labels of every whole text: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    find_spans(), by text: places of base phrases are counted, their first words' least and greatest place given;
    score is the best share of any span, 0 if there is none. Rows are told apart by a row number, so
    repeated and null ids give a row each. Null and empty texts have no words and labels. The templates are a
    fixed list, so broadcasting them has a known bound; what is shuffled are hits alone. Other columns aren't read.
    """
    found = find_spans(df, text, id, base, notices, k, spread, least)
    place = F.when(F.col("is_base"), F.col("first_word"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = found.groupBy("__row", "__id").agg(
        F.coalesce(F.max("n_words"), F.lit(0)).cast("long").alias("n_words"),
        F.count(place).alias("n_base"),
        F.min(place).cast("long").alias("first_word"),
        F.max(place).cast("long").alias("last_word"),
        listed(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"),
        listed("label").alias("labels"),
        F.max("share").alias("score"),
    )
    return out.select(F.col("__id").alias(id), *out.columns[2:])
