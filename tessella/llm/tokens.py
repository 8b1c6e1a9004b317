"""Token counts (operator 4) and BPE encoding and decoding (operator 9)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bpe
from tessella.llm.common import ship, widened
from tessella.llm.ragged import buffers

_state: dict = {}


def _tables(key: str, raw) -> dict:
    """The parsed file and the memos of this worker process, kept over tasks."""
    if _state.get("key") != key:
        _state.clear()
        _state.update(key=key, tables=bpe.Tables(raw.value), counts=bpe.Memo(2 * bpe.MEMO), ids=bpe.Memo())
    return _state


def _file(df: DataFrame, path: str):
    with open(path, "rb") as f:
        raw = f.read()
    return hashlib.sha256(raw).hexdigest(), ship(df.sparkSession).sparkContext.broadcast(raw)


def _strings(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> list[str]:
    return [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in which]


def _groups(data: np.ndarray, offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents of about `most` bytes, one at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def count_batch(state: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and tokens of each text."""
    tables, memo = state["tables"], state["counts"]
    data_all, offsets_all = buffers(column)
    totals = []
    for i, j in _groups(data_all, offsets_all):
        data, offsets = data_all[offsets_all[i] : offsets_all[j]], offsets_all[i : j + 1] - offsets_all[i]
        total = np.zeros(j - i, np.int64)
        if len(data):
            c = bpe.Chunks(data, offsets)
            values = np.zeros(len(c.keys), np.int64)
            new = memo.fill(c.keys, c.raw, (values,))
            if len(new):
                parts = bpe.Split(tables, data, c.start[new], c.end[new], c.word[new])
                counts = bpe.RankRounds.count(tables, parts.tokens)
                fresh = np.bincount(parts.owner, counts[parts.token], parts.n).astype(np.int64)
                values[new] = fresh
                memo.learn(c.keys[new], c.raw[new], (fresh,))
            filled = c.per_doc > 0
            total[filled] = np.add.reduceat(values[c.which], (np.cumsum(c.per_doc) - c.per_doc)[filled])
            odd = np.union1d(np.flatnonzero(~bpe.plain(tables, data, offsets)), c.odd)
            for d, text in zip(odd, _strings(data, offsets, odd)):
                parts = bpe.pre_tokens(tables, text)
                plain = [p.encode() for p in parts if isinstance(p, str)]
                total[d] = len(parts) - len(plain) + int(bpe.RankRounds.count(tables, bpe.Tokens.of(plain)).sum())
        totals.append(total)
    return np.diff(offsets_all), np.concatenate(totals) if totals else np.zeros(0, np.int64)


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """Tokens of every whole text: `keep` columns, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Rank-synchronous array merging. The file at path `tokenizer` is a byte-level BPE of the
    tokenizers library; special-token strings in a text count as one token, as its default is.
    Null and empty texts have 0 bytes and tokens; ties and repeated rows are kept; no shuffle.
    Columns besides `keep` and `text` aren't read, so clashing names do no harm.
    """
    key, raw = _file(df, tokenizer)
    kept = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _tables(key, raw)
        for b in batches:
            size, n = count_batch(state, b.column(b.num_columns - 1))
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(size), pa.array(n), pa.array(n > limit)], [*keep, "n_bytes", "n_tokens", "over_limit"])

    schema = kept.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def encode_texts(tables: bpe.Tables, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text, by segment trees."""
    ids: dict[str, int] = {}
    parts = [[ids.setdefault(t, len(ids)) if isinstance(t, str) else -1 - t for t in bpe.pre_tokens(tables, x)] for x in texts]
    flat, counts = bpe.SegmentTrees.encode(tables, bpe.Tokens.of([t.encode() for t in ids]))
    ends = np.cumsum(counts)
    codes = [flat[e - c : e] for e, c in zip(ends.tolist(), counts.tolist())]
    empty = np.zeros(0, np.int64)
    return [np.concatenate([codes[t] if t >= 0 else np.array([-1 - t]) for t in p]) if p else empty for p in parts]


def decode(tables: bpe.Tables, ids) -> str:
    """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(tables.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _decimals(tables: bpe.Tables) -> tuple[np.ndarray, np.ndarray]:
    """Of each id: its decimal and a comma; its bytes."""
    n = max(tables.bytes_of) + 1
    return np.array([b"%d," % i for i in range(n)], object), np.array([tables.bytes_of.get(i, b"") for i in range(n)], object)


def _rendered(state: dict, data: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk: how many ids, the ids as decimals each followed by a comma, the bytes they decode to."""
    tables = state["tables"]
    if "decimals" not in state:
        state["decimals"] = _decimals(tables)
    parts = bpe.Split(tables, data, start, end, word)
    flat, counts = bpe.SegmentTrees.encode(tables, parts.tokens)
    order = np.argsort(parts.owner, kind="stable")
    token, owner = parts.token[order], parts.owner[order]
    c = counts[token]
    ids = bpe.gather(flat, (np.cumsum(counts) - counts)[token], c)
    n = np.bincount(owner, c, parts.n).astype(np.int64)
    decimals, raws = (x[ids].tolist() for x in state["decimals"])
    listed, raw = np.empty(parts.n, object), np.empty(parts.n, object)
    stop = 0
    for i, k in enumerate(n.tolist()):
        begin, stop = stop, stop + k
        listed[i] = b"".join(decimals[begin:stop])
        raw[i] = b"".join(raws[begin:stop])
    return n, listed, raw


def digest_batch(state: dict, column: pa.Array) -> tuple[list[int], list[str], list[str]]:
    """Per text: ids, SHA-256 of the comma-joined ids, SHA-256 of the text decoded from them."""
    tables, memo = state["tables"], state["ids"]
    data_all, offsets_all = buffers(column)
    n_ids: list[int] = []
    ids_sha: list[str] = []
    text_sha: list[str] = []
    for i, j in _groups(data_all, offsets_all):
        data, offsets = data_all[offsets_all[i] : offsets_all[j]], offsets_all[i : j + 1] - offsets_all[i]
        n, listed, raw = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, object)
        per_doc = np.zeros(j - i, np.int64)
        odd: dict[int, str] = {}
        if len(data):
            c = bpe.Chunks(data, offsets)
            per_doc = c.per_doc
            values = (np.zeros(len(c.keys), np.int64), np.empty(len(c.keys), object), np.empty(len(c.keys), object))
            new = memo.fill(c.keys, c.raw, values)
            if len(new):
                fresh = _rendered(state, data, c.start[new], c.end[new], c.word[new])
                for v, f in zip(values, fresh):
                    v[new] = f
                memo.learn(c.keys[new], c.raw[new], fresh)
            n, listed, raw = (v[c.which] for v in values)
            where = np.union1d(np.flatnonzero(~bpe.plain(tables, data, offsets)), c.odd)
            odd = dict(zip(where.tolist(), _strings(data, offsets, where)))
        stop = 0
        for d, c in enumerate(per_doc.tolist()):
            begin, stop = stop, stop + c
            if d in odd:
                codes = encode_texts(tables, [odd[d]])[0].tolist()
                count, ids, text = len(codes), "".join(f"{t}," for t in codes).encode(), decode(tables, codes).encode()
            else:
                count, ids, text = int(n[begin:stop].sum()), b"".join(listed[begin:stop].tolist()), b"".join(raw[begin:stop].tolist())
            n_ids.append(count)
            ids_sha.append(hashlib.sha256(ids[:-1]).hexdigest())
            text_sha.append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
    return n_ids, ids_sha, text_sha


def encode(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token ids of every whole text, without added special tokens: `keep` columns, ids array<int>.

    Segment trees over adjacent pair ranks. Null and empty texts give an empty array.
    """
    key, raw = _file(df, tokenizer)
    kept = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(key, raw)["tables"]
        for b in batches:
            ids = encode_texts(tables, [x or "" for x in b.column(b.num_columns - 1).to_pylist()])
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], [*keep, "ids"])

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, widened(kept, "ids array<int>"))


def decode_ids(df: DataFrame, tokenizer: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The text of every array of ids, special tokens included: `keep` columns, text. A null array gives an empty text."""
    key, raw = _file(df, tokenizer)
    kept = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(key, raw)["tables"]
        for b in batches:
            texts = [decode(tables, x or []) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, kept.add("text", "string"))


def encode_digest(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encode() and decode_ids() in one pass: `keep` columns, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids: both digests are that of the empty string. Rows and ties
    are kept as they are; no shuffle; columns besides `keep` and `text` aren't read.
    """
    key, raw = _file(df, tokenizer)
    kept = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _tables(key, raw)
        for b in batches:
            n, ids, texts = digest_batch(state, b.column(b.num_columns - 1))
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = kept.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
