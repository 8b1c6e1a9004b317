"""Byte-level BPE from a public tokenizer file: two batch engines over the same merge table.

`RankRounds` counts tokens by rank-synchronous merging over ragged arrays; `SegmentTrees`
encodes with one tournament tree of pair ranks per pre-token. Both see a text as chunks,
each a run of spaces and line feeds followed by a run of other characters. The pre-token
pattern never matches across the end of such a run, so a chunk's tokens don't depend on
its surroundings and are remembered under the chunk's hash, in a bounded memo that compares bytes. Texts with
other white space or special-token strings are split by the pattern itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex

from tessella.llm.ragged import U64, hashes, separators

NONE = np.int64(1) << 40
MEMO = 1 << 18
TREE_LEAVES = 32
#: bytes compared at a time
COMPARED = 1 << 20


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tables:
    """Vocabulary and merges of a byte-level BPE file for the tokenizers library, as arrays."""

    def __init__(self, raw: bytes | str):
        spec = json.loads(raw)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without normalizer and prefix space are supported")
        vocab = model["vocab"]
        letters = _byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.pairs = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(left, right))}
        self._bits = 20
        self._keys = np.full((1 << self._bits) + 64, -1, np.int64)
        self._ranks = np.full((1 << self._bits) + 64, NONE, np.int64)
        for key, rank, at in zip((left << 20 | right).tolist(), range(len(left)), self._slot(left << 20 | right).tolist()):
            while self._keys[at] >= 0 and self._keys[at] != key:
                at += 1
            if self._keys[at] < 0:
                self._keys[at], self._ranks[at] = key, rank
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self._bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NONE if it has none."""
        key = left << 20 | right
        at = self._slot(key)
        found = self._keys[at]
        out = np.where(found == key, self._ranks[at], NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] += 1
            found = self._keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self._ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans' elements, one span after the other."""
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Tokens:
    """Pre-tokens as ragged bytes."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        self.data, self.lengths = data, lengths

    @classmethod
    def of(cls, tokens: list[bytes]) -> Tokens:
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens)))


class RankRounds:
    """Token counts: every sequence applies all occurrences of its lowest-rank pair, in rounds, until none merges."""

    @staticmethod
    def count(tables: Tables, tokens: Tokens, batch: int = 1 << 15) -> np.ndarray:
        """Tokens of each pre-token; `batch` sequences go at a time."""
        ends = np.cumsum(tokens.lengths)
        out = [np.zeros(0, np.int64)]
        for i in range(0, len(ends), batch):
            lengths = tokens.lengths[i : i + batch]
            first = ends[i] - lengths[0]
            out.append(RankRounds._count(tables, tables.byte_id[tokens.data[first : first + lengths.sum()]], lengths))
        return np.concatenate(out)

    @staticmethod
    def _count(tables: Tables, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = lengths.copy()
        live = np.arange(len(lengths))
        while True:
            several = lengths > 1
            if not several.all():
                symbols = symbols[np.repeat(several, lengths)]
                live, lengths = live[several], lengths[several]
            if not len(live):
                return out
            starts = np.cumsum(lengths) - lengths
            ranks = np.empty(len(symbols), np.int64)
            ranks[:-1] = tables.ranks(symbols[:-1], symbols[1:])
            ranks[starts + lengths - 1] = NONE
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest < NONE
            if not going.all():
                kept = np.repeat(going, lengths)
                symbols, ranks = symbols[kept], ranks[kept]
                live, lengths, lowest = live[going], lengths[going], lowest[going]
                if not len(live):
                    return out
            at = ranks == np.repeat(lowest, lengths)
            if (at[1:] & at[:-1]).any():
                # overlapping occurrences (x x x): the leftmost of a run goes first, then every other one
                where = np.flatnonzero(at)
                first = np.ones(len(where), bool)
                first[1:] = np.diff(where) > 1
                begin = np.maximum.accumulate(np.where(first, where, 0))
                at[where[(where - begin) % 2 == 1]] = False
            symbols[at] = tables.merged[ranks[at]]
            dropped = np.zeros(len(symbols), bool)
            dropped[1:] = at[:-1]
            lengths = lengths - np.add.reduceat(dropped.astype(np.int64), np.cumsum(lengths) - lengths)
            symbols = symbols[~dropped]
            out[live] = lengths


class SegmentTrees:
    """Encoding: a tree of minima over the pair ranks of a pre-token; its root is the leftmost lowest-rank merge.

    A leaf holds rank * leaves + position, so the minimum also breaks ties to the left. A merge
    changes three leaves and the nodes above them. Pre-tokens of up to TREE_LEAVES pairs go in
    batches of equal-size trees, one numpy step a merge; longer ones have a tree of their own.
    """

    @staticmethod
    def encode(tables: Tables, tokens: Tokens, batch: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, one after the other; ids of each). `batch` trees go at a time."""
        lengths = tokens.lengths
        starts = np.cumsum(lengths) - lengths
        symbols = tables.byte_id[tokens.data]
        counts = lengths.copy()
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        leaves = 1
        while leaves <= TREE_LEAVES:
            which = np.flatnonzero((lengths - 1 <= leaves) & (lengths - 1 > leaves // 2))
            for i in range(0, len(which), batch):
                w = which[i : i + batch]
                flat, counts[w] = SegmentTrees._batch(tables, symbols, starts[w], lengths[w], leaves)
                pieces.append((w, flat))
            leaves *= 2
        for w in np.flatnonzero(lengths - 1 > TREE_LEAVES):
            flat = SegmentTrees._one(tables, symbols[starts[w] : starts[w] + lengths[w]].tolist())
            counts[w] = len(flat)
            pieces.append((np.array([w]), flat))
        at = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), np.int64)
        single = np.flatnonzero(lengths == 1)
        out[at[single]] = symbols[starts[single]]
        for w, flat in pieces:
            c = counts[w]
            out[np.repeat(at[w] - (np.cumsum(c) - c), c) + np.arange(len(flat))] = flat
        return out, counts

    @staticmethod
    def _batch(tables: Tables, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(starts), leaves + 1
        place = np.arange(width)
        used = place < lengths[:, None]
        symbols = np.zeros((n, width), np.int64)
        symbols[used] = gather(flat, starts, lengths)
        after = np.tile(place + 1, (n, 1)).ravel()
        before = np.tile(place - 1, (n, 1)).ravel()
        none = len(tables.merged) * leaves
        tree = np.empty((n, 2 * leaves), np.int64)
        ranks = tables.ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, leaves)
        tree[:, leaves:] = np.where(used[:, 1:] & (ranks < NONE), ranks * leaves + place[:-1], none)
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        symbols, used, tree = symbols.ravel(), used.ravel(), tree.ravel()
        rows = np.arange(n)

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
            base = rows * (2 * leaves)
            node = leaf + leaves
            tree[base + node] = value
            size = leaves
            while size > 1:
                node = node >> 1
                pair = base + 2 * node
                tree[base + node] = np.minimum(tree[pair], tree[pair + 1])
                size >>= 1

        while True:
            best = tree[rows * (2 * leaves) + 1]
            going = best < none
            if not going.all():
                rows, best = rows[going], best[going]
            if not len(rows):
                break
            at, rank = best % leaves, best // leaves
            base = rows * width
            right = after[base + at]
            symbols[base + at] = tables.merged[rank]
            used[base + right] = False
            beyond = after[base + right]
            after[base + at] = beyond
            last = right < leaves
            put(rows[last], right[last], none)
            value = np.full(len(rows), none)
            has = np.flatnonzero(beyond < lengths[rows])
            before[base[has] + beyond[has]] = at[has]
            r = tables.ranks(symbols[base[has] + at[has]], symbols[base[has] + beyond[has]])
            value[has] = np.where(r < NONE, r * leaves + at[has], none)
            put(rows, at, value)
            left = before[base + at]
            has = np.flatnonzero(left >= 0)
            if len(has):
                r = tables.ranks(symbols[base[has] + left[has]], symbols[base[has] + at[has]])
                put(rows[has], left[has], np.where(r < NONE, r * leaves + left[has], none))
        return symbols[used], used.reshape(n, width).sum(1)

    @staticmethod
    def _one(tables: Tables, symbols: list[int]) -> np.ndarray:
        n, pairs, merged = len(symbols), tables.pairs, tables.merged
        leaves = 1 << (n - 2).bit_length()
        none = len(merged) * leaves
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            rank = pairs.get((symbols[i], symbols[i + 1]))
            if rank is not None:
                tree[leaves + i] = rank * leaves + i
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def put(leaf: int, value: int) -> None:
            node = leaf + leaves
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], leaves)
            right = after[at]
            symbols[at] = int(merged[rank])
            symbols[right] = -1
            beyond = after[at] = after[right]
            if right < n - 1:
                put(right, none)
            rank = None
            if beyond < n:
                before[beyond] = at
                rank = pairs.get((symbols[at], symbols[beyond]))
            put(at, none if rank is None else rank * leaves + at)
            left = before[at]
            if left >= 0:
                rank = pairs.get((symbols[left], symbols[at]))
                put(left, none if rank is None else rank * leaves + left)
        return np.array([s for s in symbols if s >= 0], np.int64)


_GAP = separators(b" \n")
_ODD = separators([0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F])
_LEAD = separators([0xC2, 0xE1, 0xE2, 0xE3])
_WIDE_SPACE = re.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


_LETTER = separators([*range(65, 91), *range(97, 123)])
_ALNUM = _LETTER | separators(range(48, 58))
_MARK = separators([b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"])


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin, and which bytes are surely of letters (ASCII, or U+00C0 to U+00FF).

    Chunks begin at each document, at a gap after other characters, and at an ASCII mark
    (but the apostrophe) after a letter or digit.
    """
    n = len(data)
    gap = _GAP[data]
    letter = _LETTER[data]
    latin = np.flatnonzero(data == 0xC3)
    latin = latin[latin + 1 < n]
    follow = data[latin + 1]
    latin = latin[(follow != 0x97) & (follow != 0xB7)]
    letter[latin] = letter[latin + 1] = True
    start = np.zeros(n, bool)
    start[1:] = gap[1:] & ~gap[:-1] | _MARK[data[1:]] & (letter | _ALNUM[data])[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start), letter


def plain(tables: Tables, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents have no white space but spaces and line feeds, and no special token's string."""
    n = len(offsets) - 1
    out = np.ones(n, bool)
    odd = np.flatnonzero(_ODD[data])
    out[np.searchsorted(offsets, odd, "right") - 1] = False
    raw = data.tobytes() if tables.special else b""
    special = any(s.encode() in raw for s in tables.special)
    lead = np.unique(np.searchsorted(offsets, np.flatnonzero(_LEAD[data]), "right") - 1) if not special else np.arange(n)
    for i in lead.tolist():
        text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
        if _WIDE_SPACE.search(text) or special and tables.specials.search(text):
            out[i] = False
    return out


def pre_tokens(tables: Tables, text: str) -> list[str | int]:
    """The pre-tokens of any text; a special token's string gives its id."""
    if not tables.specials:
        return tables.split.findall(text)
    out: list = []
    at = 0
    for m in tables.specials.finditer(text):
        out += tables.split.findall(text[at : m.start()])
        out.append(tables.special[m[0]])
        at = m.end()
    return out + tables.split.findall(text[at:])


class Memo:
    """Sorted chunk hashes with each chunk's bytes and what it gives. New ones gather in small tables first; when full, all starts anew."""

    def __init__(self, most: int = MEMO) -> None:
        self.most, self.tables = most, []

    def learn(self, keys: np.ndarray, raw: np.ndarray, values: tuple[np.ndarray, ...]) -> None:
        values = (raw, *values)
        size = sum(len(k) for k, _ in self.tables)
        if size + len(keys) > self.most:
            self.tables = []
        while self.tables and (len(self.tables[-1][0]) < 4 * len(keys) or len(self.tables) > 3):
            k, v = self.tables.pop()
            keys, values = np.concatenate([k, keys]), tuple(np.concatenate(x) for x in zip(v, values))
        order = np.argsort(keys, kind="stable")
        self.tables.append((keys[order], tuple(v[order] for v in values)))

    def fill(self, keys: np.ndarray, raw: np.ndarray, values: tuple[np.ndarray, ...]) -> np.ndarray:
        """Puts what is known of the chunks into values; returns where nothing is known. A hash alone doesn't count: the bytes must be equal."""
        unknown = np.arange(len(keys))
        for k, (known_raw, *known) in self.tables:
            at = np.minimum(np.searchsorted(k, keys[unknown]), len(k) - 1)
            hit = (k[at] == keys[unknown]) & (known_raw[at] == raw[unknown])
            for v, x in zip(values, known):
                v[unknown[hit]] = x[at[hit]]
            unknown = unknown[~hit]
        return unknown


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans from a on equal those from b on, each of its length; in blocks, to bound memory."""
    out = np.ones(len(a), bool)
    i, ends = 0, np.cumsum(lengths)
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + COMPARED, "right")))
        n = lengths[i:j]
        last = np.cumsum(n)
        place = np.arange(last[-1]) - np.repeat(last - n, n)
        unequal = data[np.repeat(a[i:j], n) + place] != data[np.repeat(b[i:j], n) + place]
        out[i + np.repeat(np.arange(j - i), n)[unequal]] = False
        i = j
    return out


class Chunks:
    """The distinct chunks of some texts, by hash.

    keys: their hashes. start, end, raw: an example of each. word: whether it is one word, letters that chunk_starts()
    knows after one space or none, which is one pre-token. which: the distinct chunk of each chunk; per_doc: chunks of
    each document. odd: documents with a chunk that differs from the example of its hash.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, letter = chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        self.keys, example, self.which = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(letter, out=sums[1:])
        s, e = self.start, self.end = starts[example], ends[example]
        word = sums[e] - sums[s] == e - s - (data[s] == 0x20)
        self.word = word & (sums[e] > sums[s])
        self.per_doc = np.diff(np.searchsorted(starts, offsets))
        flat = data.tobytes()
        self.raw = np.empty(len(s), object)
        self.raw[:] = [flat[x:y] for x, y in zip(s.tolist(), e.tolist())]
        size = ends - starts
        equal = size == (e - s)[self.which]
        equal[equal] = same_bytes(data, starts[equal], s[self.which[equal]], size[equal])
        self.odd = np.unique(np.searchsorted(offsets, starts[~equal], "right") - 1)


class Split:
    """The distinct pre-tokens of some chunks, and each chunk's as positions in them."""

    def __init__(self, tables: Tables, data: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray):
        ids: dict[bytes, int] = {}
        owner, token = [], []
        other = np.flatnonzero(~word)
        for k, s, e in zip(other.tolist(), start[other].tolist(), end[other].tolist()):
            for t in tables.split.findall(data[s:e].tobytes().decode()):
                owner.append(k)
                token.append(ids.setdefault(t, len(ids)))
        words = np.flatnonzero(word)
        lengths = (end - start)[words]
        marks = Tokens.of([t.encode() for t in ids])
        self.tokens = Tokens(np.concatenate([marks.data, gather(data, start[words], lengths)]), np.concatenate([marks.lengths, lengths]))
        owner, token = np.array(owner, np.int64), np.array(token, np.int64)
        self.owner = np.concatenate([owner, words])
        self.token = np.concatenate([token, len(ids) + np.arange(len(words))])
        self.n = len(start)
