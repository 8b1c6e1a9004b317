"""Toxicity (operator 2): a classifier chain of linear models over hashed words and word beginnings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ship
from tessella.llm.fingerprints import OnePermutation, sketches
from tessella.llm.ragged import NOT_ALNUM, U64, buffers, lower_ascii, mix64, prefix_hashes, spans

#: bytes of the word beginnings that are features beside whole words
BEGINNINGS = (4, 5, 6, 7, 8)
#: most labelled documents that the chain is trained on; they come to the driver
SAMPLE = 6000
#: longer labelled texts aren't trained on, so what reaches the driver is bounded in bytes too; every text is classified whole
SAMPLE_BYTES = 16 << 10
FEATURES = 500
#: texts whose features are held at a time
PART = 250
FOLDS = 5
#: languages whose toxicity is a category of its own, in the order of the chain; toxicity in any language comes last
LANGUAGES = ("en", "de", "fr", "es")
THRESHOLD = 0.5
PENALTY = 0.1
#: a feature is of at least so many toxic texts, and this part of them; at most one in so many speaks against toxicity
LEAST_TEXTS, LEAST_PART, AGAINST = 3, 0.005, 5


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) of every word and word beginning, not distinct, and words per text."""
    data, offsets = buffers(column)
    data = lower_ascii(data)
    starts, ends, counts = spans(data, offsets, NOT_ALNUM)
    doc = np.repeat(np.arange(len(counts)), counts)
    whole, *parts = prefix_hashes(data, starts, ends, BEGINNINGS)
    docs, found = [doc], [whole]
    for n, h in zip(BEGINNINGS, parts):
        longer = ends - starts > n
        docs.append(doc[longer])
        found.append(mix64(h[longer] ^ U64(0xA0761D6478BD642F)))
    return np.concatenate(docs), np.concatenate(found), counts


def _distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs."""
    doc, f, _ = features(pa.array(texts, pa.string()))
    order = np.lexsort((f, doc))
    doc, f = doc[order], f[order]
    new = np.ones(len(f), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (f[1:] != f[:-1])
    return doc[new], f[new]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 200) -> np.ndarray:
    """Weights (the last is the intercept) of an L2-penalised logistic model, by accelerated gradient steps."""
    n = len(y)
    w = np.zeros(x.shape[1] + 1, np.float32)
    if n == 0 or y.min() == y.max():
        w[-1] = 20.0 if n and y[0] else -20.0
        return w
    a = np.hstack([x, np.ones((n, 1), np.float32)])
    v = np.ones(a.shape[1], np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = np.float32(1 / (0.25 * np.linalg.norm(a @ v) ** 2 + penalty))
    y = y.astype(np.float32)
    reg = np.full(len(w), penalty, np.float32)
    reg[-1] = 0
    z, t = w.copy(), 1.0
    for _ in range(steps):
        new = z - step * (a.T @ (_sigmoid(a @ z) - y) + reg * z)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + np.float32((t - 1) / t2) * (new - w), new, t2
    return w


@dataclass
class Chain:
    """vocabulary: sorted feature hashes; models: for each category weights of the features, the earlier categories, 1."""

    categories: tuple[str, ...]
    vocabulary: np.ndarray
    models: list[np.ndarray]

    def design(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        """Distinct (text, place in the vocabulary) pairs, and the number of texts."""
        doc, f, counts = features(column)
        m = len(self.vocabulary)
        if not m or not len(f):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), len(counts)
        at = np.minimum(np.searchsorted(self.vocabulary, f), m - 1)
        hit = self.vocabulary[at] == f
        both = np.unique(doc[hit] * m + at[hit])
        return both // m, both % m, len(counts)

    def predict(self, column: pa.Array) -> np.ndarray:
        """Probability of each category (columns) for each text; later models read the earlier probabilities."""
        doc, at, n = self.design(column)
        m = len(self.vocabulary)
        p = np.zeros((n, len(self.models)))
        for j, w in enumerate(self.models):
            z = np.bincount(doc, w[at], n) + w[-1]
            p[:, j] = _sigmoid(z + p[:, :j] @ w[m : m + j])
        return p


def _different(texts: list[str]) -> list[int]:
    """Texts that aren't near copies of an earlier one: copies would make chance words look telling."""
    family = OnePermutation(8, 8)
    marks = [m for i in range(0, len(texts), PART) for m in sketches(family, pa.array(texts[i : i + PART], pa.string()))]
    seen: dict[tuple[int, int], set[int]] = {}
    out = []
    for i, m in enumerate(marks):
        votes: dict[int, int] = {}
        for place in enumerate(m):
            for j in seen.get(place, ()):
                votes[j] = votes.get(j, 0) + 1
        if max(votes.values(), default=0) < 5:
            out.append(i)
            for place in enumerate(m):
                seen.setdefault(place, set()).add(i)
    return out


def _telling(bad: np.ndarray, all_: np.ndarray, toxic: float, n: int, most: int) -> np.ndarray:
    """The features that tell most, by the log-odds ratio of toxic and other texts over its standard error; those for, and fewer against."""
    good = all_ - bad
    odds = np.log((bad + 0.5) / (toxic + 1)) - np.log((good + 0.5) / (n - toxic + 1))
    z = odds / np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    for_ = np.argsort(-z, kind="stable")[:most]
    against = np.argsort(z, kind="stable")[: most // AGAINST]
    return np.sort(np.concatenate([for_[z[for_] > 0], against[z[against] < -2]]))


def fit(texts: list[str], toxic: np.ndarray, languages: list[str | None] | None = None, folds: int = FOLDS, most: int = FEATURES, categories: tuple[str, ...] = LANGUAGES) -> Chain:
    """A chain trained on labelled texts. Deterministic: folds go by position.

    Categories: toxicity in each of some languages, as the labels and the texts' languages say, then toxicity in any. Each
    later model is trained on out-of-fold probabilities of the earlier categories, as it meets such at prediction. A
    category without toxic texts is never found.
    """
    chosen = _different(texts)
    spoken = np.array([(languages or [None] * len(texts))[i] or "" for i in chosen], object)
    texts, toxic = [texts[i] for i in chosen], np.asarray(toxic, float)[chosen]
    n = len(texts)
    least = max(LEAST_TEXTS, LEAST_PART * toxic.sum())
    # only features of enough toxic texts count; all texts are then read for those, in parts, to keep memory small
    of_toxic = [t for t, y in zip(texts, toxic) if y]
    f = np.concatenate([_distinct(of_toxic[i : i + PART])[1] for i in range(0, len(of_toxic), PART)] or [np.zeros(0, U64)])
    names, bad = np.unique(f, return_counts=True)
    names, bad = names[bad >= least], bad[bad >= least]
    pairs = []
    for i in range(0, n, PART):
        doc, f = _distinct(texts[i : i + PART])
        at = np.minimum(np.searchsorted(names, f), max(0, len(names) - 1))
        hit = names[at] == f if len(names) else np.zeros(len(f), bool)
        pairs.append((doc[hit] + i, at[hit]))
    doc, place = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
    telling = _telling(bad, np.bincount(place, minlength=len(names)), toxic.sum(), n, most)
    column = np.full(len(names), -1)
    column[telling] = np.arange(len(telling))
    x = np.zeros((n, len(telling)), np.float32)
    has = column[place] >= 0
    x[doc[has], column[place[has]]] = 1
    chain = tuple(f"toxic_{c}" for c in categories) + ("toxic",)
    fold = np.arange(n) % folds
    models: list[np.ndarray] = []
    known = x
    for name, language in zip(chain, (*categories, None)):
        y = toxic if language is None else toxic * (spoken == language)
        models.append(fit_linear(known, y))
        if language is None:
            break
        held_out = np.zeros(n)
        for k in range(folds):
            w = fit_linear(known[fold != k], y[fold != k])
            held_out[fold == k] = _sigmoid(known[fold == k] @ w[:-1] + w[-1])
        known = np.hstack([known, held_out[:, None].astype(np.float32)])
    return Chain(chain, names[telling], models)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, text: str = "text", id: str = "doc_id", language: str = "lang") -> tuple[list[str], np.ndarray, list[str | None]]:
    """At most `most` labelled texts of up to SAMPLE_BYTES each, their labels and languages: the least by a hash of their id.

    The same in each run. Null labels and ids don't count. Of several labels of a document the mean counts, toxic from a half on;
    of several texts of an id the greatest. Without a column of languages they are null.
    """
    l = labels.where(F.col("toxic").isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("__lid")).agg((F.avg("toxic") >= 0.5).alias("toxic"))
    short = docs.where(F.col(id).isNotNull() & (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) <= SAMPLE_BYTES))
    d = short.select(F.col(id).alias("__id"))
    # ids first, texts of the chosen ones after that
    few = l.join(d.distinct(), F.col("__lid") == F.col("__id"), "left_semi").orderBy(F.xxhash64("__lid"), "__lid").limit(most)
    spoken = F.col(language).cast("string") if language in docs.columns else F.lit(None).cast("string")
    rows = short.select(F.col(id).alias("__id"), F.struct(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), spoken.alias("lang")).alias("t")).join(F.broadcast(few), F.col("__id") == F.col("__lid"))
    rows = rows.groupBy("__id").agg(F.max("t").alias("t"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("__id"), "__id").select("t.text", "t.lang", "toxic").toArrow()
    return rows.column("text").to_pylist(), np.array(rows.column("toxic").to_pylist(), bool), rows.column("lang").to_pylist()


def classify(df: DataFrame, chain: Chain, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """`keep` columns, p_<category> of each category of the chain, is_toxic (the last one's reaches the threshold).

    Every whole text is read. Null and empty texts get what the intercepts say, which is not toxic. No shuffle: ties and
    repeated rows are judged alike.
    """
    spark = ship(df.sparkSession)
    names = [f"p_{c}" for c in chain.categories]
    keep = tuple(c for c in keep if c not in (*names, "is_toxic"))
    schema = df.select(*keep).schema
    for c in names:
        schema = schema.add(c, "double")
    schema = schema.add("is_toxic", "boolean")
    shared = spark.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            p = c.predict(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(p[:, j].copy()) for j in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], [*keep, *names, "is_toxic"])

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), most: int = SAMPLE) -> DataFrame:
    """classify() by a chain trained on at most `most` of the labelled documents; without labels nothing is toxic."""
    return classify(docs, fit(*sample(docs, labels, most)), keep=keep)
