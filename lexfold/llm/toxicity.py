"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed), a bag the
mean of its words, and a softmax over two classes reads the bag; vectors and
softmax are trained together by gradient descent, so misspellings share the
n-grams of what they misspell. A document's bags are overlapping windows of
``WINDOW`` words and its score is that of its worst window, so that one insult
weighs alike in a short and in a long text. Training starts from the bags of
whole short texts and goes on with the worst window of every text. Very long
words, as of scripts without spaces, are read as pieces, each a word.

The model is linear in its n-grams: for scoring, each bucket is one number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, crc_mod, materialise, release, ship, word_blocks
from .grams import hashed, pieces, plain, rows

WINDOW = 12
STRIDE = 6
BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5)
#: Labelled rows that a fit reads at most, by class, and the characters of one; of longer texts, which come last, it reads a stretch.
SAMPLE = {1: 3000, 0: 8000}
SAMPLE_CHARS = 10_000
#: Words whose n-grams a step of the fit holds at once.
PART = 20_000
#: Words a worker remembers the scores of.
CACHE = 200_000
FOLD = 5

@dataclass
class Model:
    """weight: what each bucket adds to the log-odds; bias: the log-odds of an empty bag."""

    weight: np.ndarray
    bias: float
    window: int = WINDOW
    stride: int = STRIDE

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer(dict):
    """Remembers each word's score; new words are scored many at a time."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def learn(self, words: Iterable[str]) -> None:
        new = list(words)
        for i in range(0, len(new), 4_000):
            part = new[i : i + 4_000]
            at, valid = hashed([plain(w) for w in part], GRAMS, len(self.model.weight))
            got = (self.model.weight[at] * valid).sum(1) / np.maximum(1, valid.sum(1))
            self.update(zip(part, got.tolist(), strict=True))

    def scores(self, texts: Sequence[str | None]) -> list[float]:
        """Each text's probability by its worst window; of the empty bag for a text without words."""
        m, out = self.model, np.zeros(len(texts))
        if len(self) > CACHE:
            self.clear()
        for i, text in enumerate(texts):
            best, tail = None, np.zeros(0, np.float32)
            for words in word_blocks(text or ""):
                if not words:
                    continue
                words = pieces(words)
                try:
                    own = np.fromiter(map(self.__getitem__, words), np.float32, len(words))
                except KeyError:
                    self.learn({w for t in texts[i : i + 256] if t and len(t) <= BLOCK for w in pieces(t.split()) if w not in self} | {w for w in words if w not in self})
                    own = np.fromiter(map(self.__getitem__, words), np.float32, len(words))
                s = np.concatenate([tail, own])
                got = windows(s, m.window, m.stride).max()
                best = got if best is None else max(best, got)
                tail = s[-m.window + 1 :]
            out[i] = 0.0 if best is None else best
        return (1 / (1 + np.exp(-(m.bias + out)))).tolist()


def starts(n: int, window: int, stride: int) -> np.ndarray:
    """First words of the windows over n words: the last window ends with the text."""
    if n <= window:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - window, stride), n - window)


def windows(scores: np.ndarray, window: int, stride: int) -> np.ndarray:
    at = starts(len(scores), window, stride)
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    k = min(window, len(scores))
    return (total[at + k] - total[at]) / k


def fit(texts: Iterable[str], labels: Iterable[int], rounds: int = 10, epochs: int = 50, seed: int = 7) -> Model:
    """Train on texts with labels 0 or 1. Without both classes the model says the only class's rate; without any row, never."""
    y = np.asarray(list(labels), np.int64)
    vocabulary: dict[str, int] = {}
    docs = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in pieces(t.split())), np.int32) for t in texts]
    keep = [i for i, d in enumerate(docs) if len(d)]
    docs, y = [docs[i] for i in keep], y[keep]
    if not len(y):
        return Model(np.zeros(BUCKETS, np.float32), -20.0)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    # n-grams in compressed rows; those of a single text say nothing about others and stay at zero
    known = list(vocabulary)
    del vocabulary
    flat, ptr = rows(known, GRAMS, BUCKETS, 4_000)
    n_grams = np.diff(ptr)
    del known
    seen = np.zeros(BUCKETS, np.int32)
    for d in docs:
        u = np.unique(d)
        seen[np.unique(_rows(flat, ptr, u)[0])] += 1
    live = (seen >= 2).astype(np.float32)[:, None]
    E, W, b = np.zeros((BUCKETS, DIM), np.float32), rng.normal(0, 1, (DIM, 2)).astype(np.float32), np.array([np.log(1 - rate), np.log(rate)], np.float32)
    W[:, 0] = -W[:, 1]
    slots = [[np.zeros_like(p), np.zeros_like(p)] for p in (E, W, b)]
    step = 0

    def parts(words: np.ndarray) -> list[np.ndarray]:
        return [words[i : i + PART] for i in range(0, len(words), PART)]

    def grams_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _rows(flat, ptr, words)

    def descend(bags: list[np.ndarray], target: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One Adam step on the weighted cross entropy of the bags."""
        nonlocal step, E, W, b
        step += 1
        size = np.array([len(x) for x in bags])
        words, where = np.unique(np.concatenate(bags), return_inverse=True)
        bag = np.repeat(np.arange(len(bags)), size)
        count = np.maximum(1, n_grams[words])
        V = np.concatenate([np.stack([_sums(E[g, k], g_ptr) for k in range(DIM)], 1) for g, g_ptr in map(grams_of, parts(words))]) / count[:, None]
        X = np.stack([np.bincount(bag, V[where, k], len(bags)) for k in range(DIM)], 1) / size[:, None]
        z = X @ W + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = p
        d[np.arange(len(bags)), target] -= 1
        d *= (weight / weight.sum())[:, None]
        dX = (d @ W.T) / size[:, None]
        dV = np.stack([np.bincount(where, dX[bag, k], len(words)) for k in range(DIM)], 1) / count[:, None]
        dE, at = np.zeros((BUCKETS, DIM), np.float32), 0
        for g, g_ptr in map(grams_of, parts(words)):
            some = np.diff(g_ptr)
            for k in range(DIM):
                dE[:, k] += np.bincount(g, np.repeat(dV[at : at + len(some), k], some), BUCKETS)
            at += len(some)
        for (m, v), param, grad, decay in zip(slots, (E, W, b), (dE * live, (X.T @ d).astype(np.float32), d.sum(0).astype(np.float32)), (1e-6, 1e-4, 0.0), strict=True):
            grad = grad + decay * param
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    short = [i for i, d in enumerate(docs) if len(d) <= 300] or list(range(len(docs)))
    for _ in range(epochs // 4):
        descend([docs[i] for i in short], y[short], weight[short], 0.1)
    order = [starts(len(d), WINDOW, STRIDE) for d in docs]
    for _ in range(rounds):
        u = E @ (W[:, 1] - W[:, 0])
        word = np.concatenate([_sums(u[flat[ptr[i] : ptr[min(i + PART, len(n_grams))]]], ptr[i : i + PART + 1] - ptr[i]) for i in range(0, len(n_grams), PART)]) / np.maximum(1, n_grams)
        worst, other = [], []
        for d, s in zip(docs, order, strict=True):
            k = int(windows(word[d], WINDOW, STRIDE).argmax())
            worst.append(d[s[k] : s[k] + WINDOW])
            r = int(rng.integers(len(s)))
            other.append(d[s[r] : s[r] + WINDOW])
        clean = np.flatnonzero(y == 0)
        bags, target = worst + [other[i] for i in clean], np.concatenate([y, y[clean]])
        for _ in range(max(1, epochs // rounds)):
            descend(bags, target, np.concatenate([weight, weight[clean]]), 0.05)
    return Model((E @ (W[:, 1] - W[:, 0])).astype(np.float32), float(b[1] - b[0]))


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The sum of each compressed row's values; 0 for an empty row."""
    return np.add.reduceat(np.append(values, values.dtype.type(0)), np.minimum(ptr[:-1], len(values))) * (np.diff(ptr) > 0)


def _rows(flat: np.ndarray, ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of some compressed rows, and where each row starts."""
    size = ptr[rows + 1] - ptr[rows]
    out = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(ptr[rows] - out[:-1], size) + np.arange(out[-1])], out


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fold: int | None = FOLD) -> DataFrame:
    """(doc_id, text, label): SAMPLE rows a class at most, by hash of the id; no row of fold 0.

    An id with several labels counts as 1 if any says so. Texts over SAMPLE_CHARS are
    taken where shorter ones do not fill the sample, and of each a stretch of that
    length. The ids are bounded by SAMPLE, so they are broadcast and no text is shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if fold:
        known = known.where(crc_mod(F.col("doc_id"), fold) != 0)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    sized = materialise(texts.select("doc_id", (F.length("text") > SAMPLE_CHARS).alias("long")).join(known, "doc_id"), "toxicity-known", labels.count())
    ids = None
    for label, n in SAMPLE.items():
        part = sized.where(F.col("label") == label).orderBy("long", F.xxhash64("doc_id"), "doc_id").limit(n)
        ids = part if ids is None else ids.union(part)
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)) + 1
    ids = F.broadcast(ids.select("doc_id", "label").distinct())
    return texts.join(ids, "doc_id").select("doc_id", F.substring("text", at.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"), "label")


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fold: int | None = FOLD) -> Model:
    """The model, fitted by one task on the sample, which SAMPLE and SAMPLE_CHARS bound; only the model comes to the driver."""
    ship(docs.sparkSession)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(batches)
        if found:
            known = pd.concat(found).sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
            m = fit(known["text"], known["label"])
            del found, known
            release()
            yield pd.DataFrame({"weight": [m.weight.tobytes()], "bias": [m.bias]})

    got = sample(docs, labels, label_col, fold).repartition(1).mapInPandas(train, "weight binary, bias double").first()
    return fit([], []) if got is None else Model(np.frombuffer(got["weight"], np.float32), got["bias"])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts get the score of an empty bag. Very long texts are read
    whole, a bounded part at a time. Repeated rows return a row each; a null id is kept, held_out null. Other columns are ignored. An empty
    table returns no row.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value.scorer()
        for texts in batches:
            yield pd.Series(own.scores(list(texts)), dtype="float64")
        del own
        release()

    got = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col)).alias("score"))
    return got.select("doc_id", (crc_mod(F.col("doc_id"), FOLD) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches the threshold; same columns.

    The model is fitted on docs' own labelled rows; without any, none is rejected.
    Null, empty and very long texts are scored as in scored. Repeated rows go or stay
    alike; an empty table returns no row. Other columns are passed on, whatever their
    names.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(fitted(docs, labels))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value.scorer()
        for texts in batches:
            yield pd.Series(own.scores(list(texts)), dtype="float64")
        del own
        release()

    return docs.where(score(F.col("text")) < threshold)
