"""Language of text by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes (affixes), inner character
n-grams, itself where it is in a language's lexicon, and its shape; labels of
neighbouring words are tied by learned transitions. Forward-backward gives each
word's marginal, so code-switched text is labelled word by word; a document's
language is the label with the largest share of its words' marginals.

Chains are stretches of ``CHAIN`` words, all stretches of a batch going forward
and backward together. The fit sees single-language texts, and stretches spliced
from two languages so that a switch is neither free nor impossible.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK, crc_mod, materialise, release, ship, small, word_blocks
from .grams import batches, hashed, plain

CHAIN = 64
BUCKETS = 1 << 16
#: Labelled documents that a fit reads at most, of a language and of all, and the characters of one; of longer texts it reads a stretch. A language has one at least.
SAMPLE, SAMPLE_ALL = 400, 8_000
SAMPLE_CHARS = 6_000
#: Numbers that a step of the fit holds of its chains at once.
STEP = 1 << 22
#: Words a worker remembers the emissions of.
CACHE = 600_000
FOLD, HELD = 4, 2
UNKNOWN = "und"
GRAMS = (1, 2, 3, 4)


def features(words: Sequence[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(places, valid), [words, features]: n-grams and affixes, the word, its lexicon entry, its shape; none without a letter."""
    own = [plain(w) for w in words]
    lettered = np.array([any(map(str.isalpha, w)) for w in own], bool)
    at, valid = hashed(own, GRAMS, BUCKETS)
    entry = np.array([lexicon.get(w, -1) for w in own], np.int32)
    shape = np.array([0 if w.isascii() else 1 for w in own], np.int32)
    at = np.concatenate([at, BUCKETS + 2 + np.maximum(entry, 0)[:, None], BUCKETS + shape[:, None]], 1)
    valid = np.concatenate([valid, (entry >= 0)[:, None], np.ones((len(own), 1), bool)], 1)
    return at, valid & lettered[:, None]


def forward_backward(emit: np.ndarray, valid: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of S chains of T words over L labels.

    emit [S, T, L] and trans [L, L], start [L] are positive potentials; valid
    [S, T] marks words, in front. Returns the node marginals, the expected
    transitions summed over all chains, and each chain's log partition.
    """
    S, T, L = emit.shape
    alpha, scale = np.empty((T, S, L), emit.dtype), np.ones((T, S), emit.dtype)
    a = start * emit[:, 0]
    for t in range(T):
        if t:
            v = valid[:, t, None]
            a = np.where(v, (alpha[t - 1] @ trans) * emit[:, t], alpha[t - 1])
        z = a.sum(1)
        scale[t] = z
        alpha[t] = a / z[:, None]
    beta, node, edge = np.ones((S, L), emit.dtype), np.empty((S, T, L), emit.dtype), np.zeros((L, L))
    node[:, T - 1] = alpha[T - 1]
    for t in range(T - 2, -1, -1):
        v = valid[:, t + 1, None]
        onward = emit[:, t + 1] * beta / scale[t + 1][:, None]
        edge += np.einsum("si,sj,s->ij", alpha[t], onward, valid[:, t + 1].astype(emit.dtype)) * trans
        beta = np.where(v, onward @ trans.T, beta)
        got = alpha[t] * beta
        node[:, t] = got / got.sum(1, keepdims=True)
    return node, edge, np.log(scale).sum(0)


@dataclass
class Model:
    labels: list[str]
    weight: np.ndarray  # [buckets, 2 shapes and lexicon entries, L]
    trans: np.ndarray  # [L, L] log potentials
    start: np.ndarray  # [L]
    lexicon: dict[str, int]

    def tagger(self) -> Tagger:
        return Tagger(self)


class Tagger(dict):
    """Remembers where each word's emissions stand in a table; 0 stands for words without a letter."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, L = model, len(model.labels)
        self.table, self.used = np.ones((1024, L), np.float32), 1
        self.trans, self.start = np.exp(model.trans).astype(np.float32), np.exp(model.start).astype(np.float32)

    def learn(self, words: Iterable[str]) -> None:
        new = list(words)
        for some in batches(new):
            part = [new[i] for i in some]
            at, valid = features(part, self.model.lexicon)
            logs = np.stack([(self.model.weight[:, k][at] * valid).sum(1) for k in range(len(self.model.labels))], 1)
            known = valid.any(1)
            n = int(known.sum())
            while self.used + n > len(self.table):
                self.table = np.concatenate([self.table, np.ones_like(self.table)])
            self.table[self.used : self.used + n] = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -60))[known]
            place = np.zeros(len(part), np.int64)
            place[known] = np.arange(self.used, self.used + n)
            self.used += n
            self.update(zip(part, place.tolist(), strict=True))

    def places(self, words: Sequence[str], ahead: Sequence[str | None] = ()) -> np.ndarray:
        """Places of words in the table; where one is new, those of the texts ahead are learned with it."""
        try:
            return np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        except KeyError:
            self.learn({w for t in ahead if t and len(t) <= BLOCK for w in t.split() if w not in self} | {w for w in words if w not in self})
            return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def marginals(self, words: np.ndarray) -> np.ndarray:
        """Marginals of a text's words, given as places in the table."""
        n, L = len(words), len(self.model.labels)
        rows = -(-n // CHAIN)
        at = np.zeros(rows * CHAIN, np.int64)
        at[:n] = words
        valid = np.arange(rows * CHAIN).reshape(rows, CHAIN) < n
        node, _, _ = forward_backward(self.table[at].reshape(rows, CHAIN, L), valid, self.trans, self.start)
        return node.reshape(-1, L)[:n]

    def tag(self, text: str) -> list[tuple[str, str | None]]:
        """(word, label) of a code-switched text; no label for words without a letter."""
        words = text.split()
        if not words:
            return []
        at = self.places(words)
        best = self.marginals(at).argmax(1)
        return [(w, self.model.labels[k] if a else None) for w, a, k in zip(words, at, best, strict=True)]

    def shares(self, texts: Iterable[str | None]) -> np.ndarray:
        """[N, L + 1]: each text's marginals summed over its words with a letter, and the number of those."""
        texts, L = list(texts), len(self.model.labels)
        out, chunk, owner, size = np.zeros((len(texts), L + 1)), [], [], 0
        if len(self) > CACHE:
            self.clear()
            self.used = 1

        def settle() -> None:
            nonlocal size
            if not chunk:
                return
            rows = [-(-len(c) // CHAIN) for c in chunk]
            at, valid, own = np.zeros((sum(rows), CHAIN), np.int32), np.zeros((sum(rows), CHAIN), bool), np.repeat(owner, rows)
            flat, ok, r = at.reshape(-1), valid.reshape(-1), 0
            for c, k in zip(chunk, rows, strict=True):
                flat[r * CHAIN : r * CHAIN + len(c)] = c
                ok[r * CHAIN : r * CHAIN + len(c)] = True
                r += k
            node, _, _ = forward_backward(self.table[at], valid, self.trans, self.start)
            counted = at > 0
            sums = (node * counted[:, :, None]).sum(1)
            for k in range(L):
                out[:, k] += np.bincount(own, sums[:, k], len(texts))
            out[:, L] += np.bincount(own, counted.sum(1), len(texts))
            chunk.clear()
            owner.clear()
            size = 0

        for i, text in enumerate(texts):
            for words in word_blocks(text or ""):
                if words:
                    chunk.append(self.places(words, texts[i : i + 256]))
                    owner.append(i)
                    size += len(words)
                    if size >= 1 << 17:
                        settle()
        settle()
        return out

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        if not self.model.labels:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        got = self.shares(texts)
        n = got[:, -1]
        share = got[:, :-1] / np.maximum(1, n)[:, None]
        best = share.argmax(1)
        lang = [self.model.labels[k] if c else UNKNOWN for k, c in zip(best, n, strict=True)]
        return lang, np.clip(np.where(n > 0, share.max(1), 0.0), 0, 1).tolist()


def fit(texts: Iterable[str], langs: Iterable[str], epochs: int = 30, switched: float = 0.3, seed: int = 11, l2: float = 1e-3) -> Model:
    """Train on texts of one language each."""
    pairs = [(t.split(), g) for t, g in zip(texts, langs, strict=True)]
    labels = sorted({g for _, g in pairs})
    code, L = {g: i for i, g in enumerate(labels)}, len(labels)
    if L < 2:
        return Model(labels, np.zeros((BUCKETS + 2 + L, L), np.float32), np.zeros((L, L)), np.zeros(L), {})
    count: dict[str, Counter] = defaultdict(Counter)
    for words, g in pairs:
        for w in set(map(plain, words)):
            count[w][code[g]] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in count.items() if w and sum(c.values()) >= 5 and c.most_common(1)[0][1] >= 0.9 * sum(c.values())}
    rng, T = np.random.default_rng(seed), 32
    chains: list[tuple[list[str], int]] = [(words[i : i + T], code[g]) for words, g in pairs for i in range(0, len(words), T)]
    vocabulary: dict[str, int] = {}
    at, y, valid = np.zeros((len(chains), T), np.int64), np.zeros((len(chains), T), np.int64), np.zeros((len(chains), T), bool)
    for s, (words, k) in enumerate(chains):
        if rng.random() < switched:
            other, k2 = chains[int(rng.integers(len(chains)))]
            cut = int(rng.integers(0, min(len(words), T - 1) + 1))
            joined = words[:cut] + other[: T - cut]
            marks = [k] * cut + [k2] * len(other[: T - cut])
        else:
            joined, marks = words, [k] * len(words)
        n = len(joined)
        at[s, :n] = [vocabulary.setdefault(w, len(vocabulary)) for w in joined]
        y[s, :n], valid[s, :n] = marks, True
    known, flat, owner = list(vocabulary), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for some in batches(known):
        p, v = features([known[i] for i in some], lexicon)
        flat.append(p[v])
        owner.append(np.repeat(some, v.sum(1)))
    flat, owner = np.concatenate(flat), np.concatenate(owner)
    pair, size = np.zeros((L, L)), max(1, STEP // (T * L))
    both = valid[:, 1:]
    np.add.at(pair, (y[:, :-1][both], y[:, 1:][both]), 1)
    first, n = np.bincount(y[:, 0][valid[:, 0]], minlength=L).astype(float), max(1, int(valid.sum()))
    # what the labels themselves say of each word, taken off the expected counts below
    said = np.bincount(at[valid] * L + y[valid], minlength=len(known) * L).reshape(-1, L)
    params = [np.zeros((BUCKETS + 2 + L, L)), np.zeros((L, L)), np.zeros(L)]
    slots = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, epochs + 1):
        theta, trans, start = params
        word = np.stack([np.bincount(owner, theta[flat, k], len(known)) for k in range(L)], 1).astype(np.float32)
        moves, begins = np.exp(trans).astype(np.float32), np.exp(start).astype(np.float32)
        of_word, edge, node_first = -said.astype(np.float64), np.zeros((L, L)), np.zeros(L)
        for i in range(0, len(chains), size):
            own, ok = at[i : i + size], valid[i : i + size]
            logs = word[own]
            emit = np.exp(np.maximum(logs - logs.max(2, keepdims=True), -60))
            emit[~ok] = 1
            node, edges, _ = forward_backward(emit, ok, moves, begins)
            for k in range(L):
                of_word[:, k] += np.bincount(own[ok], node[ok, k], len(known))
            edge += edges
            node_first += node[ok[:, 0], 0].sum(0)
        grads = [np.stack([np.bincount(flat, of_word[owner, k], len(theta)) for k in range(L)], 1) / n + l2 * theta / n, (edge - pair) / n + l2 * trans / n, (node_first - first) / n]
        for (m, v), p, g in zip(slots, params, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(labels, params[0].astype(np.float32), params[1], params[2], lexicon)


def sample(docs: DataFrame, fold: bool = True) -> DataFrame:
    """(doc_id, text, lang): of each language SAMPLE documents at most, by hash of the id; none of the held-out fold.

    Where languages are so many that all would have more than SAMPLE_ALL, each has its
    part of that, but one document at least.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null and text is not null and trim(text) <> ''")
    if fold:
        known = known.where(crc_mod(F.col("doc_id"), FOLD) != HELD)
    counts = materialise(known.groupBy("lang").agg(F.count("*").alias("n")), "langid-languages")
    each = max(1, min(SAMPLE, SAMPLE_ALL // max(1, counts.count())))
    # a language's lowest hashes: more than the wanted number is expected below the cut, so a window sorts few rows
    cut = F.lit(2.0 * each + 20) / F.col("n")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    low = known.select("doc_id", "lang").join(small(counts), "lang").where((place < cut) | (F.col("n") <= 4 * each + 40))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = materialise(low.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("doc_id").distinct(), "langid-sample")
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)) + 1
    return known.join(small(ids), "doc_id").select("doc_id", F.substring("text", at.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"), "lang")


def fitted(docs: DataFrame, fold: bool = True) -> Model:
    """The model, fitted by one task on the sample, which SAMPLE, SAMPLE_ALL and SAMPLE_CHARS bound; only the model comes to the driver."""
    ship(docs.sparkSession)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(batches)
        if found:
            known = pd.concat(found).sort_values(["doc_id", "lang", "text"]).drop_duplicates("doc_id")
            m = fit(known["text"], known["lang"])
            del found, known
            release()
            words, codes = list(m.lexicon), list(m.lexicon.values())
            yield pd.DataFrame({"labels": [m.labels], "weight": [m.weight.tobytes()], "trans": [m.trans.ravel().tolist()], "start": [m.start.tolist()], "words": [words], "codes": [codes]})

    got = sample(docs, fold).repartition(1).mapInPandas(train, "labels array<string>, weight binary, trans array<double>, start array<double>, words array<string>, codes array<int>").first()
    if got is None:
        return fit([], [])
    L = len(got["labels"])
    return Model(list(got["labels"]), np.frombuffer(got["weight"], np.float32).reshape(-1, L), np.array(got["trans"]).reshape(L, L), np.array(got["start"]), dict(zip(got["words"], got["codes"], strict=True)))


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    A null text, or one without a letter, is ``und`` with score 0. Very long texts are
    read whole, a bounded part at a time. Repeated rows
    return a row each; a null id is kept, held_out null. An empty table returns no
    row. Without labelled documents every text is ``und``. Other columns are ignored.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value.tagger()
        for texts in batches:
            lang, score = own.predict(list(texts))
            yield pd.DataFrame({"lang": lang, "score": score})
        del own
        release()

    got = docs.select(F.col(id_col).alias("doc_id"), predict(F.col(text_col)).alias("p"))
    return got.select("doc_id", (crc_mod(F.col("doc_id"), FOLD) == HELD).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
