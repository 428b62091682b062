"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, a temperature.

Every word has a sparse random index vector, drawn from a hash of the word. The context vector of a word is the sum of
the index vectors of its neighbours within WINDOW words over the whole corpus. The WORDS most frequent words of the
corpus, counted over all of it, have context vectors of their own; each other word shares that of one of BUCKETS hash
buckets, so the model has a fixed size whatever the input. Tasks add up their part, and Spark sums the parts. A document
is pooled into means and deviations of its words' context vectors, the mean of their index vectors, and its length. The
network is fitted on a bounded labelled sample (`max_rows`) and its temperature on a fifth of it set apart.

Null and empty texts are documents without words and get a score too. Without labels, or with one class only, every
score is the share of 1 among the labels (0.5 without any). Rows stay as they are, repeated ones too; extra columns are
not read, whatever their names. Ids may be of any type. Texts of any length count whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, tune
from .labelled import held_out, odds_shift, sample

WORDS, BUCKETS, DIM, NONZERO, WINDOW, SEED = 1 << 15, 1 << 12, 32, 2, 2, 7
ROWS = WORDS + BUCKETS  # of the table of context vectors; one more stands for no word
PLACES = 1 << 14  # index vectors, drawn once; a word has that of its hash
CHUNK, COUNT_CHUNK = 1 << 15, 1 << 19
THRESHOLD = 0.5
MAX_ROWS = 20_000


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero cells of each index vector; a last, empty one stands for no word."""
    rng = np.random.default_rng(SEED)
    place = np.argsort(rng.random((PLACES + 1, DIM)), axis=1)[:, :NONZERO]
    sign = rng.choice([-1, 1], (PLACES + 1, NONZERO))
    sign[PLACES] = 0
    return place, sign


def dense_index() -> np.ndarray:
    place, sign = index_vectors()
    out = np.zeros((PLACES + 1, DIM), dtype=np.float32)
    np.put_along_axis(out, place, sign.astype(np.float32), axis=1)
    return out[:PLACES]


def word_hashes(text: str | None) -> np.ndarray:
    """The CRC-32 of each word (in lower case, between spaces)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)).astype(np.int64)


def rows_of(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The row of each word in the table of context vectors: its own where it is among `words` (rising), else a bucket's."""
    bucket = WORDS + hashes % BUCKETS
    if not len(words):
        return bucket
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at, bucket)


def frequent_words(docs: DataFrame) -> np.ndarray:
    """The hashes (rising) of the WORDS most frequent words of all of docs.text."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, size = [], 0

        def part() -> pd.DataFrame:
            h, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *waiting]), return_counts=True)
            return pd.DataFrame({"h": h, "n": n})

        for b in batches:
            for text in b["text"]:
                waiting.append(word_hashes(text))
                size += len(waiting[-1])
                if size >= COUNT_CHUNK:
                    yield part()
                    waiting, size = [], 0
        yield part()

    counts = docs.select("text").mapInPandas(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return np.sort(counts.orderBy(F.desc("n"), "h").limit(WORDS).select("h").toArrow()["h"].to_numpy())


class Contexts:
    """A task's sums of the neighbours' index vectors, by row of the table."""

    def __init__(self, words: np.ndarray):
        self.words, (self.place, self.sign) = words, index_vectors()
        self.total, self.seen = np.zeros(ROWS * DIM), np.zeros(ROWS, dtype=np.int64)

    def add(self, texts: Iterable[str | None]) -> None:
        gap = np.full(WINDOW, -1)
        hashes = np.concatenate([x for t in texts for x in (word_hashes(t), gap)] or [gap])
        row, index = rows_of(hashes, self.words), np.where(hashes < 0, PLACES, hashes % PLACES)
        for i in range(0, len(row), CHUNK):  # with the neighbours on both sides of the chunk
            here = np.flatnonzero(hashes[i : i + CHUNK] >= 0) + i
            self.seen += np.bincount(row[here], minlength=ROWS)
            cells, weights = [], []
            for step in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
                a = here[(here + step >= 0) & (here + step < len(row))]
                near = index[a + step]
                cells.append((row[a, None] * DIM + self.place[near]).ravel())
                weights.append(self.sign[near].ravel())
            self.total += np.bincount(np.concatenate(cells), np.concatenate(weights), minlength=self.total.size)

    def rows(self) -> Iterator[pd.DataFrame]:
        at = np.flatnonzero(self.seen)
        cells = np.rint(self.total.reshape(-1, DIM)[at]).astype(np.int64)
        yield pd.DataFrame({"b": at, "n": self.seen[at]} | {f"c{i}": cells[:, i] for i in range(DIM)})


def word_vectors(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """ROWS x DIM unit context vectors over all of docs.text, less the mean direction of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, waiting, size = Contexts(shared.value), [], 0
        for b in batches:
            for text in b["text"]:
                waiting.append(text)
                size += len(text or "")
                if size >= 8 * CHUNK:
                    sums.add(waiting)
                    waiting, size = [], 0
        sums.add(waiting)
        yield from sums.rows()

    cols = [f"c{i}" for i in range(DIM)]
    parts = docs.select("text").mapInPandas(contexts, "b long, n long, " + ", ".join(f"{c} long" for c in cols))
    got = parts.groupBy("b").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cols]).toArrow()  # ROWS rows at most
    out, n = np.zeros((ROWS, DIM)), np.zeros(ROWS)
    if got.num_rows:
        b = got["b"].to_numpy()
        out[b] = np.stack([got[c].to_numpy() for c in cols], axis=1)
        n[b] = got["n"].to_numpy()
    out -= n[:, None] * (out.sum(axis=0) / max(1, n.sum()))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).astype(np.float32)


FEATURES = 3 * DIM + 2


def pooled(text: str | None, words: np.ndarray, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    hashes, out = word_hashes(text), np.zeros(FEATURES)
    if n := len(hashes):
        one, two, bag = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
        for i in range(0, n, CHUNK):
            h = hashes[i : i + CHUNK]
            x = vectors[rows_of(h, words)]
            one += x.sum(axis=0, dtype=np.float64)
            two += np.square(x).sum(axis=0, dtype=np.float64)
            bag += index[h % PLACES].sum(axis=0, dtype=np.float64)
        out[:DIM] = one / n
        out[DIM : 2 * DIM] = np.sqrt(np.maximum(0, two / n - np.square(one / n)))
        out[2 * DIM : 3 * DIM] = bag / n
        out[-2] = np.linalg.norm(bag / n)
    out[-1] = np.log1p(n)
    return out


@dataclass
class Network:
    """Logits of standardised features by one hidden layer; `prior` stands in where nothing could be fitted."""

    prior: float = 0.5
    fitted: bool = False
    temperature: float = 1.0
    shift: float = 0.0  # from the sample's odds to those of all labels
    p: dict = field(default_factory=dict)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x - self.p["mean"]) / self.p["scale"] @ self.p["w1"] + self.p["b1"])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.p["w2"] + self.p["b2"]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature + self.shift, -500, 500)))


def fit_network(x: np.ndarray, y: np.ndarray, units: int = 32, epochs: int = 60, batch: int = 256, rate: float = 2e-3, decay: float = 1e-4) -> Network:
    """Adam on the cross-entropy; the temperature then minimises it on every fifth row, which the weights never see."""
    net = Network(prior=float(y.mean()) if len(y) else 0.5)
    apart = np.arange(len(y)) % 5 == 4
    if len(y) < 20 or not 0 < y[~apart].sum() < (~apart).sum():
        return net
    rng = np.random.default_rng(SEED)
    xt, yt = x[~apart], y[~apart]
    net.fitted, net.p = True, {"mean": xt.mean(axis=0), "scale": xt.std(axis=0) + 1e-6}
    xt = (xt - net.p["mean"]) / net.p["scale"]
    w = {"w1": rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], units)), "b1": np.zeros(units), "w2": rng.normal(0, np.sqrt(1 / units), units), "b2": np.array(np.log(net.prior / (1 - net.prior)))}
    m, v, t = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(yt))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            h = np.maximum(0, xt[at] @ w["w1"] + w["b1"])
            g = (1 / (1 + np.exp(-np.clip(h @ w["w2"] + w["b2"], -500, 500))) - yt[at]) / len(at)
            gh = np.outer(g, w["w2"]) * (h > 0)
            grad = {"w1": xt[at].T @ gh + decay * w["w1"], "b1": gh.sum(axis=0), "w2": h.T @ g + decay * w["w2"], "b2": g.sum()}
            t += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * np.square(grad[k])
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.p |= w
    z, ya = net.logit(x[apart]), y[apart]
    ts = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
    net.temperature = float(ts[np.argmin([np.mean(np.logaddexp(0, z / s) - ya * z / s) for s in ts])])
    return net


@dataclass
class Model:
    words: np.ndarray
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Word vectors over all of docs; the network on at most max_rows labelled documents, half of each class at most."""
    tune(docs.sparkSession)
    words = frequent_words(docs)
    vectors, index = word_vectors(docs, words), dense_index()
    shared = docs.sparkSession.sparkContext.broadcast((words, vectors))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "y": b["y"], "x": [pooled(t, *shared.value, index) for t in b["text"]]})

    rows = sample(docs, labels, label, max_rows // 2).select(F.crc32(F.col("doc_id").cast("string")).alias("h"), "text", "y")
    got = rows.mapInPandas(features, "h long, y int, x array<double>").toPandas()  # max_rows rows at most
    got = got.iloc[np.lexsort((got["x"].map(sum), got["y"], got["h"]))]  # an order of the rows' own
    x = np.stack(got["x"]) if len(got) else np.zeros((0, FEATURES))
    net = fit_network(x, got["y"].to_numpy(dtype=np.float64))
    net.shift = odds_shift(labels, label, net.prior)
    return Model(words, vectors, net)


def score(model: Model, text: Column, spark) -> Column:
    """The probability of label 1 for a text column. What is broadcast has a fixed size (5 MB of vectors)."""
    shared, index = spark.sparkContext.broadcast(model), dense_index()

    @F.pandas_udf("double")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in parts:
            x = np.stack([pooled(t, m.words, m.vectors, index) for t in s]) if len(s) else np.zeros((0, FEATURES))
            yield pd.Series(m.network.probability(x))

    return udf(text)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    model = fit(docs, labels, "quality", max_rows)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text"), docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs that are predicted 1, all columns as they are."""
    model, name = fit(docs, labels, "quality", max_rows), free_name(docs.columns, "score")
    return docs.withColumn(name, score(model, F.col("text"), docs.sparkSession)).where(F.col(name) >= THRESHOLD).select(*docs.columns)
