"""Toxicity by class-conditional Kneser-Ney models of letters and of words.

Texts are read as letters in lower case with one gap between words; an expression is a run of ORDER letters, or a whole
word. Each class (toxic, ordinary) has an absolutely discounted count of documents with an expression, taken from all
documents with a training label but those of the curve; the weight left goes to a distribution that both classes share, counted over every document of
the corpus: for letters a Kneser-Ney chain of shorter runs, for words the number of documents, as their contexts, that
have them (so a word that one document repeats is no more expected than one that it has once). What neither class
knows well therefore costs both the same.

The evidence of a text is the length-normalised difference of its two log-likelihoods, under either model: over the
whole text, and over its most and second most toxic stretch of each of WINDOWS letters and of one word (a few insults in
a long text hardly move its mean). A logistic curve, fitted on a bounded sample of documents that no class count has
seen, turns it into a probability.

The table of letters has ALPHABET ** ORDER cells. Words are known by 63-bit hashes and counted in Spark, however many
there are. A word that no class has in more than WORD_DISCOUNT documents has no evidence. Of the others the model holds
those of most evidence, MOST_WORDS at most. Where there are more, the rest, of an evidence up to `slack`, stays a table
(`Model.rest`): texts' other words are joined with it, and their sums and greatest values added to those of the words
that the model holds (`features`). So every word counts, however many there are. `Model.evidence` alone, without that
table, is off by `slack` at most.

Null and empty texts have no evidence and score by the
curve's constant. Without labels, or with one class only, every score is the share of 1 among the sample (0.5 without
any). Rows stay as they are, repeated ones too; other columns are not read, whatever their names. Ids may be of any type.
Texts of any length count whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, tune, with_values, written
from .labelled import held_out, odds_shift, training_ids

ALPHABET, ORDER, DISCOUNT, SHARED_DISCOUNT, WINDOWS = 32, 4, 1.0, 0.75, (4, 8)
WORD_DISCOUNT, WORD_CHUNK, SLICE, MOST_WORDS, STEPS = 3.0, 1 << 19, 1 << 16, 2_000_000, 256
CELLS = ALPHABET**ORDER
PER_CLASS, LABELS_AT_ONCE = 8_000, 4_000_000
THRESHOLD = 0.7
CHUNK = 1 << 20
FEATURES = 2 + 2 * (len(WINDOWS) + 1)
#: Letters as they are, in lower case; bytes of other scripts stay; the rest are gaps.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: 0 a gap, 1 to 26 a letter, 27 the first byte of another letter, 28 to 31 the classes of its later bytes.
CODES = bytes(0 if c == 32 else c - 96 if 97 <= c <= 122 else 27 if c >= 0xC0 else 28 + c % 4 for c in range(256))


def expressions(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The code of each run of ORDER letters and the key of each word (below 0), in order."""
    words = (text or "").encode("utf-8", "replace").translate(LETTERS).split()
    if not words:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    c = np.frombuffer((b" " + b" ".join(words) + b" ").translate(CODES), dtype=np.uint8).astype(np.int32)
    n = max(0, len(c) - ORDER + 1)
    key = c[:n]
    for i in range(1, ORDER):
        key = key * ALPHABET + c[i : n + i]
    return key, np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64) | np.int64(-1 << 63)


def discounted(counts: np.ndarray, lower: np.ndarray, discount: float) -> np.ndarray:
    """P(last letter | those before) for each run: discounted counts, the rest spread by `lower` (runs one shorter)."""
    by = counts.reshape(-1, ALPHABET)
    total, rest = by.sum(axis=1, keepdims=True), np.maximum(by - discount, 0)
    some = np.maximum(total, 1e-9)
    below = np.tile(lower, ALPHABET).reshape(-1, ALPHABET)
    return np.where(total > 0, rest / some + (1 - rest.sum(axis=1, keepdims=True) / some) * below, below).ravel()


def shared_chain(counts: np.ndarray) -> np.ndarray:
    """The shared distribution of runs one letter shorter than `counts`, each level from continuation counts of the next."""
    levels = [counts.reshape(ALPHABET, -1).sum(axis=0)]
    while len(levels[-1]) > ALPHABET:
        levels.append((levels[-1].reshape(ALPHABET, -1) > 0).sum(axis=0).astype(np.float64))
    p = (levels[-1] + 0.5) / (levels[-1].sum() + 0.5 * ALPHABET)
    for n in reversed(levels[:-1]):
        p = discounted(n, p, SHARED_DISCOUNT)
    return p


def stretches(r: np.ndarray, windows: tuple[int, ...]) -> list[float]:
    """The mean, and the means of the greatest stretch of each size and of the greatest one apart from that."""
    if not len(r):
        return [0.0] * (1 + 2 * len(windows))
    total = np.concatenate([[0.0], np.cumsum(r, dtype=np.float64)])
    out = [total[-1] / len(r)]
    for w in windows:
        n = min(w, len(r))
        s = total[n:] - total[:-n]
        i = int(s.argmax())
        second = max(s[: max(0, i - n + 1)].max(initial=-np.inf), s[i + n :].max(initial=-np.inf))
        out += [s[i] / w, second / w if second > -np.inf else 0.0]
    return out


@dataclass
class Model:
    letters: np.ndarray  # log P(toxic) - log P(ordinary) of each expression
    keys: np.ndarray  # of words, rising
    words: np.ndarray  # the same of each, less that of a word that neither class knows
    curve: np.ndarray
    slack: float = 0.0
    prior: float = 0.5
    fitted: bool = False
    rest: DataFrame | None = None  # (k, r, n) of words that are not in keys; n: how many documents have each

    def of_words(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.words[at], np.float32(0))

    def evidence(self, text: str | None) -> list[float]:
        runs, words = expressions(text)
        return stretches(self.letters[runs], WINDOWS) + stretches(self.of_words(words), (1,))

    def probability(self, texts) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.prior)
        return self.curved(np.array([self.evidence(t) for t in texts]).reshape(-1, FEATURES))

    def parts(self, text: str | None) -> dict:
        """What `features` needs of a text: x (of its letters), n (words), total and top (the sum and the two greatest
        values of words in keys), and the other words (k) with how often each is there (many)."""
        runs, words = expressions(text)
        at = np.minimum(np.searchsorted(self.keys, words), max(0, len(self.keys) - 1))
        held = self.keys[at] == words if len(self.keys) else np.zeros(len(words), dtype=bool)
        values = self.words[at[held]].astype(np.float64)
        k, many = np.unique(words[~held], return_counts=True)
        return {"x": stretches(self.letters[runs], WINDOWS), "n": len(words), "total": float(values.sum()), "top": np.sort(values)[:-3:-1].tolist(), "k": k.tolist(), "many": many.tolist()}

    def curved(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Newton's method on the penalised cross-entropy; constant first."""
    z, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's counts: of each run of letters, and of documents with each word (n), and of ordinary and toxic documents
    that have it (o, t).

    Words leave in parts of WORD_CHUNK read, at most SLICE rows at a time, so a task holds some 50 MB whatever it reads.
    """
    letters = np.zeros((3, CELLS), dtype=np.int64)
    waiting: list[list[np.ndarray]] = [[], [], []]
    size = runs_size = 0
    waiting_runs: list[np.ndarray] = []

    def sliced(k: np.ndarray, *n: np.ndarray) -> Iterator[pd.DataFrame]:
        for i in range(0, len(k), SLICE):
            yield pd.DataFrame({c: x[i : i + SLICE] for c, x in zip("knot", (k, *n), strict=True)})

    def part() -> Iterator[pd.DataFrame]:
        keys, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *waiting[0]]), return_counts=True)
        by_class = []
        for w in waiting[1:]:
            some, many = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *w]), return_counts=True)
            by_class.append(np.zeros(len(keys), dtype=np.int64))
            by_class[-1][np.searchsorted(keys, some)] = many
        for w in waiting:
            w.clear()
        yield from sliced(keys, n, *by_class)

    def add_runs() -> None:
        letters[0] += np.bincount(np.concatenate(waiting_runs), minlength=CELLS)
        waiting_runs.clear()

    for batch in batches:
        for text, y in zip(batch["text"], batch["y"], strict=True):
            runs, words = expressions(text)
            words = np.unique(words)
            waiting[0].append(words)
            waiting_runs.append(runs)
            size, runs_size = size + len(words), runs_size + len(runs)
            if y >= 0:
                letters[1 + y, np.unique(runs)] += 1
                waiting[1 + y].append(words)
            if runs_size >= CHUNK:
                add_runs()
                runs_size = 0
            if size >= WORD_CHUNK:
                yield from part()
                size = 0
    if waiting_runs:
        add_runs()
    yield from part()
    at = np.flatnonzero(letters.any(axis=0))
    yield from sliced(at, *letters[:, at])


def word_evidence(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, float, DataFrame | None]:
    """Keys of words and their evidence, of counts (k, n, o, t), the `most` ones of most evidence; the greatest evidence that
    others may have, and those others (k, r, n), which stay in Spark (None if there are none)."""
    over = {c: F.greatest(F.col(c) - WORD_DISCOUNT, F.lit(0.0)) for c in "ot"}
    sums = [F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("n"), F.col("o"), over["o"], F.col("t"), over["t"])]
    kinds, n, o, rest_o, t, rest_t = counts.agg(F.count("*"), *sums).first()
    totals, rests = {"o": max(1, o), "t": max(1, t)}, {"o": rest_o, "t": rest_t}
    left = {c: max(1 - rests[c] / totals[c], 1e-12) for c in "ot"}
    f = (F.col("n") + 0.5) / (n + 0.5 * (kinds + 1))
    p = {c: over[c] / F.lit(float(totals[c])) + F.lit(left[c]) * f for c in "ot"}
    r = F.log(p["t"] / F.lit(left["t"])) - F.log(p["o"] / F.lit(left["o"]))
    known = counts.where((F.col("o") > WORD_DISCOUNT) | (F.col("t") > WORD_DISCOUNT)).select("k", r.alias("r"), "n")
    by_step = known.groupBy(F.floor(F.abs("r") * STEPS).alias("step")).count().collect()  # logarithms: some thousand steps
    slack, words = 0.0, 0
    for step, many in sorted(by_step, reverse=True):
        words += many
        if words > most:
            slack = (step + 1) / STEPS
            break
    step = F.floor(F.abs("r") * STEPS)
    got = known.where(step >= round(slack * STEPS)).select("k", "r").toArrow()
    rest = written(known.where(step < round(slack * STEPS)).withColumn("r", F.col("r").cast("float")), "toxicity-rest") if slack else None
    keys, values = got["k"].to_numpy(), got["r"].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32), slack, rest


def features(model: Model, rows: DataFrame, to: str) -> DataFrame:
    """rows (text, ...) with column `to`: the FEATURES of each text, by the model's words and by those of model.rest.

    A text's words that the model does not hold are joined with the rest by their keys; a sum and the two greatest values
    come back to it. So no table of words is ever whole in the driver or in a task.
    """
    row, part = (free_name([*rows.columns, to], c) for c in ("row", "part"))
    shared = rows.sparkSession.sparkContext.broadcast(replace(model, rest=None))

    @F.pandas_udf("x array<double>, n long, total double, top array<double>, k array<long>, many array<long>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([shared.value.parts(t) for t in s], columns=["x", "n", "total", "top", "k", "many"])

    rows = written(rows.withColumn(row, F.monotonically_increasing_id()).withColumn(part, parts("text")), "toxicity-parts")
    words = rows.select(F.col(row).alias("row"), F.explode(F.arrays_zip(f"{part}.k", f"{part}.many")).alias("w")).select("row", "w.k", "w.many")
    met = with_values(words, model.rest, ["k"], "n").where("r IS NOT NULL").withColumn("r", F.col("r").cast("double"))
    top = F.slice(F.sort_array(F.flatten(F.collect_list(F.expr("array_repeat(r, int(least(many, 2)))"))), asc=False), 1, 2)
    met = met.groupBy("row").agg(F.sum(F.col("r") * F.col("many")).alias("total"), F.sum("many").alias("many"), top.alias("top"))
    met = met.select(F.col("row").alias(row), F.struct("total", "many", "top").alias("__met"))
    none = F.array().cast("array<double>")
    others = F.aggregate(f"{part}.many", F.lit(0).cast("long"), lambda a, b: a + b) - F.coalesce("__met.many", F.lit(0))
    zeros = F.array_repeat(F.lit(0.0), F.least(others, F.lit(2)).cast("int"))
    tops = F.sort_array(F.concat(f"{part}.top", F.coalesce("__met.top", none), zeros), asc=False)
    mean = (F.col(f"{part}.total") + F.coalesce("__met.total", F.lit(0.0))) / F.greatest(f"{part}.n", F.lit(1))
    at = [F.coalesce(F.get(tops, F.lit(i)), F.lit(0.0)) for i in (0, 1)]
    out = rows.join(met, row, "left").withColumn(to, F.concat(f"{part}.x", F.array(mean, *at)))
    return out.drop(row, part, "__met")


def whole_number(rows: DataFrame, name: str) -> Column:
    """A column of ids as long; ids that are no whole numbers as their 64-bit hashes, which tell them apart well enough."""
    whole = rows.schema[name].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.col(name).cast("long") if whole else F.when(F.col(name).isNotNull(), F.xxhash64(name))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, most_words: int = MOST_WORDS, labels_at_once: int = LABELS_AT_ONCE) -> Model:
    """Class counts from all labelled documents but those of the curve, which are per_class // 4 of each class at most;
    shared counts from all of docs. Every row of an id counts; the curve reads the first text of an id."""
    spark = docs.sparkSession
    tune(spark)
    ids = training_ids(labels, label).join(docs.select("doc_id"), "doc_id", "left_semi")
    ids = written(ids.withColumn("h", F.xxhash64("doc_id")), "toxicity-ids")
    few = [ids.where((F.pmod("h", F.lit(4)) == 0) & (F.col("y") == y)).orderBy("h", "doc_id").limit(per_class // 4) for y in (0, 1)]
    curve = written(few[0].union(few[1]).select("doc_id", "y"), "toxicity-curve")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(curve), "doc_id")  # 2 * (per_class // 4) ids
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    counting = ids.join(F.broadcast(curve.select("doc_id")), "doc_id", "left_anti").select("doc_id", "y")
    texts = docs.select(F.coalesce(whole_number(docs, "doc_id"), F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("named"), "text")
    blocks = max(1, -(-ids.count() // labels_at_once))

    def block(b: int) -> DataFrame:
        """Counts by the labels of one block, which are broadcast (so no text is shuffled); n is of the first one."""
        known = counting.where(F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(blocks)) == b).select(whole_number(counting, "doc_id").alias("id"), "y").orderBy("id").toArrow()
        shared = spark.sparkContext.broadcast((known["id"].to_numpy(), known["y"].to_numpy()))

        def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, values = shared.value
            for batch in batches:
                id_, y = batch["id"].to_numpy(), np.full(len(batch), -1)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, id_), len(keys) - 1)
                    y = np.where(batch["named"].to_numpy(dtype=bool) & (keys[at] == id_), values[at], -1)
                batch = pd.DataFrame({"text": batch["text"], "y": y})
                yield batch if b == 0 else batch[batch["y"] >= 0]

        rows = texts.mapInPandas(lambda batches: counted(labelled(batches)), "k long, n long, o long, t long")
        return rows if b == 0 else rows.withColumn("n", F.lit(0).cast("long"))

    counts = reduce(DataFrame.union, map(block, range(blocks))).groupBy("k").agg(*[F.sum(c).alias(c) for c in "not"])
    counts = written(counts, "toxicity-counts")
    got = counts.where("k >= 0").toArrow()  # CELLS rows at most

    def dense(name: str) -> np.ndarray:
        out = np.zeros(CELLS)
        out[got["k"].to_numpy()] = got[name].to_numpy()
        return out

    chain = shared_chain(dense("n"))
    t, o = (discounted(dense(c), chain, DISCOUNT) for c in "to")
    letters = np.log(np.maximum(t, 1e-12) / np.maximum(o, 1e-12)).astype(np.float32)
    keys, words, slack, rest = word_evidence(counts.where("k < 0"), most_words)
    model = Model(letters, keys, words, np.zeros(FEATURES + 1), slack, rest=rest)
    held = spark.sparkContext.broadcast(replace(model, rest=None))

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([held.value.evidence(t) for t in b["text"]]).reshape(-1, FEATURES)
            yield pd.DataFrame({"h": b["h"], "y": b["y"]} | {f"x{i}": x[:, i] for i in range(FEATURES)})

    each = rows.select(F.xxhash64("doc_id").alias("h"), "text", "y")
    if rest is None:
        each = each.mapInPandas(evidence, "h long, y int, " + ", ".join(f"x{i} double" for i in range(FEATURES)))
    else:
        each = features(model, each, "x").select("h", "y", *[F.col("x")[i].alias(f"x{i}") for i in range(FEATURES)])
    got = each.toPandas().sort_values(["h", "y"])  # 2 * (per_class // 4) rows at most
    y = got["y"].to_numpy(dtype=float)
    model.prior = float(y.mean()) if len(y) else 0.5
    if len(y) >= 8 and 0 < y.sum() < len(y):
        model.curve, model.fitted = logistic(got[[f"x{i}" for i in range(FEATURES)]].to_numpy(), y), True
        model.curve[0] += odds_shift(labels, label, model.prior)
    return model


def scored(model: Model, docs: DataFrame, to: str) -> DataFrame:
    """docs with column `to`: the probability of label 1 for column text, by all words that have evidence."""
    if model.rest is None or not model.fitted:
        return docs.withColumn(to, score(model, F.col("text"), docs.sparkSession))
    shared, x = docs.sparkSession.sparkContext.broadcast(replace(model, rest=None)), free_name([*docs.columns, to], "x")

    @F.pandas_udf("double")
    def curved(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.curved(np.array(v.tolist(), dtype=np.float64).reshape(-1, FEATURES)))

    return features(model, docs, x).withColumn(to, curved(x)).drop(x)


def score(model: Model, text: Column, spark) -> Column:
    """The probability of label 1 for a text column, by the words that the model holds. What is broadcast has 4 MB and 12 bytes a word of the model (MOST_WORDS)."""
    shared = spark.sparkContext.broadcast(replace(model, rest=None))

    @F.pandas_udf("double")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(shared.value.probability(s))

    return udf(text)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    model = fit(docs, labels, "toxic", per_class, most_words)
    out = scored(model, docs.select("doc_id", "text"), "score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns as they are."""
    model, name = fit(docs, labels, "toxic", per_class), free_name(docs.columns, "score")
    return scored(model, docs, name).where(F.col(name) < THRESHOLD).select(*docs.columns)
