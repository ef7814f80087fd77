"""Text classifiers over tables (key, text, label).

Counts and gradients are aggregated where the rows lie. The two learners that are defined by the order of their examples
(maximum entropy by stochastic steps, averaged perceptron) run in one task over the rows in key order. Weights are bounded
by the vocabulary, a parameter, so models are small objects that travel with the prediction function.
"""

from __future__ import annotations

import json
import math
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches
from ..functions import text as T
from ..functions.arrow import arrow_function

JOINER = "\x01"


def features(text: Column | str, least: int = 1, most: int = 1, binary: bool = False) -> Column:
    """Array of a text's n-grams, their tokens joined; each once if binary."""
    toks = T.ascii_tokens(text)

    def joined(n: int) -> Column:
        m = F.greatest(F.size(toks) - (n - 1), F.lit(0))
        kind = "array<struct<" + ",".join(f"g{k}:string" for k in range(n)) + ">>"
        rows = F.arrays_zip(*(F.slice(toks, F.lit(k + 1), m).alias(f"g{k}") for k in range(n))).cast(kind)
        return F.transform(rows, lambda r: F.concat_ws(JOINER, *(r[f"g{k}"] for k in range(n))))

    parts = [toks if n == 1 else joined(n) for n in range(least, most + 1)]
    out = F.concat(*parts) if len(parts) > 1 else parts[0]
    return F.array_distinct(out) if binary else out


@dataclass
class Vectorizer:
    """n-grams to ids: the max_features most frequent, ties by the feature."""

    least: int = 1
    most: int = 1
    binary: bool = False
    max_features: int = 12000
    vocabulary: list[str] = field(default_factory=list)

    def _counted(self, docs: DataFrame, text: str) -> DataFrame:
        """(feature, n) of all n-grams: strings that are joined without a lambda, after their words were told apart."""
        parts = [T.zipped("t", range(n), self.most) for n in range(self.least, self.most + 1)]
        rows = docs.select(T.ascii_tokens(text).alias("t")).select(F.explode(F.concat(*parts)).alias("g"))
        return rows.select(F.concat_ws(JOINER, *(f"g.w{i + 1}" for i in range(self.most))).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))

    def fit(self, docs: DataFrame, text: str = "text") -> Vectorizer:
        rows = self._counted(docs, text)
        self.vocabulary = [r["feature"] for r in rows.orderBy(F.desc("n"), "feature").limit(max(64, self.max_features)).collect()]
        return self

    def table(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(id, feature, n): the vocabulary as it would be fitted, without leaving the cluster."""
        from .counts import rank_by

        top = self._counted(docs, text).orderBy(F.desc("n"), "feature").limit(max(64, self.max_features))
        return rank_by(top, F.desc("n"), F.col("feature")).select(F.col("rank").alias("id"), "feature", "n")

    def encoder(self) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A function of texts: ids (ascending in a text) and values of all texts, and where each text's begin and the
        last's end. An n-gram is looked up by its beginning and its last word, all n-grams of a batch at once."""
        words: dict[str, int] = {}
        beginnings: dict[tuple[int, int], int] = {}
        found: list[tuple[int, int]] = []
        for i, f in enumerate(self.vocabulary):
            b = -1
            parts = f.split(JOINER)
            for k, w in enumerate(parts):
                w = words.setdefault(w, len(words))
                b = beginnings.setdefault((b, w), len(beginnings))
                if k == len(parts) - 1 and self.least <= k + 1 <= self.most:
                    found.append((b, i))
        size = max(1, len(words))
        at = np.full(len(beginnings) + 1, -1)  # the feature that a beginning is
        for b, i in found:
            at[b] = i
        keys = np.array([(b + 1) * size + w for b, w in beginnings], np.int64)
        order = np.argsort(keys)
        keys, places = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, -1)
        d, most, least, binary = max(1, len(self.vocabulary)), self.most, self.least, self.binary

        def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            toks, first = batches.tokens(texts, lower=True)
            toks = toks.dictionary_encode()
            own = np.array([words.get(w, -1) for w in toks.dictionary.to_pylist()] + [-1])
            w = own[toks.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(len(texts)), np.diff(first))
            hits, b = [], np.full(len(w), -1)
            for n in range(1, most + 1):
                # of the n-gram that begins here: its beginning so far and its next word
                k = len(w) - n + 1
                if k <= 0:
                    break
                b, last = b[:k], w[n - 1 :]
                key = np.where((last >= 0) & (row[:k] == row[n - 1 :]) & ((b >= 0) | (n == 1)), (b + 1) * size + last, -1)
                place = np.searchsorted(keys, key)
                b = np.where(keys[place] == key, places[place], -1)
                if n >= least:
                    f = at[b]
                    hits.append(row[:k][f >= 0] * d + f[f >= 0])
            x, values = np.unique(np.concatenate(hits) if hits else np.zeros(0, np.int64), return_counts=True)
            return x % d, np.ones(len(x)) if binary else values.astype(float), np.searchsorted(x, np.arange(len(texts) + 1) * d)

        return run

    def encode(self, text: Column | str) -> Column:
        """struct of ids (ascending) and values; unknown features are left out."""
        run = self.encoder()

        def encoded(a: pa.Array) -> pa.Array:
            ids, values, ends = run(a)
            ends = pa.array(ends, pa.int32())
            parts = [pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(values, pa.float64()))]
            return pa.StructArray.from_arrays(parts, names=["ids", "values"], mask=a.is_null())

        return F.arrow_udf(encoded, "struct<ids:array<int>,values:array<double>>")(F.col(text) if isinstance(text, str) else text)

    def to_json(self) -> str:
        return json.dumps({"version": 1, **asdict(self)})

    @classmethod
    def from_json(cls, payload: str) -> Vectorizer:
        p = json.loads(payload)
        if p.pop("version", None) != 1:
            raise ValueError("unknown version of a vectorizer")
        return cls(**p)


def coordinates(docs: DataFrame, v: Vectorizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, feature_id, value): a batch of sparse rows."""
    x = docs.select(key, v.encode(text).alias("x"))
    return x.select(key, F.explode(F.arrays_zip("x.ids", "x.values")).alias("e")).select(key, F.col("e.ids").alias("feature_id"), F.col("e.values").alias("value"))


def linear_scores(rows: DataFrame, weights: DataFrame, bias: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, class, score) of sparse rows (key, feature_id, value): bias + sum of weight * value; unknown features count 0."""
    part = rows.join(weights, "feature_id").groupBy(key, "class").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    grid = rows.select(key).distinct().crossJoin(F.broadcast(bias))
    return grid.join(part, [key, "class"], "left").select(key, "class", (F.col("bias") + F.coalesce("s", F.lit(0.0))).alias("score"))


@dataclass
class Linear:
    """Weights and bias by label; kind says how scores are made: sigmoid, margin, softmax or sum."""

    kind: str
    vectorizer: Vectorizer
    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def _scores(self, ids: list[int], values: list[float]) -> np.ndarray:
        z = self.bias + self.weights[:, ids] @ np.asarray(values, float) if ids else self.bias.copy()
        if self.kind == "sigmoid":
            return 1 / (1 + np.exp(-z))
        if self.kind == "softmax":
            e = np.exp(z - z.max())
            return e / e.sum()
        return z

    def predict(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with label and scores (by label, best first; ties in label order)."""

        def run(x: dict) -> dict:
            s = self._scores(x["ids"], x["values"])
            order = sorted(range(len(s)), key=lambda i: (-s[i], i))
            return {"label": self.labels[order[0]], "scores": [{"label": self.labels[i], "score": float(s[i])} for i in order]}

        p = arrow_function(run, "struct<label:string,scores:array<struct<label:string,score:double>>>")(self.vectorizer.encode(text))
        return docs.withColumn("__p", p).withColumns({"label": F.col("__p.label"), "scores": F.col("__p.scores")}).drop("__p")

    def to_json(self) -> str:
        return json.dumps({"version": 1, "kind": self.kind, "vectorizer": json.loads(self.vectorizer.to_json()), "labels": self.labels, "weights": self.weights.tolist(), "bias": self.bias.tolist()})

    @classmethod
    def from_json(cls, payload: str) -> Linear:
        p = json.loads(payload)
        w, b = np.array(p["weights"]), np.array(p["bias"])
        if p["version"] != 1 or w.shape != (len(p["labels"]), len(p["vectorizer"]["vocabulary"])) or len(b) != len(p["labels"]):
            raise ValueError("the model's sizes don't fit")
        return cls(p["kind"], Vectorizer.from_json(json.dumps(p["vectorizer"])), p["labels"], w, b)


def _labels(rows: DataFrame, least: int = 1) -> list[str]:
    found = sorted(r["label"] for r in rows.select("label").distinct().collect())
    if len(found) < least:
        raise ValueError(f"training needs {least} labels or more")
    return found


def _summed(rows: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """Sum of an array that each partition makes; over many partitions in two steps."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([f(batches).tobytes()], pa.binary())], names=["g"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for g in b.column(0):
                x = np.frombuffer(g.as_py())
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    parts = rows.mapInArrow(each, "g binary")
    if rows.rdd.getNumPartitions() > 64:
        parts = parts.repartition(16).mapInArrow(both, "g binary")
    return sum(np.frombuffer(r["g"]) for r in parts.collect())


def _ids_kind(v: Vectorizer) -> type:
    return np.uint16 if len(v.vocabulary) <= 1 << 16 else np.int32


def _examples(rows: DataFrame, v: Vectorizer, labels: list[str], key: str | None = None) -> DataFrame:
    """(key if given, ids, values, label) of the labelled rows: features as bytes of _ids_kind and 4-byte floats, labels
    by their places. A feature takes 6 bytes so, not two objects of Python."""
    at, kind = {label: i for i, label in enumerate(labels)}, _ids_kind(v)

    def flat(lists: pa.ListArray, of: type) -> pa.Array:
        ends = np.asarray(lists.offsets)
        data = lists.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).astype(of)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer((ends - ends[0]).astype(np.int64) * data.itemsize), pa.py_buffer(data)]).cast(pa.binary())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            cols = [flat(x.field("ids"), kind), flat(x.field("values"), np.float32), pa.array([at[y] for y in batch.column("label").to_pylist()], pa.int32())]
            yield pa.RecordBatch.from_arrays([*([batch.column(key)] if key else []), *cols], names=[*([key] if key else []), "ids", "values", "label"])

    own = [key] if key else []
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in own), "ids binary", "values binary", "label int"])
    return rows.filter("label is not null").select(*own, v.encode("text").alias("x"), "label").mapInArrow(pack, schema)


def _joined(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows one after another, and how many each row has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.array([len(x) for x in parts], np.int64) // np.dtype(kind).itemsize


def _descent(kind: str, rows: DataFrame, v: Vectorizer, epochs: int, rate: float, l2: float, margin: float) -> Linear:
    v.fit(rows)
    labels = _labels(rows)
    k, d = len(labels), len(v.vocabulary)
    data = _examples(rows, v, labels).persist()
    n = data.count()
    w, b = np.zeros((k, d)), np.zeros(k)
    of = _ids_kind(v)
    for _ in range(epochs):

        def gradient(batches: Iterator[pa.RecordBatch], w=w, b=b) -> np.ndarray:
            g = np.zeros((k, d + 1))
            for batch in batches:
                ids, sizes = _joined(batch.column("ids"), of)
                values = _joined(batch.column("values"), np.float32)[0].astype(float)
                row = np.repeat(np.arange(len(sizes)), sizes)
                z = b[:, None] + np.stack([np.bincount(row, w[c, ids] * values, len(sizes)) for c in range(k)])
                y = np.asarray(batch.column("label")) == np.arange(k)[:, None]
                if kind == "sigmoid":
                    e = y - 1 / (1 + np.exp(-z))
                else:
                    s = 2.0 * y - 1
                    e = np.where(s * z < margin, s, 0.0)
                for c in range(k):
                    g[c, :d] += np.bincount(ids, e[c, row] * values, d)
                g[:, d] += e.sum(1)
            return g

        g = _summed(data, gradient).reshape(k, d + 1) / n
        w = w + rate * (g[:, :d] - l2 * w)
        b = b + rate * g[:, d]
    data.unpersist()
    return Linear(kind, v, labels, w, b)


def train_logistic(rows: DataFrame, epochs: int = 20, rate: float = 0.1, l2: float = 1e-4, max_features: int = 16000) -> Linear:
    """One against the rest, by full-batch gradient steps from zero."""
    return _descent("sigmoid", rows, Vectorizer(1, 2, False, max(256, max_features)), epochs, rate, l2, 1.0)


def train_svm(rows: DataFrame, epochs: int = 20, rate: float = 0.05, l2: float = 5e-4, margin: float = 1.0, max_features: int = 16000) -> Linear:
    """One against the rest, by full-batch subgradient steps of the hinge loss."""
    return _descent("margin", rows, Vectorizer(1, 2, False, max(256, max_features)), epochs, rate, l2, max(0.1, margin))


@dataclass
class Ordered:
    """Examples in order, their features in files that are mapped: example i has those from ends[i] to ends[i + 1]."""

    ids: np.ndarray
    values: np.ndarray
    ends: np.ndarray
    labels: np.ndarray

    @classmethod
    def read(cls, batches: Iterator[pa.RecordBatch], kind: type, folder: str) -> Ordered:
        sizes, labels = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)]
        with open(f"{folder}/ids", "wb") as ids, open(f"{folder}/values", "wb") as values:
            for batch in batches:
                own, n = _joined(batch.column("ids"), kind)
                ids.write(own)
                values.write(_joined(batch.column("values"), np.float32)[0])
                sizes.append(n)
                labels.append(np.asarray(batch.column("label")))
        ends = np.cumsum(np.concatenate(sizes))
        mapped = lambda name, of: np.asarray(np.memmap(f"{folder}/{name}", of, "r")) if ends[-1] else np.zeros(0, of)
        return cls(mapped("ids", kind), mapped("values", np.float32), ends, np.concatenate(labels))


def _in_order(rows: DataFrame, v: Vectorizer, key: str, labels: list[str], learn: Callable[[Ordered], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a learner that takes its examples one after another, in key order, in one task."""
    kind = _ids_kind(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="lexmill-examples-") as folder:
            w, b = learn(Ordered.read(batches, kind, folder))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["w", "b"])

    data = _examples(rows, v, labels, key).repartition(1).sortWithinPartitions(key).select("ids", "values", "label")
    r = data.mapInArrow(run, "w binary, b binary").first()
    return np.frombuffer(r["w"]).reshape(len(labels), -1).copy(), np.frombuffer(r["b"]).copy()


def _softmax_steps(data: Ordered, k: int, d: int, epochs: int, rate: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    # a feature's weights lie side by side, so that an example's are read and written as rows; with large steps rounding
    # decides labels, so every operation is the one that the plain formulas have
    w, b = np.zeros((d, k)), np.zeros(k)
    ends, labels = data.ends.tolist(), data.labels.tolist()
    for _ in range(epochs):
        for y, start, end in zip(labels, ends, ends[1:], strict=False):
            if start < end:
                ids, x = data.ids[start:end], data.values[start:end].astype(float)
                own = w.take(ids, 0)
                z = b + own.T @ x
            else:
                z = b + 0.0
            p = np.exp(z - z.max())
            e = -p / p.sum()
            e[y] += 1
            b += rate * e
            if start < end:
                step = x[:, None] * e
                step -= l2 * own
                step *= rate
                step += own
                w[ids] = step
    return w.T.copy(), b


def train_maxent(rows: DataFrame, key: str = "doc_id", epochs: int = 25, rate: float = 0.15, l2: float = 1e-4, max_features: int = 12000) -> Linear:
    """Softmax by one step a document, in key order; weights decay where they are used."""
    labels = _labels(rows, 2)
    v = Vectorizer(1, 1, False, max(100, max_features)).fit(rows)
    if not v.vocabulary:
        raise ValueError("the training texts have no words")
    return Linear("softmax", v, labels, *_in_order(rows, v, key, labels, lambda data: _softmax_steps(data, len(labels), len(v.vocabulary), epochs, rate, l2)))


#: The conditional exponential model is the maximum-entropy model under its other name.
train_conditional_exponential = train_maxent


def _perceptron_steps(data: Ordered, k: int, d: int, epochs: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights change by mistakes alone: until the next one all examples are judged by the same weights, many at once."""
    w, b = np.zeros((d, k)), np.zeros(k)
    sw, sb = np.zeros_like(w), np.zeros_like(b)
    n = len(data.labels)
    steps, many = epochs * n, 16
    for epoch in range(epochs):
        i = 0
        while i < n:
            j = min(n, i + many)
            ends = data.ends[i : j + 1]
            there = np.flatnonzero(ends[1:] > ends[:-1])
            s = np.zeros((j - i, k))
            if len(there):
                s[there] = np.add.reduceat(w.take(data.ids[ends[0] : ends[-1]], 0), ends[:-1][there] - ends[0], 0)
            guess = np.argmax(b + s, 1)
            wrong = np.flatnonzero(guess != data.labels[i:j])
            if not len(wrong):
                i, many = j, min(2 * many, 4096)
                continue
            at = int(wrong[0])
            ids = data.ids[ends[at] : ends[at + 1]]
            left = steps - (epoch * n + i + at)
            for c, sign in ((int(data.labels[i + at]), rate), (int(guess[at]), -rate)):
                b[c] += sign
                sb[c] += sign * left
                w[ids, c] += sign
                sw[ids, c] += sign * left
            i, many = i + at + 1, max(4, (many + 2 * at) // 2)
    return (sw.T / steps, sb / steps) if steps else (w.T.copy(), b)


def train_perceptron(rows: DataFrame, key: str = "doc_id", epochs: int = 18, rate: float = 1.0, max_features: int = 14000) -> Linear:
    """Averaged over every step. Sums are kept as weight times remaining steps, so that a step costs its own features."""
    labels = _labels(rows, 2)
    v = Vectorizer(1, 2, True, max(256, max_features)).fit(rows)
    return Linear("sum", v, labels, *_in_order(rows, v, key, labels, lambda data: _perceptron_steps(data, len(labels), len(v.vocabulary), epochs, rate)))


# Naive Bayes


@dataclass
class NaiveBayes:
    """labels (label, docs, tokens), words (label, token, n), V and number of documents."""

    labels: DataFrame
    words: DataFrame
    vocabulary: DataFrame
    smoothing: float = 1.0

    @classmethod
    def train(cls, rows: DataFrame, smoothing: float = 1.0, text: str = "text") -> NaiveBayes:
        toks = rows.select("label", F.explode(T.ascii_tokens(text)).alias("token"))
        words = toks.groupBy("label", "token").agg(F.count("*").alias("n"))
        totals = words.groupBy("label").agg(F.sum("n").alias("tokens"))
        labels = rows.groupBy("label").agg(F.count("*").alias("docs")).join(totals, "label", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        return cls(labels, words, words.select("token").distinct(), max(1e-9, smoothing))

    def scores(self, docs: DataFrame, key: str = "doc_id", text: str = "text", unknown: bool = False) -> DataFrame:
        """(key, label, log_score). Tokens that training never saw are left out unless unknown."""
        s = self.smoothing
        sizes = self.labels.agg(F.sum("docs").alias("D"), F.count("*").alias("L")).crossJoin(self.vocabulary.agg(F.count("*").alias("V")))
        prior = self.labels.crossJoin(sizes).withColumn("prior", F.log((F.col("docs") + s) / (F.col("D") + s * F.col("L"))))
        counts = docs.select(key, F.explode(T.ascii_tokens(text)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("c"))
        if not unknown:
            counts = counts.join(self.vocabulary, "token", "left_semi")
        # seen words by label; what is unseen under a label is the same for all of its words
        base = F.log(F.lit(s) / (F.col("tokens") + s * F.col("V")))
        all_ = counts.groupBy(key).agg(F.sum("c").alias("all"))
        gain = F.sum(F.col("c") * F.log((F.col("n") + s) / s))
        seen = counts.join(self.words, "token").groupBy(key, "label").agg(gain.alias("gain"))
        grid = docs.select(key).distinct().crossJoin(F.broadcast(prior)).join(all_, key, "left").join(seen, [key, "label"], "left")
        score = F.col("prior") + F.coalesce("all", F.lit(0)) * base + F.coalesce("gain", F.lit(0.0))
        return grid.select(key, "label", score.alias("log_score"))

    def predict(self, docs: DataFrame, key: str = "doc_id", text: str = "text", unknown: bool = False) -> DataFrame:
        """(key, label, log_score) of the best label; ties by label."""
        best = F.max_by(F.struct("label", "log_score"), F.struct(F.round("log_score", 9), F.col("order"))).alias("b")
        order = self.labels.select("label").orderBy(F.desc("label")).select("label", F.monotonically_increasing_id().alias("order"))
        return self.scores(docs, key, text, unknown).join(F.broadcast(order), "label").groupBy(key).agg(best).select(key, "b.label", "b.log_score")


# Positive and unlabelled texts


@dataclass
class PositiveNaiveBayes:
    words: DataFrame
    prior: float
    base: DataFrame

    @classmethod
    def train(cls, positive: DataFrame, unlabelled: DataFrame, prior: float = 0.5, max_features: int = 12000) -> PositiveNaiveBayes:
        """Presence of words in texts known to be positive and in a mixture."""
        prior = min(0.999, max(0.001, prior))
        seen = lambda df, name: df.select(F.explode(F.array_distinct(T.ascii_tokens("text"))).alias("token")).groupBy("token").agg(F.count("*").alias(name))
        both = seen(positive, "c").join(seen(unlabelled, "m"), "token", "full_outer").na.fill(0)
        both = both.orderBy(F.desc(F.col("c") + F.col("m")), "token").limit(max_features)
        size = positive.agg(F.count("*").alias("P")).crossJoin(unlabelled.agg(F.count("*").alias("U")))
        p = (F.col("c") + 1) / (F.col("P") + 2)
        g = (F.col("m") + 1) / (F.col("U") + 2)
        neg = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (g - prior * p) / max(1e-9, 1 - prior)))
        words = both.crossJoin(F.broadcast(size)).select("token", p.alias("p"), neg.alias("q"))
        # log odds of being there, and of not being there
        words = words.select("token", F.log(F.col("p") / F.col("q")).alias("here"), F.log((1 - F.col("p")) / (1 - F.col("q"))).alias("gone"))
        return cls(words, prior, words.agg(F.coalesce(F.sum("gone"), F.lit(0.0)).alias("gone")))

    def odds(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, odds): the logarithm of the odds that a text is positive."""
        toks = docs.select(key, F.explode(F.array_distinct(T.ascii_tokens("text"))).alias("token"))
        own = toks.join(self.words, "token").groupBy(key).agg(F.sum(F.col("here") - F.col("gone")).alias("s"))
        z = F.coalesce("s", F.lit(0.0)) + F.col("gone") + math.log(self.prior / (1 - self.prior))
        return docs.select(key).distinct().join(own, key, "left").crossJoin(F.broadcast(self.base)).select(key, z.alias("odds"))

    def predict(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, probability, positive)."""
        p = 1 / (1 + F.exp(-F.col("odds")))
        return self.odds(docs, key).select(key, p.alias("probability"), (p >= 0.5).alias("positive"))


# Decision trees

#: Counts that a task of a decision tree's level holds at once.
CELLS = 1 << 23


def _walk(splits: dict[str, int], names: list[str], d: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of the features of all rows one after another, and how many each row has: the place among names of the
    node that each row comes to by the splits, -1 if it is none of them."""
    inner = list(splits)
    column = np.full(d, -1)  # of the features that decide something
    used = {f: i for i, f in enumerate(dict.fromkeys(splits.values()))}
    for f, i in used.items():
        column[f] = i
    place = {n: i for i, n in enumerate(inner)} | {n: -2 - i for i, n in enumerate(names) if n not in splits}
    children = np.array([[place.get(n + side, -1) for side in "01"] for n in inner], np.int64).reshape(-1, 2)
    asked = np.array([used[f] for f in splits.values()], np.int64)
    root, depth = place.get("", -1), max((len(n) for n in inner), default=-1) + 1

    def run(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        has = np.zeros((len(sizes), max(1, len(used))), bool)
        c = column[ids]
        has[np.repeat(np.arange(len(sizes)), sizes)[c >= 0], c[c >= 0]] = True
        at = np.full(len(sizes), root)
        for _ in range(depth):
            rows = np.flatnonzero(at >= 0)
            n = at[rows]
            at[rows] = children[n, has[rows, asked[n]].astype(int)]
        return np.where(at <= -2, -2 - at, -1)

    return run


def _node_counts(splits: dict[str, int], names: list[str], k: int, d: int, kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, feature, label, n) of a part's rows that come to the named nodes: one array of counts a part."""
    walk = _walk(splits, names, d)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(names) * k * d, np.int64)
        for batch in parts:
            ids, sizes = _joined(batch.column("ids"), kind)
            node = walk(ids, sizes)
            group = np.repeat(np.where(node >= 0, node * k + np.asarray(batch.column("label")), -1), sizes)
            seen += np.bincount(group[group >= 0] * d + ids[group >= 0], minlength=len(seen))
        at = np.flatnonzero(seen)
        for i in range(0, len(at), batches.ROWS):
            x = at[i : i + batches.ROWS]
            group = x // d
            cols = [pa.array(group // k, pa.int32()), pa.array(x % d, pa.int32()), pa.array(group % k, pa.int32()), pa.array(seen[x])]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "f", "label", "n"])

    return run


@dataclass
class DecisionTree:
    """tree: {"label", "counts"} or {"feature", "absent", "present"}."""

    vectorizer: Vectorizer
    tree: dict

    @classmethod
    def train(cls, rows: DataFrame, max_depth: int = 8, min_rows: int = 2, candidates: int = 256, max_features: int = 12000) -> DecisionTree:
        """Level by level: one aggregate of (node, feature, label) serves all nodes of a level, and says how many rows of
        each label its children have. Rows are told their nodes where they lie, from the splits so far; a node's name is
        a 0 or 1 for each split on its way. Nodes whose counts would not fit together are counted in turns."""
        from pyspark.sql import Window as W

        v = Vectorizer(1, 2, True, max_features).fit(rows)
        labels = _labels(rows.filter("label is not null"), 0)
        data = _examples(rows, v, labels).persist()
        d, kind = max(1, len(v.vocabulary)), _ids_kind(v)
        nodes: dict[str, dict] = {}
        sizes = {"": {labels[r["label"]]: r["count"] for r in data.groupBy("label").count().orderBy("label").collect()}}
        # few parts, as each counts all features of a node once
        parts = data.coalesce(max(64, data.sparkSession.sparkContext.defaultParallelism))
        each = max(1, CELLS // (d * max(1, len(labels))))
        splits: dict[str, int] = {}
        for depth in range(max_depth + 1):
            open_ = []
            for n, counts in sizes.items():
                nodes[n] = {"label": min(counts, key=lambda x: (-counts[x], x)) if counts else "", "counts": counts}
                if len(counts) > 1 and depth < max_depth and sum(counts.values()) >= min_rows:
                    open_.append(n)
            if not open_:
                break
            best: dict[str, tuple[float, int, dict[str, int], dict[str, int]]] = {}
            for start in range(0, len(open_), each):
                some = open_[start : start + each]
                seen = parts.mapInArrow(_node_counts(splits, some, len(labels), d, kind), "node int, f int, label int, n long")
                seen = seen.groupBy("node", "f", "label").agg(F.sum("n").alias("n")).groupBy("node", "f").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by"), F.sum("n").alias("n"))
                ranked = seen.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("n"), "f"))).filter(F.col("r") <= max(4, candidates))
                for r in sorted(ranked.collect(), key=lambda r: (r["node"], r["r"])):
                    node = some[r["node"]]
                    counts = sizes[node]
                    total = sum(counts.values())
                    there = {labels[y]: c for y, c in sorted(r["by"].items())}
                    gone = {k: c - there.get(k, 0) for k, c in counts.items()}
                    if r["n"] == total:
                        continue
                    gain = _entropy(counts) - r["n"] / total * _entropy(there) - (total - r["n"]) / total * _entropy(gone)
                    if gain > best.get(node, (1e-9,))[0]:
                        best[node] = (gain, r["f"], there, {k: c for k, c in gone.items() if c})
            if not best:
                break
            splits |= {n: f for n, (_, f, _, _) in best.items()}
            sizes = {n + side: c for n, (_, _, there, gone) in best.items() for side, c in (("0", gone), ("1", there))}
        data.unpersist()

        def build(n: str) -> dict:
            if n in splits:
                return {"feature": splits[n], "absent": build(n + "0"), "present": build(n + "1")}
            return nodes[n]

        return cls(v, build(""))

    def predict(self, docs: DataFrame, text: str = "text") -> DataFrame:
        run = self.vectorizer.encoder()
        splits: dict[str, int] = {}
        ends: dict[str, str] = {}
        todo = [("", self.tree)]
        while todo:
            n, at = todo.pop()
            if "feature" in at:
                splits[n] = at["feature"]
                todo += [(n + "0", at["absent"]), (n + "1", at["present"])]
            else:
                ends[n] = at["label"]
        names = list(ends)
        walk, labels = _walk(splits, names, max(1, len(self.vectorizer.vocabulary))), pa.array([ends[n] for n in names], pa.string())

        def predicted(a: pa.Array) -> pa.Array:
            ids, _, own = run(a)
            return pa.compute.if_else(a.is_null(), pa.scalar(None, pa.string()), labels.take(pa.array(walk(ids, np.diff(own)))))

        return docs.withColumn("label", F.arrow_udf(predicted, "string")(F.col(text)))

    def to_json(self) -> str:
        return json.dumps({"version": 1, "vectorizer": json.loads(self.vectorizer.to_json()), "tree": self.tree})

    @classmethod
    def from_json(cls, payload: str) -> DecisionTree:
        p = json.loads(payload)
        if p.get("version") != 1:
            raise ValueError("unknown version of a decision tree")
        return cls(Vectorizer.from_json(json.dumps(p["vectorizer"])), p["tree"])


def _entropy(counts: dict[str, int]) -> float:
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values() if c) if n else 0.0


def feature_text(features_: Column | str) -> Column:
    """A map of features as a text that the learners above take: "feature KEY value VALUE" for each key in order."""
    f = F.col(features_) if isinstance(features_, str) else features_
    plain = lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit("null"))), "[^a-z0-9']+", " "))
    pairs = F.transform(F.array_sort(F.map_entries(f)), lambda e: F.struct(plain(e["key"]).alias("k"), plain(e["value"]).alias("v")))
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("feature "), p["k"], F.lit(" value "), p["v"])), " ")


def probabilities(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label, prob) from log scores, normalised within a key."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key)
    e = F.exp(F.col("log_score") - F.max("log_score").over(w))
    return scores.withColumn("__e", e).select(key, "label", (F.col("__e") / F.sum("__e").over(w)).alias("prob"))
