"""Document toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model sees the text's
features and the log-odds of all categories before it. In training these
log-odds are out-of-fold predictions, so that a later model meets them as
wrong as they will be on new texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The chain: a category's name and its 0/1 label.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))
#: The model is fitted on so many labelled rows at most, those of smallest hash.
SAMPLE_ROWS = 20_000
#: Words per category that tell it best from the rest in the sample.
WORDS = 1500
FOLDS = 5
LEAST_P = 0.5

_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8").translate(_ASCII).split())


def shape(text: str) -> list[float]:
    """Numbers of a text's outer form, each from 0 to about 1."""
    n = max(1, len(text))
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    upper, digits = np.count_nonzero((raw >= 65) & (raw <= 90)), np.count_nonzero((raw >= 48) & (raw <= 57))
    return [np.log1p(len(text)) / 12, upper / n, min(1.0, 40 * text.count("!") / n), min(1.0, 40 * text.count("|") / n), min(1.0, 10 * digits / n)]


N_SHAPE = 5


class Linear:
    """Logistic regression over sparse 0/1 words and dense numbers."""

    def __init__(self, n_words: int, n_dense: int):
        self.w, self.d, self.b = np.zeros(n_words), np.zeros(n_dense), 0.0

    def fit(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> "Linear":
        """Full-batch gradient steps with per-weight scaling (Adam)."""
        n = len(y)
        if not n:
            return self
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        theta = np.concatenate((self.w, self.d, [0.0]))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        k = len(self.w)
        for step in range(1, rounds + 1):
            self.w, self.d, self.b = theta[:k], theta[k:-1], theta[-1]
            err = weight * (sigmoid(self.logits(rows, cols, dense)) - y) / n
            grad = np.concatenate((np.bincount(cols, err[rows], k) if k else np.zeros(0), dense.T @ err, [err.sum()])) + ridge / 10 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w, self.d, self.b = theta[:k], theta[k:-1], float(theta[-1])
        return self

    def logits(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray) -> np.ndarray:
        out = dense @ self.d + self.b
        return out + np.bincount(rows, self.w[cols], len(dense)) if len(rows) else out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Chain:
    def __init__(self, names: list[str], vocabulary: list[bytes]):
        self.names, self.at = names, {w: i for i, w in enumerate(vocabulary)}
        self.known = set(vocabulary)
        self.models: list[Linear] = []

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, cols = [], []
        for i, t in enumerate(texts):
            for w in words(t) & self.known:
                rows.append(i)
                cols.append(self.at[w])
        return np.array(rows, np.int64), np.array(cols, np.int64), np.array([shape(t) for t in texts]).reshape(-1, N_SHAPE)

    def fit(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> "Chain":
        for c in range(labels.shape[1]):
            y = labels[:, c]
            out = np.zeros(len(y))
            for f in range(FOLDS):
                train, test = fold != f, fold == f
                if not test.any() or not train.any():
                    continue
                number = np.cumsum(train) - 1
                own = train[rows]
                model = Linear(len(self.at), dense.shape[1]).fit(number[rows[own]], cols[own], dense[train], y[train])
                out[test] = model.logits(rows, cols, dense)[test]
            self.models.append(Linear(len(self.at), dense.shape[1]).fit(rows, cols, dense, y))
            dense = np.column_stack((dense, np.clip(out, -10, 10) / 10))
        return self

    def predict(self, texts: list[str]) -> np.ndarray:
        rows, cols, dense = self.features(texts)
        out = []
        for m in self.models:
            logit = m.logits(rows, cols, dense)
            out.append(sigmoid(logit))
            dense = np.column_stack((dense, np.clip(logit, -10, 10) / 10))
        return np.stack(out, 1) if out else np.zeros((len(texts), 0))


def fit(docs: DataFrame, labels: DataFrame, chain=CHAIN, text_col: str = "text", id_col: str = "doc_id", label_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Chain:
    """A chain fitted on a bounded sample of labelled rows; rows with a null label teach nothing, without rows it gives 0.5 for all."""
    names = [n for n, _ in chain]
    y = labels.select(F.col(label_id).alias("__id"), *[F.expr(e).cast("int").alias(n) for n, e in chain]).dropna()
    y = y.groupBy("__id").agg(*[F.max(n).alias(n) for n in names])
    y = y.withColumn("__h", F.xxhash64(F.lit("toxicity"), F.col("__id"))).orderBy("__h", "__id").limit(sample_rows)
    y = y.select("__id", *names, F.pmod("__h", F.lit(FOLDS)).cast("int").alias("fold"))
    # sample_rows small rows, so they may be broadcast
    sample = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(y), "__id").select("text", *names, "fold")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, np.ndarray] = {}
        for batch in batches:
            truth = np.stack([np.ones(batch.num_rows, np.int64), *[batch.column(1 + k).to_numpy() for k in range(len(names))]], 1)
            for t, own in zip(batch.column(0).to_pylist(), truth, strict=True):
                for w in words(t):
                    if w in n:
                        n[w] += own
                    else:
                        n[w] = own.copy()
        if n:
            table = np.stack(list(n.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), *[pa.array(table[:, k]) for k in range(table.shape[1])]], ["word", "n", *names])

    kinds = ", ".join(f"`{n}` bigint" for n in names)
    by_word = sample.mapInArrow(count, f"word binary, n bigint, {kinds}").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).where("n >= 5")
    totals = y.agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    vocabulary: set[bytes] = set()
    for name in names:
        ones, zeros = totals[name] or 0, totals["n"] - (totals[name] or 0)
        if not ones or not zeros:
            continue
        p1, p0, p = F.col(name) / ones, (F.col("n") - F.col(name)) / zeros, F.col("n") / totals["n"]
        z = F.abs(p1 - p0) / F.sqrt(p * (1.0001 - p) * (1 / ones + 1 / zeros))
        vocabulary |= {bytes(r[0]) for r in by_word.orderBy(z.desc(), "word").limit(WORDS).select("word").collect()}
    model = Chain(names, sorted(vocabulary))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows, cols, dense = model.features(texts)
            own = [cols[rows == i].tolist() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int64())), pa.array(dense.tolist(), pa.list_(pa.float64())), *batch.columns[1:]], ["cols", "dense", *names, "fold"])

    got = sample.mapInArrow(describe, "cols array<bigint>, dense array<double>, " + ", ".join(f"`{n}` int" for n in names) + ", fold int").collect()
    got.sort(key=lambda r: (r["fold"], r["dense"], r["cols"]))
    rows = np.repeat(np.arange(len(got)), [len(r["cols"]) for r in got]) if got else np.zeros(0, np.int64)
    cols = np.array([c for r in got for c in r["cols"]], np.int64)
    dense = np.array([r["dense"] for r in got]).reshape(-1, N_SHAPE)
    truth = np.array([[r[n] for n in names] for r in got], float).reshape(-1, len(names))
    return model.fit(rows, cols, dense, truth, np.array([r["fold"] for r in got]))


def predict(docs: DataFrame, model: Chain, text_col: str = "text", id_col: str = "doc_id", decide: str = "toxic") -> DataFrame:
    """id, a probability p_<category> for each category of the chain, and ``decide``: whether its probability is 0.5 or more.

    A null text counts as empty. Rows are judged one by one; other columns are
    left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                p = model.predict([x or "" for x in part.column(1).to_pylist()])
                flags = p[:, model.names.index(decide)] >= LEAST_P
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(flags)], [id_col, *[f"p_{n}" for n in model.names], decide])

    fields = [docs.schema[id_col], *[T.StructField(f"p_{n}", T.DoubleType()) for n in model.names], T.StructField(decide, T.BooleanType())]
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
