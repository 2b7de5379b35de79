"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on a bounded sample of labelled rows; every path from a root is a rule,
a conjunction of thresholds. A lasso logistic fit keeps few of them, and the model is compiled
to one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, table, texts

#: Labelled rows used for fitting at most, the first by a hash of their id.
MAX_LABELS = 20_000


#: Names of the text statistics in order.
STATISTICS = ["log_chars", "word_length", "distinct_words", "distinct_lines", "lines", "symbols", "digits", "upper", "stops", "letters"]
_SYMBOLS, _STOPS = list(b"!#$%&*+<=>?@[\\]^_`{|}~/"), list(b".,;:")


def text_statistics(text: str) -> list[float]:
    """Statistics of one whole text, from its byte histogram, words and lines; defined for empty texts too."""
    data = text.encode()
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    n, w = max(len(text), 1), max(len(words), 1)
    # of two-byte letters, the second bytes 0x80 to 0x9E are capitals in Latin scripts
    return [
        float(np.log1p(len(text))),
        n / w,
        len(set(words)) / w,
        len(set(lines)) / len(lines),
        len(lines) / w,
        float(h[_SYMBOLS].sum()) / n,
        float(h[48:58].sum()) / n,
        float(h[65:91].sum() + h[0x80:0x9F].sum()) / n,
        float(h[_STOPS].sum()) / w,
        float(h[65:91].sum() + h[97:123].sum() + h[0xC0:].sum()) / n,
    ]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``__stat_<name>`` for each statistic; a null text counts as empty. Map-only."""
    schema = docs.withColumns({f"__stat_{k}": F.lit(0.0) for k in STATISTICS}).schema

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = np.array([text_statistics(t) for t in texts(part.column(text))]).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(found[:, k]) for k in range(len(STATISTICS)))], [f.name for f in schema]
                )

    return docs.mapInArrow(run, schema)


@dataclass
class Rule:
    """All of (feature, is greater, threshold) hold."""

    terms: tuple[tuple[int, bool, float], ...]

    def on(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, greater, t in self.terms:
            out &= (x[:, f] > t) == greater
        return out


@dataclass
class RuleModel:
    names: list[str]
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def column(self, values: dict[str, Column]) -> Column:
        """The score as a Spark expression over columns of statistics."""
        z = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for f, greater, t in rule.terms:
                v = values[self.names[f]]
                test = test & ((v > t) if greater else (v <= t))
            z = z + F.when(test, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + sum((w * r.on(x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, features: int, least: int) -> list[Rule]:
    """Paths of one tree: splits by Gini gain over a random choice of features, at quantiles."""
    out: list[Rule] = []

    def split(rows, terms):
        if terms:
            out.append(Rule(tuple(terms)))
        if len(terms) == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return
        best, at = 1e-9, None
        for f in rng.choice(x.shape[1], min(features, x.shape[1]), replace=False):
            v = x[rows, f]
            for t in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25), method="lower")):
                left = v <= t
                a = int(left.sum())
                if min(a, len(v) - a) < least:
                    continue
                p, q = y[rows][left].mean(), y[rows][~left].mean()
                gain = (p - q) ** 2 * a * (len(v) - a) / len(v)
                if gain > best:
                    # between the threshold and the next value
                    above = v[~left].min()
                    best, at = gain, (int(f), float((t + above) / 2 if np.isfinite(above - t) else t))
        if at is None:
            return
        f, t = at
        left = x[rows, f] <= t
        split(rows[left], [*terms, (f, False, t)])
        split(rows[~left], [*terms, (f, True, t)])

    split(np.arange(len(x)), [])
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 500) -> tuple[np.ndarray, float]:
    """L1 logistic regression by accelerated proximal gradient; the bias isn't penalised."""
    n, m = r.shape
    a = r.astype(np.float32)
    times = lambda v: (a @ v[:m].astype(np.float32)).astype(float) + v[m]
    back = lambda z: np.r_[(z.astype(np.float32) @ a).astype(float), z.sum()]
    top = np.ones(m + 1)
    for _ in range(50):  # power iteration for the largest singular value
        top = back(times(top / np.linalg.norm(top)))
    step = 3.9 * n / max(np.linalg.norm(top), 1e-12)
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        g = back(1 / (1 + np.exp(-np.clip(times(v), -30, 30))) - y) / n
        u = v - step * g
        u[:m] = np.sign(u[:m]) * np.maximum(np.abs(u[:m]) - step * penalty, 0)
        t, s = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, v = u, u + (s - 1) / t * (u - w)
    return w[:m], float(w[m])


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, penalty: float = 2e-3, seed: int = 7) -> RuleModel:
    """Rules from trees on bootstrap samples, weighted by lasso; a constant if one class is missing."""
    if len(y) == 0 or y.min() == y.max():
        return RuleModel(names, bias=4.0 if len(y) == 0 or y.max() == 1 else -4.0)
    rng = np.random.default_rng(seed)
    rules: dict[tuple, Rule] = {}
    for _ in range(trees):
        rows = rng.integers(0, len(x), min(len(x), 5000))
        for rule in grow(x[rows], y[rows], rng, depth, max(3, x.shape[1] // 2), max(5, len(rows) // 500)):
            rules.setdefault(rule.terms, rule)
    kept = list(rules.values())
    by_rows: dict[bytes, Rule] = {}
    for rule in kept:  # rules that say the same on all rows count once
        by_rows.setdefault(np.packbits(rule.on(x)).tobytes(), rule)
    kept = list(by_rows.values())
    r = np.unpackbits(np.frombuffer(b"".join(by_rows), np.uint8).reshape(len(kept), -(-len(x) // 8)), axis=1, count=len(x)).T
    w, bias = lasso(r, y.astype(float), penalty)
    on = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(names, [kept[k] for k in on], [float(w[k]) for k in on], bias)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labels: int = MAX_LABELS, **options) -> RuleModel:
    """Fit on at most ``max_labels`` labelled rows that aren't held out; statistics are computed by Spark.

    The bounded label sample is broadcast, so documents aren't shuffled; only its statistics
    reach the driver. Null labels and labels of unknown documents are left out.
    """
    sample = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key), 3, 1))
    sample = sample.select(F.col(key), F.col(label).cast("int").alias("_label")).orderBy(F.xxhash64(key), key, "_label").limit(max_labels)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample.withColumnRenamed(key, "key")), "key")
    stats = [f"__stat_{k}" for k in STATISTICS]
    got = statistics(rows).select("key", "_label", *stats).toPandas()
    got = got.sort_values(["key", "_label", *stats])  # the same rows in any order give the same model
    return fit_rules(got[stats].to_numpy(float), got["_label"].to_numpy(int), STATISTICS, **options)


def score(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` added (replaced where they exist); null texts score as empty ones."""
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    stats = statistics(docs.select(*rest), text)
    scored = stats.select(*rest, model.column({k: F.col(f"__stat_{k}") for k in model.names}).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier fitted on ``labels`` takes for good ones, with their own columns."""
    boxed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text"))
    return score(boxed, fit(docs, labels)).where("predicted = 1").select("__row.*")


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted"
    )


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
