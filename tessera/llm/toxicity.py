"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are the words of a text and their first letters (4 to 6), present or not; training picks those whose share
of toxic documents stands out. P(grade > k) = sigmoid(w . x - theta_k), with one weight vector for all thresholds
theta_1 < theta_2 < ...; the output is the expected grade, sum of P(grade > k). Labels that only say toxic or not are
graded by how dense the picked words are: grade 0 is not toxic, 1 to `grades` - 1 cut the toxic ones into equal parts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import fresh, materialize

WORD = re.compile(r"[^\W\d_]+")
#: Rows of labels that training looks at; the bound of the sample.
SAMPLE = 20_000
#: Features the model keeps.
FEATURES = 4096
#: Standard errors that the log-odds of a feature must lie from 0: with all words tried, less is often chance.
CLEAR = 3.5
#: Documents a feature must occur in, so that single accidents don't count.
SUPPORT = 5
#: Expected grade from which a document is rejected.
REJECT = 0.4
CACHE = 300_000


def features_of(chunk: str) -> list[str]:
    """The features of a run of text without white space."""
    out = []
    for w in WORD.findall(chunk.lower()):
        out.append(w)
        out += [f"{w[:n]}*" for n in (4, 5, 6) if len(w) >= n]
    return out


@dataclass
class OrdinalModel:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, eta: np.ndarray) -> np.ndarray:
        """(rows, thresholds): P(grade > k)."""
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds[None, :], -50, 50)))


class _Active(dict):
    """Chunk -> the model features in it (None for most), remembered."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, chunk: str):
        if len(self) >= CACHE:
            self.clear()
        got = self[chunk] = tuple(i for f in features_of(chunk) if (i := self.index.get(f)) is not None) or None
        return got


def _count(labelled: DataFrame) -> DataFrame:
    """(feature, clean, toxic): documents of each kind that hold the feature."""

    def run(batches):
        for b in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(b.column(0), b.column(1).to_pylist()):
                for f in {f for c in set((text.as_py() or "").split()) for f in features_of(c)}:
                    seen.setdefault(f, [0, 0])[y > 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], ["feature", "clean", "toxic"])

    return labelled.select("text", "y").mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _encode(labelled: DataFrame, index: dict[str, int]) -> DataFrame:
    """(y, words, on): the grade, the number of words, the features present."""

    def run(batches):
        active = _Active(index)
        for b in batches:
            n, on = [], []
            for text in b.column(0):
                chunks = (text.as_py() or "").split()
                n.append(len(chunks))
                on.append(sorted({i for c in set(chunks) for i in active[c] or ()}))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n, pa.int64()), pa.array(on, pa.list_(pa.int32()))], ["y", "words", "on"])

    return labelled.select("text", "y").mapInArrow(run, "y long, words long, on array<int>")


def _descend(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_features: int, grades: int, steps: int = 600, l2: float = 8e-5):
    """Full-batch gradient descent with momentum and adaptive steps; thresholds are a base and positive gaps."""
    n, k = len(y), grades - 1
    over = (y[:, None] > np.arange(k)[None, :]).astype(float)
    w = np.zeros(n_features)
    share = np.clip(over.mean(0), 1e-4, 1 - 1e-4)
    t = np.maximum.accumulate(-np.log(share / (1 - share)))
    p = np.concatenate([[t[0]], np.log(np.maximum(np.diff(t), 0.05))])
    m = [np.zeros_like(w), np.zeros_like(p)]
    v = [np.zeros_like(w), np.zeros_like(p)]
    theta = t
    for step in range(1, steps + 1):
        theta = p[0] + np.concatenate([[0], np.cumsum(np.exp(p[1:]))])
        eta = np.bincount(rows, w[cols], n)
        # log-likelihood of the grade: log(P(y > g-1) - P(y > g)), with P(y > -1) = 1 and P(y > last) = 0
        s = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta[None, :], -30, 30)))
        edge = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], 1)
        slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], 1)
        at = np.arange(n)
        like = np.maximum(edge[at, y] - edge[at, y + 1], 1e-9)
        g_eta = (slope[at, y] - slope[at, y + 1]) / like / n
        g_theta = np.zeros(k + 2)
        np.add.at(g_theta, y, -slope[at, y] / like / n)
        np.add.at(g_theta, y + 1, slope[at, y + 1] / like / n)
        g_theta = g_theta[1:-1]
        back = np.cumsum(g_theta[::-1])[::-1]
        grads = [-np.bincount(cols, g_eta[rows], n_features) + l2 * w, -np.concatenate([[back[0]], back[1:] * np.exp(p[1:])])]
        for i, (x, g) in enumerate(zip((w, p), grads)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x -= 0.05 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w, theta


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, grades: int = 4) -> OrdinalModel:
    """Trains on at most `sample` labelled documents, those whose id hashes lowest; the driver gets their active features only.

    label 0 is clean and more is toxic; a label of two values is graded by density (see above), one of more is taken as
    the grade. Null ids and labels are left out. Without labelled rows, or with one kind only, the model knows no
    feature and gives every document an expected grade of 0.
    """
    picked = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("long").alias("y")).where("_id is not null and y >= 0")
    picked = picked.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(picked), "_id")
    # one row for an id, the least text, so that no more than `sample` rows are looked at; they are read several times
    rows = materialize(rows.groupBy("_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("y") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return OrdinalModel({}, np.zeros(0), np.full(grades - 1, np.inf))
    a, b = float(sizes[0]), float(sizes[1])
    odds = F.log((F.col("toxic") + 0.5) / (b + 1 - F.col("toxic"))) - F.log((F.col("clean") + 0.5) / (a + 1 - F.col("clean")))
    # the log-odds over its standard error: strong and well-supported features first, for either kind
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = _count(rows).where(F.col("toxic") + F.col("clean") >= SUPPORT).select("feature", odds.alias("odds"), (odds / error).alias("z"))
    best = best.where(f"abs(z) >= {CLEAR}").orderBy(F.abs("z").desc(), "feature").limit(features).collect()
    index = {r["feature"]: i for i, r in enumerate(best)}
    strong = np.array([r["odds"] >= 2 for r in best], bool)
    t = _encode(rows, index).toArrow()
    on = [np.asarray(x or [], np.int64) for x in t["on"].to_pylist()]
    y, words = t["y"].to_numpy().copy(), np.maximum(t["words"].to_numpy(), 1)
    if y.max() <= 1:
        dense = np.array([strong[x].sum() for x in on]) / words
        some = (y == 1) & (dense > 0)
        cuts = np.quantile(dense[some], np.arange(1, grades - 1) / (grades - 1)) if some.any() else np.zeros(grades - 2)
        y[some] = 1 + np.searchsorted(cuts, dense[some], side="right")
    else:
        grades = int(y.max()) + 1
    # one order of the rows whatever way Spark returned them, so that sums agree
    order = sorted(range(len(y)), key=lambda i: (int(y[i]), int(words[i]), on[i].tolist()))
    y, on = y[order], [on[i] for i in order]
    r = np.repeat(np.arange(len(y)), [len(x) for x in on])
    w, theta = _descend(r, np.concatenate(on) if len(r) else np.zeros(0, np.int64), y, len(index), grades)
    return OrdinalModel(index, w, theta)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", out: str = "severity") -> DataFrame:
    """docs with a column more, the expected grade of the whole text. Null, empty and wordless texts get 0.

    An existing column of the name `out` is replaced; all others, clashing or not with names used inside, stay.
    """
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(model)
    names = [c for c in docs.columns if c != out]
    schema = docs.select(*(F.col(f"`{c}`") for c in names)).withColumn(out, F.lit(0.0)).schema

    def run(batches):
        active = _Active(sent.value.features)
        for b in batches:
            eta, empty = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            for i, t in enumerate(b.column(names.index(text))):
                chunks = (t.as_py() or "").split()
                on = {f for got in map(active.__getitem__, chunks) if got for f in got}
                empty[i] = not chunks or not on and not WORD.search(" ".join(chunks[:10_000])) and not any(map(WORD.search, chunks))
                eta[i] = sum(sent.value.weights[f] for f in sorted(on))
            got = np.where(empty, 0.0, np.round(sent.value.above(eta).sum(1), 9))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], [*names, out])

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def reject(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", at: float = REJECT) -> DataFrame:
    """The documents whose expected grade stays below `at`, with their columns as they were."""
    (severity,) = fresh(docs.columns, "severity")
    kept = score(docs, fit(docs, labels, doc_id, text), text, severity)
    return kept.where(F.col(severity) < at).select(*(F.col(f"`{c}`") for c in docs.columns))
