"""Linear probes of frozen vectors by cross-validation, the same folds for every set of vectors, all fitted by one optimiser.

A pass over the rows gives the losses and gradients of all folds and sets of vectors at once: a row counts for every fold but its own. The
optimiser (L-BFGS) sees nothing but these sums, so what it costs the driver does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aperture.functions import vectors as V
from aperture.operators import ranges as R
from aperture.operators.resample import digest
from aperture.sources.shared import Scratch


def folds(df: DataFrame, label: str, folds: int = 5, group: str | None = None, id_col: str = "id", seed: str = "0") -> tuple[DataFrame, int, str]:
    """(`df` with fold, how many folds, kind): stratified folds, whole groups together where some group has several rows.

    Groups are dealt in turn by their commonest label (the smallest of equals), in the order of digests: at most `folds`, and no more than
    there are groups (or rows of the rarest class; under two there are no folds, and the result is empty).
    """
    rows = df.count()
    n = df.agg(F.count_distinct(group).alias("n")).first().n if group else rows
    if group and n < rows:
        k, kind, unit = min(folds, n), "stratified_group", group
    else:
        rarest = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("n")).first().n or 0
        k, kind, unit = min(folds, rarest), "stratified", id_col
    if k < 2:
        return df.withColumn("fold", F.lit(0)).limit(0), 0, "none"
    u = df.groupBy(F.col(unit).alias("__u"), F.col(label).alias("__y")).agg(F.count("*").alias("__n"))
    u = u.groupBy("__u").agg(F.min_by("__y", F.struct(-F.col("__n"), "__y")).alias("__y")).withColumn("__d", digest(F.concat(F.lit(seed), F.col("__u").cast("string"))))
    u = R.numbered(u, ["__y"], ["__d", "__u"], "__at")
    u = u.select("__u", F.pmod(F.col("__at") + F.pmod(digest(F.concat(F.lit("y"), F.col("__y").cast("string"))), F.lit(k)), F.lit(k)).cast("int").alias("fold"))
    return df.join(u, F.col(unit) == F.col("__u")).drop("__u"), k, kind


#: Sums of losses in another order may differ by this share of them.
NOISE = 1e-11


class _Descent:
    """L-BFGS for one problem: asks for the loss and gradient at `at`, step by step, till the gradient is under `tolerance`.

    Near its end a step gains less than the rounding of a sum over many rows. There the gradient, which is still exact, tells whether
    a step is too far: it is not if the loss is level but for rounding and its slope does not rise by over 0.8 of what it fell by before
    (the approximate Wolfe condition of Hager and Zhang, 2005).
    """

    def __init__(self, size: int, tolerance: float, memory: int = 10):
        self.x = self.at = np.zeros(size)
        self.tolerance, self.memory, self.pairs, self.loss, self.done = tolerance, memory, [], None, False

    def take(self, loss: float, gradient: np.ndarray) -> None:
        if self.loss is not None:
            level = loss <= self.loss + NOISE * abs(self.loss) and gradient @ self.way <= -0.8 * self.slope
            if loss > self.loss + 1e-4 * self.step * self.slope and not level and self.step > 1e-12:
                self.step /= 2  # too far
                self.at = self.x + self.step * self.way
                return
            s, y = self.at - self.x, gradient - self.gradient
            if s @ y > 1e-12:
                self.pairs = [*self.pairs[1 - self.memory :], (s, y, 1 / (s @ y))]
        self.x, self.loss, self.gradient = self.at, loss, gradient
        self.done = bool(np.linalg.norm(gradient) <= self.tolerance)
        self.way = -self._inverse(gradient)
        self.slope = gradient @ self.way
        self.step = 1.0 if self.pairs else 1 / max(1.0, np.linalg.norm(gradient))
        self.at = self.x + self.step * self.way

    def _inverse(self, g: np.ndarray) -> np.ndarray:
        q, kept = g.copy(), []
        for s, y, r in reversed(self.pairs):
            a = r * (s @ q)
            q -= a * y
            kept.append(a)
        if self.pairs:
            s, y, r = self.pairs[-1]
            q /= r * (y @ y)
        for (s, y, r), a in zip(self.pairs, reversed(kept), strict=True):
            q += s * (a - r * (y @ q))
        return q


def _matrix(column: pa.Array) -> np.ndarray:
    ends = np.asarray(column.offsets)
    return np.asarray(column.values)[ends[0] : ends[-1]].reshape(len(column), -1)


def _sums(weights: list[np.ndarray], k: int, classes: int):
    """A function of batches (fold, y, vectors ...): for all sets and folds the loss and the gradient of the rows of other folds, as one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in filter(len, batches):
            fold, y = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            counts = (fold[:, None] != np.arange(k)).astype(float)
            own = np.eye(classes)[y]
            out = []
            for i, w in enumerate(weights):
                x = _matrix(batch.column(2 + i))
                x = np.concatenate([x, np.ones((len(x), 1))], 1)
                z = (x @ w.reshape(k * classes, -1).T).reshape(len(x), k, classes)
                z -= z.max(2, keepdims=True)
                norm = np.log(np.exp(z).sum(2))
                loss = ((norm - (z * own[:, None, :]).sum(2)) * counts).sum(0)
                d = (np.exp(z - norm[:, :, None]) - own[:, None, :]) * counts[:, :, None]
                grad = (d.reshape(len(x), k * classes).T @ x).reshape(k, -1)
                out.append(np.concatenate([loss[:, None], grad], 1).ravel())
            found = np.concatenate(out)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])

    return run


def fit(table: DataFrame, k: int, classes: int, sizes: list[int], c: float = 1.0, rounds: int = 300, tolerance: float = 1e-4) -> list[np.ndarray]:
    """For each set of vectors an array (folds, classes, size + 1) of weights, the last being intercepts: logistic regressions (L2 of strength 1/c, intercepts free).

    `table` has fold, y (0 ... classes - 1) and the unit vectors of each set, and is read once a round. ValueError if a fit has not come to a rest.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    length = [classes * (n + 1) for n in sizes]
    descents = [[_Descent(m, tolerance) for _ in range(k)] for m in length]
    for _ in range(rounds):
        at = [np.stack([d.at for d in own]) for own in descents]
        sums = table.mapInArrow(_sums(at, k, classes), "s array<double>").agg(Summarizer.sum(array_to_vector("s")).alias("s")).first().s.toArray()
        place = 0
        for own, m, w in zip(descents, length, at, strict=True):
            part = sums[place : place + k * (m + 1)].reshape(k, m + 1)
            place += k * (m + 1)
            for d, s, x in zip(own, part, w, strict=True):
                if not d.done:
                    inner = x.reshape(classes, -1).copy()
                    inner[:, -1] = 0  # intercepts are free
                    d.take(s[0] + (inner**2).sum() / (2 * c), s[1:] + inner.ravel() / c)
        if all(d.done for own in descents for d in own):
            return [np.stack([d.x for d in own]).reshape(k, classes, -1) for own in descents]
    raise ValueError(f"no rest after {rounds} rounds")


def probe(df: DataFrame, k: int, label: str, vectors: list[str], c: float = 1.0, rounds: int = 300) -> DataFrame:
    """(fold, vectors, balanced_accuracy): for each of k folds a logistic regression on the unit vectors of the other folds, and the mean recall over the classes that the fold has."""
    spark = df.sparkSession
    if k < 2:
        return spark.createDataFrame([], "fold int, vectors string, balanced_accuracy double")
    known = sorted(r[0] for r in df.select(label).distinct().collect())  # classes, a bounded dimension
    y = F.array_position(F.array(*map(F.lit, known)), F.col(label)).cast("int") - 1
    table = Scratch(spark, "probe").table(df.select(F.col("fold").cast("int").alias("fold"), y.alias("y"), *[V.unit(F.col(v)).alias(f"x{i}") for i, v in enumerate(vectors)]), "rows")
    sizes = list(table.select(*[F.size(f"x{i}") for i in range(len(vectors))]).first())
    weights = fit(table, k, len(known), sizes, c, rounds)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            fold, preds = np.asarray(batch.column(0)), []
            for i, w in enumerate(weights):
                x = _matrix(batch.column(2 + i))
                x = np.concatenate([x, np.ones((len(x), 1))], 1)
                preds.append(pa.array(np.einsum("nd,ncd->nc", x, w[fold]).argmax(1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *preds], ["fold", "y", *(f"p{i}" for i in range(len(vectors)))])

    got = table.mapInArrow(predicted, "fold int, y int, " + ", ".join(f"p{i} int" for i in range(len(vectors))))
    each = F.inline(F.array(*[F.struct(F.lit(v).alias("vectors"), (F.col(f"p{i}") == F.col("y")).cast("int").alias("hit")) for i, v in enumerate(vectors)]))
    recall = got.select("fold", "y", each).groupBy("fold", "vectors", "y").agg(F.avg("hit").alias("r"))
    return recall.groupBy("fold", "vectors").agg(F.avg("r").alias("balanced_accuracy"))


def paired_probe(df: DataFrame, label: str, a: str, b: str, n: int = 5, group: str | None = None, id_col: str = "id") -> DataFrame:
    """(fold, a, b, delta, cv): both sets of vectors on the same folds."""
    dealt, k, kind = folds(df, label, n, group, id_col)
    t = probe(dealt, k, label, [a, b]).groupBy("fold").agg(*[F.max(F.when(F.col("vectors") == v, F.col("balanced_accuracy"))).alias(n_) for v, n_ in ((a, "a"), (b, "b"))])
    return t.select("fold", "a", "b", (F.col("a") - F.col("b")).alias("delta"), F.lit(kind).alias("cv"))
