"""Which properties explain an axis: LASSO with out-of-fold R2, and random-forest importances."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.correlation import ranks
from lumenframe.operators.predicates import finite_or_null
from lumenframe.runtime import materialize


def _prepared(df: DataFrame, props: list[str], target: str, key: str, folds: int, stratify: str | None = None) -> DataFrame:
    """Complete rows with a fold by the hash of their key. With ``stratify`` the rows of each label take the folds in turn, in
    hash order; a missing label is one too. Where a label has fewer rows than folds, labels are not used (with a warning)."""
    label = [] if stratify is None else [F.coalesce(F.col(stratify).cast("string"), F.lit("__missing__")).alias("_label")]
    d = df.select(key, *[finite_or_null(F.col(p)).alias(p) for p in props], finite_or_null(F.col(target)).alias("_y"), *label).na.drop()
    plain = d.drop("_label").withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))
    if stratify is None:
        return plain
    least = d.groupBy("_label").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    if least is None or least < folds:
        warnings.warn(f"a label of {stratify} has fewer rows than there are folds; folds don't follow it", stacklevel=3)
        return plain
    d = materialize(d.withColumn("_h", F.xxhash64(key)), "labelled")
    r = ranks(d, ["_label"], "_h").withColumnsRenamed({"_label": "_l", "_h": "_g"})
    return d.join(r, (F.col("_label") == F.col("_l")) & (F.col("_h") == F.col("_g"))).withColumn("fold", F.pmod(F.floor("rank"), F.lit(folds)).cast("int")).drop("_label", "_l", "_h", "_g", "rank")


def _folds(d: DataFrame, props: list[str]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per fold: rows, sums and cross products of (properties, y). All the model needs, from one aggregation."""
    cols = [*props, "_y"]
    k = len(cols)
    aggs = [F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)], *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]]
    out = {}
    for r in d.groupBy("fold").agg(*aggs).collect():
        x = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                x[i, j] = x[j, i] = r[f"p{i}_{j}"]
        out[r["fold"]] = (r["n"], np.array([r[f"s{i}"] for i in range(k)]), x)
    return out


def _lasso(g: np.ndarray, c: np.ndarray, alpha: float, w: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Coordinate descent on the correlation matrix."""
    w = w.copy()
    for _ in range(rounds):
        old = w.copy()
        for j in range(len(w)):
            r = c[j] - g[j] @ w + g[j, j] * w[j]
            w[j] = np.sign(r) * max(abs(r) - alpha, 0) / max(g[j, j], 1e-12)
        if np.abs(w - old).max(initial=0) < 1e-8:
            break
    return w


def _standard(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, s, x = sum(p[0] for p in parts), sum(p[1] for p in parts), sum(p[2] for p in parts)
    mean = s / n
    cov = x / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd < 1e-12, 1, sd)
    return mean, sd, cov / np.outer(sd, sd)


def _r2(part: tuple, mean: np.ndarray, sd: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Residual and total sum of squares of a fold under standardised weights."""
    n, s, x = part
    b = w / sd[:-1] * sd[-1]
    v = np.append(-b, 1.0)
    c = mean[-1] - b @ mean[:-1]
    res = v @ x @ v - 2 * c * (v @ s) + n * c * c
    return float(res), float(x[-1, -1] - 2 * mean[-1] * s[-1] + n * mean[-1] ** 2)


def lasso_axis(df: DataFrame, props: list[str], target: str, key: str = "image_index", folds: int = 5, alphas: int = 40, stratify: str | None = None) -> tuple[DataFrame, float | None]:
    """(``(feature, weight)`` of non-zero weights by size, out-of-fold R2 or None).

    The path of penalties is chosen by the mean out-of-fold error. One pass gathers each fold's cross products; the model
    is solved on those, so rows are never collected. Folds may follow a label (``stratify``). No features where there are
    fewer rows than the folds of folds need: max(folds + 1, folds (folds + 1) / (folds - 1)).
    """
    f = _folds(_prepared(df, props, target, key, folds, stratify), props)
    spark = df.sparkSession
    if len(f) < 2 or sum(p[0] for p in f.values()) < max(folds + 1, -(-folds * (folds + 1) // max(folds - 1, 1))):
        return spark.createDataFrame([], "feature string, weight double"), None
    _, _, g = _standard(list(f.values()))
    top = max(np.abs(g[:-1, -1]).max(), 1e-9)
    path = top * np.logspace(0, -3, alphas)
    err, tot = np.zeros(alphas), 0.0
    for k, held in f.items():
        mean, sd, gk = _standard([p for q, p in f.items() if q != k])
        w = np.zeros(len(props))
        for i, a in enumerate(path):
            w = _lasso(gk[:-1, :-1], gk[:-1, -1], a, w)
            r, t = _r2(held, mean, sd, w)
            err[i] += r
        tot += t
    best = int(err.argmin())
    w = np.zeros(len(props))
    for a in path[: best + 1]:
        w = _lasso(g[:-1, :-1], g[:-1, -1], a, w)
    rows = sorted(((p, float(x)) for p, x in zip(props, w) if x), key=lambda t: (-abs(t[1]), t[0]))
    return spark.createDataFrame(rows, "feature string, weight double"), float(1 - err[best] / tot) if tot else None


def forest_axis(df: DataFrame, props: list[str], target: str, key: str = "image_index", trees: int = 100, seed: int = 42) -> tuple[DataFrame, float | None]:
    """(``(feature, weight)`` of positive importances, held-out R2). Spark's forest has no out-of-bag score; a fifth of the
    rows, chosen by hash, is held out for R2."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    d = VectorAssembler(inputCols=props, outputCol="features").transform(_prepared(df, props, target, key, 5)).withColumnRenamed("_y", "label")
    m = RandomForestRegressor(numTrees=trees, seed=seed, maxDepth=8).fit(d.where("fold > 0"))
    r2 = RegressionEvaluator(metricName="r2").evaluate(m.transform(d.where("fold = 0")))
    rows = sorted(((p, float(x)) for p, x in zip(props, m.featureImportances.toArray()) if x > 0), key=lambda t: (-t[1], t[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, weight double"), float(r2)
