"""Dimensionality reduction. PCA is distributed; t-SNE and UMAP map a sample of stated size and place all other rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.runtime import materialize

SAMPLE = 5_000  # most rows t-SNE and UMAP map
PLACE = 5  # mapped rows that place another one


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same every time: the smallest hashes of the key (a top-k, no full sort)."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def moments(df: DataFrame, vec: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and scatter matrix; one dim x dim matrix per partition is added in a tree-sized second step."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, m, s = 0, np.zeros(dim), np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["_v"].to_numpy()).astype(float)
                k, mx = len(x), x.mean(0)
                d = mx - m
                s += (x - mx).T @ (x - mx) + np.outer(d, d) * (n * k / (n + k))
                m, n = m + d * (k / (n + k)), n + k
        if n:
            yield pd.DataFrame({"g": [0], "n": [n], "m": [m], "s": [s.ravel()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n, m, s = 0, np.zeros(dim), np.zeros((dim, dim))
        for r in pdf.itertuples(index=False):
            mx, d = np.asarray(r.m), np.asarray(r.m) - m
            s += np.asarray(r.s).reshape(dim, dim) + np.outer(d, d) * (n * r.n / (n + r.n))
            m, n = m + d * (r.n / (n + r.n)), n + r.n
        return pd.DataFrame({"g": [0], "n": [n], "m": [m], "s": [s.ravel()]})

    schema = "g int, n bigint, m array<double>, s array<double>"
    parts = df.where(F.col(vec).isNotNull()).select(F.transform(vec, lambda x: x.cast("double")).alias("_v")).mapInPandas(partial, schema)
    tree = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("g").applyInPandas(merge, schema)
    out = merge(tree.toPandas())  # at most 32 matrices
    return int(out["n"][0]), np.asarray(out["m"][0]), np.asarray(out["s"][0]).reshape(dim, dim)


class PCAModel:
    """Centred principal components; the loading of largest size is positive in each."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, ratio: np.ndarray):
        self.mean, self.axes, self.ratio = mean, axes, ratio

    def transform(self, df: DataFrame, key: str, vec: str) -> DataFrame:
        """``(key, component_1..k)``."""
        k, mean, axes = len(self.axes), self.mean, self.axes
        kind = df.schema[key].dataType.simpleString()
        names = [f"component_{i + 1}" for i in range(k)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = np.stack(pdf["_v"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, len(mean)))
                yield pd.concat([pdf[[key]].reset_index(drop=True), pd.DataFrame((x - mean) @ axes.T, columns=names)], axis=1)

        return df.where(F.col(vec).isNotNull()).select(key, F.transform(vec, lambda x: x.cast("double")).alias("_v")).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))


def pca(df: DataFrame, vec: str, dim: int, k: int = 2) -> PCAModel:
    n, mean, s = moments(df, vec, dim)
    w, q = np.linalg.eigh(s / max(n - 1, 1))
    order = np.argsort(-w)[: min(k, dim, max(n - 1, 1))]
    axes = q[:, order].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return PCAModel(mean, axes, w[order] / max(w.sum(), 1e-300))


def _pairwise(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(1)
    return np.maximum(s[:, None] + s - 2 * x @ x.T, 0)


def tsne(x: np.ndarray, k: int = 2, perplexity: float = 30.0, rounds: int = 300, seed: int = 42) -> np.ndarray:
    """Exact t-SNE; the perplexity must be under the number of rows."""
    n = len(x)
    if perplexity >= n:
        raise ValueError(f"perplexity {perplexity} must be less than the number of samples {n}")
    d, p, target = _pairwise(x), np.zeros((n, n)), np.log(perplexity)
    for i in range(n):
        lo, hi, beta, row = 0.0, np.inf, 1.0, np.delete(d[i], i)
        row = row - row.min()
        for _ in range(50):
            e = np.exp(-row * beta)
            h = np.log(e.sum()) + beta * (row * e).sum() / e.sum()
            if abs(h - target) < 1e-5:
                break
            lo, hi = (beta, hi) if h > target else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = e / e.sum()
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, k))
    v, gain = np.zeros_like(y), np.ones_like(y)
    for t in range(rounds):
        # by blocks of rows, which stay in the cache: attraction, repulsion and the sum of q in one pass
        g, away, z, yy = np.empty_like(y), np.empty_like(y), 0.0, (y * y).sum(1)
        for i in range(0, n, 64):
            own = y[i : i + 64]
            q = yy[i : i + 64, None] + yy
            q -= 2 * own @ y.T
            np.maximum(q, 0, out=q)
            q += 1
            np.reciprocal(q, out=q)
            q[np.arange(len(own)), np.arange(i, i + len(own))] = 0
            z += q.sum()
            w = p[i : i + 64] * q
            g[i : i + 64] = w.sum(1)[:, None] * own - w @ y
            q *= q
            away[i : i + 64] = q.sum(1)[:, None] * own - q @ y
        g = 4 * ((12 if t < 100 else 1) * g - away / z)
        gain = np.where(np.sign(g) != np.sign(v), gain + 0.2, np.maximum(gain * 0.8, 0.01))
        v = (0.5 if t < 100 else 0.8) * v - max(n / 12 / 4, 50) * gain * g
        y = y + v
        y -= y.mean(0)
    return y


def umap(x: np.ndarray, k: int = 2, neighbours: int = 15, min_dist: float = 0.1, rounds: int = 200, seed: int = 42) -> np.ndarray:
    """UMAP: fuzzy nearest-neighbour graph, then attraction along it and repulsion from random rows."""
    n = len(x)
    m = min(neighbours, n - 1)
    if m < 1:
        return np.zeros((n, k))
    d = np.sqrt(_pairwise(x))
    np.fill_diagonal(d, np.inf)
    near = np.argpartition(d, m - 1, axis=1)[:, :m]
    dist = np.take_along_axis(d, near, 1)
    rho, sigma = dist.min(1), np.ones(n)
    for i in range(n):
        lo, hi = 1e-6, 1e4
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.exp(-np.maximum(dist[i] - rho[i], 0) / mid).sum() < np.log2(m + 1e-9) else (lo, mid)
        sigma[i] = mid
    w = np.zeros((n, n))
    w[np.arange(n)[:, None], near] = np.exp(-np.maximum(dist - rho[:, None], 0) / sigma[:, None])
    w = w + w.T - w * w.T
    grid = np.linspace(0, 3, 200)
    want = np.where(grid <= min_dist, 1.0, np.exp(-(grid - min_dist)))
    a, b = min(((a, b) for a in np.linspace(0.5, 3, 26) for b in np.linspace(0.5, 1.5, 21)), key=lambda t: ((1 / (1 + t[0] * grid ** (2 * t[1])) - want) ** 2).sum())
    rng = np.random.default_rng(seed)
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    y = np.zeros((n, k))
    y[:, : min(k, len(s))] = (u * s)[:, :k]
    y = 10 * y / max(np.abs(y).max(), 1e-9) + rng.normal(0, 1e-3, (n, k))
    i, j = np.nonzero(np.triu(w))
    p = w[i, j]
    for t in range(rounds):
        step = 1 - t / rounds
        on = rng.random(len(p)) < p
        e, f = i[on], j[on]
        diff = y[e] - y[f]
        d2 = (diff**2).sum(1)
        g = np.clip((-2 * a * b * d2 ** np.maximum(b - 1, 0) / (1 + a * d2**b))[:, None] * diff, -4, 4)
        np.add.at(y, e, step * g)
        np.add.at(y, f, -step * g)
        for _ in range(3):
            o = rng.integers(0, n, len(e))
            diff = y[e] - y[o]
            d2 = (diff**2).sum(1)
            np.add.at(y, e, step * np.clip((2 * b / ((0.001 + d2) * (1 + a * d2**b)))[:, None] * diff, -4, 4) * (e != o)[:, None])
    return y


def reduce_dimensions(df: DataFrame, key: str, vec: str, dim: int, method: str = "pca", k: int = 2, sample: int | None = None, seed: int = 42, **options) -> DataFrame:
    """``(key, component_1..k)``. ``sample`` bounds the rows; PCA takes all without it. t-SNE and UMAP map at most SAMPLE rows
    chosen by hash (the methods are for maps of a few thousand points), in one task of numpy. Without ``sample`` every other
    row is placed at the mean of its PLACE nearest mapped rows, weighted by 1 / distance, so each row has coordinates. A larger
    ``sample`` is an error."""
    if method == "pca":
        d = hash_sample(df, key, sample, seed) if sample else df
        return pca(d, vec, dim, k).transform(d, key, vec)
    if method not in ("tsne", "umap"):
        raise ValueError(f"unknown method {method!r}")
    if sample and sample > SAMPLE:
        raise ValueError(f"{method} maps at most {SAMPLE} rows; without sample the others are placed by these")
    d = hash_sample(df.where(F.col(vec).isNotNull()).select(key, vec), key, sample or SAMPLE, seed)
    names = [f"component_{i + 1}" for i in range(k)]
    kind = df.schema[key].dataType.simpleString()
    f = {"tsne": tsne, "umap": umap}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        y = f(np.stack(pdf[vec].to_numpy()).astype(float), k, seed=seed, **options)
        return pd.concat([pdf[[key, vec]].reset_index(drop=True), pd.DataFrame(y, columns=names)], axis=1)

    schema = f"{key} {kind}, " + ", ".join(f"{n} double" for n in names)
    near = d.groupBy(F.lit(0).alias("_g")).applyInPandas(lambda p: run(p.drop(columns=["_g"], errors="ignore")), f"{key} {kind}, {vec} {df.schema[vec].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))
    if sample:
        return near.drop(vec)
    near = materialize(near, "map")
    fit = near.toPandas()
    if len(fit) < SAMPLE:
        return near.drop(vec)
    b = df.sparkSession.sparkContext.broadcast((set(fit[key].tolist()), np.stack(fit[vec].to_numpy()).astype(float), fit[names].to_numpy()))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, x, y = b.value
        xx = (x * x).sum(1)
        for pdf in batches:
            pdf = pdf[~pdf[key].isin(known)].reset_index(drop=True)
            for lo in range(0, len(pdf), 1024):
                part = pdf.iloc[lo : lo + 1024].reset_index(drop=True)
                v = np.stack(part[vec].to_numpy()).astype(float)
                far = np.sqrt(np.maximum((v * v).sum(1)[:, None] + xx - 2 * v @ x.T, 0))
                at = np.argpartition(far, PLACE - 1, axis=1)[:, :PLACE]
                w = 1 / np.maximum(np.take_along_axis(far, at, 1), 1e-9)
                yield pd.concat([part[[key]], pd.DataFrame((w[:, :, None] * y[at]).sum(1) / w.sum(1, keepdims=True), columns=names)], axis=1)

    rest = df.where(F.col(vec).isNotNull()).select(key, vec).mapInPandas(place, schema)
    return near.drop(vec).unionByName(rest)


def group_centroids(components: DataFrame, comps: list[str], group_by: list[str]) -> DataFrame:
    """Mean of each component and ``n_samples`` per group; null groups are kept."""
    return components.groupBy(*group_by).agg(*[F.avg(c).alias(c) for c in comps], F.count("*").alias("n_samples"))
