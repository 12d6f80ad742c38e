"""Correlations between embedding dimensions or components and properties."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions.special import digamma
from lumenframe.operators.predicates import finite_or_null
from lumenframe.operators.stats import long_properties
from lumenframe.runtime import materialize, partitions


def pearson(x: Column, y: Column, least: int = 3) -> Column:
    """Aggregate: Pearson's r over pairs finite on both sides; null under ``least`` pairs or for a constant side."""
    both = finite_or_null(x).isNotNull() & finite_or_null(y).isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    cov, sa, sb = F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)
    r = F.try_divide(cov, sa * sb)
    return F.when((F.count(a) >= least) & (sa > 1e-12) & (sb > 1e-12), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def embedding_property_correlations(images: DataFrame, vec: str, props: list[str], dim: int, method: str = "pearson", normalize: bool = False) -> DataFrame:
    """``(property, dim, r)``.

    pearson: per partition, cross products of the vectors and the properties are summed as matrices (numpy), and only
    those sums are shuffled: dims x properties numbers a partition. Other methods need whole columns and go by group.
    """
    from lumenframe.functions.vectors import l2_normalize

    v = l2_normalize(F.col(vec)) if normalize else F.transform(vec, lambda x: x.cast("double"))
    d = images.select(v.alias("_v"), *[finite_or_null(F.col(p)).alias(p) for p in props])
    if method != "pearson":
        x = d.select(F.posexplode("_v").alias("dim", "x"), *props)
        long = x.select("dim", "x", F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).alias("y")) for p in props])).alias("_p")).select("_p.property", "dim", "x", "_p.y")
        return correlate_groups(long.where("x IS NOT NULL AND y IS NOT NULL"), ["property", "dim"], method)

    # centred by one vector from the data, for stability
    first = d.limit(1).toPandas()
    c = np.asarray(first["_v"].iloc[0], float) if len(first) else np.zeros(dim)
    means = images.agg(*[F.avg(finite_or_null(F.col(p))).alias(p) for p in props]).first()
    mu = np.array([means[p] or 0.0 for p in props])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(props)
        s = {n: np.zeros((k, dim)) for n in ("n", "x", "xx", "xy")} | {n: np.zeros((k, 1)) for n in ("y", "yy")}
        for pdf in batches:
            x = np.stack(pdf["_v"].to_numpy()) - c if len(pdf) else np.zeros((0, dim))
            y = pdf[props].to_numpy(float) - mu
            on = np.isfinite(y).astype(float)
            y = np.where(on > 0, y, 0.0)
            s["n"] += on.sum(0)[:, None]
            s["x"] += on.T @ x
            s["xx"] += on.T @ (x * x)
            s["xy"] += y.T @ x
            s["y"] += y.sum(0)[:, None]
            s["yy"] += (y * y).sum(0)[:, None]
        yield pd.DataFrame({"property": np.repeat(props, dim), "dim": np.tile(np.arange(dim), k), **{n: np.broadcast_to(a, (k, dim)).ravel() for n, a in s.items()}})

    t = d.mapInPandas(sums, "property string, dim int, n double, x double, xx double, xy double, y double, yy double").groupBy("property", "dim").agg(*[F.sum(n).alias(n) for n in ("n", "x", "xx", "xy", "y", "yy")])
    vx, vy = F.col("xx") - F.col("x") ** 2 / F.col("n"), F.col("yy") - F.col("y") ** 2 / F.col("n")
    r = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))
    return t.where("n > 0").select("property", "dim", F.when((F.col("n") >= 3) & (vx > 1e-12) & (vy > 1e-12), r).alias("r"))


def correlation_summary(corr: DataFrame) -> DataFrame:
    """Over dimensions, per property: mean and population std of r; mean, max and min of its absolute value."""
    ok = corr.where("r IS NOT NULL")
    return ok.groupBy("property").agg(F.avg("r").alias("mean_r"), F.stddev_pop("r").alias("std_r"), F.avg(F.abs("r")).alias("mean_abs_r"), F.max(F.abs("r")).alias("max_abs_r"), F.min(F.abs("r")).alias("min_abs_r"))


def ranks(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """``(*by, col, rank)``: the 1-based rank of each distinct value within its group, ties sharing their mean rank.

    Values are counted, range-partitioned by group and value, and numbered within their range; the counts of the ranges
    before, one number a range and group, are added. No task sorts a whole column or group. Nulls have no rank.
    """
    c = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_c"))
    r = materialize(c.repartitionByRange(partitions(df.sparkSession), *by, col).withColumn("_p", F.spark_partition_id()), "ranks")
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = r.groupBy("_p", *by).agg(F.sum("_c").alias("_n")).select("_p", *[F.col(b).alias(f"_b_{b}") for b in by], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    run = F.sum("_c").over(Window.partitionBy("_p", *by).orderBy(col).rowsBetween(Window.unboundedPreceding, 0))
    on = F.col("a._p") == F.col("b._p")
    for b in by:
        on = on & F.col(f"a.{b}").eqNullSafe(F.col(f"b._b_{b}"))
    j = r.withColumn("_run", run).alias("a").join(F.broadcast(base).alias("b") if not by else base.alias("b"), on)
    return j.select(*[F.col(f"a.{b}").alias(b) for b in by], F.col(f"a.{col}").alias(col), (F.col("_base") + F.col("_run") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Spearman's rho of finite pairs per group; ranks are looked up by value, so hot values are joined like any other."""
    by = by or []
    d = df.select(*by, finite_or_null(F.col(x)).alias("x"), finite_or_null(F.col(y)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    for c in "xy":
        r = ranks(d, by, c).select(*[F.col(b).alias(f"_{b}") for b in by], F.col(c).alias("_v"), F.col("rank").alias(f"r{c}"))
        on = F.col(c) == F.col("_v")
        for b in by:
            on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
        d = d.join(r, on).drop("_v", *[f"_{b}" for b in by])
    agg = [F.count("*").alias("n"), pearson(F.col("rx"), F.col("ry")).alias("rho")]
    return d.groupBy(*by).agg(*agg) if by else d.agg(*agg)


def component_correlation(components: DataFrame, comps: list[str], images: DataFrame, props: list[str], key: str = "image_index", method: str = "pearson") -> DataFrame:
    """``property, component_1..k``: the correlation with each component, pairwise complete."""
    j = components.select(key, *comps).join(images.select(key, *props), key)
    if method != "pearson":
        pairs = [F.struct(F.lit(p).alias("property"), F.lit(c).alias("component"), finite_or_null(F.col(p)).alias("x"), finite_or_null(F.col(c)).alias("y")) for p in props for c in comps]
        long = j.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").where("x IS NOT NULL AND y IS NOT NULL")
        r = correlate_groups(long, ["property", "component"], method)
        return r.groupBy("property").agg(*[F.max(F.when(F.col("component") == c, F.col("r"))).alias(c) for c in comps])
    one = j.agg(*[pearson(F.col(p), F.col(c)).alias(f"{p}|{c}") for p in props for c in comps])
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("property"), *[F.col(f"`{p}|{c}`").alias(c) for c in comps]) for p in props])).alias("x")).select("x.*")


def top_correlations(corr: DataFrame, comps: list[str], k: int = 10) -> DataFrame:
    """``(component, property, correlation, rank)``: the ``k`` properties with the largest correlations of each component."""
    long = corr.select("property", F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("correlation")) for c in comps])).alias("x")).select("x.component", "property", "x.correlation")
    w = Window.partitionBy("component").orderBy(F.desc_nulls_last(F.abs("correlation")), "property")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- methods that need whole columns of a group ---------------------------------------------------------------------


def _abs_sums(x: np.ndarray) -> np.ndarray:
    """The sum of |x_i - x_j| over all j, for each i."""
    order = np.argsort(x, kind="stable")
    v = x[order]
    n, before = len(v), np.cumsum(v) - v
    k = np.arange(n)
    out = np.empty(n)
    out[order] = v * k - before + (v.sum() - before - v) - v * (n - 1 - k)
    return out


def _joint_abs_sum(x: np.ndarray, y: np.ndarray) -> float:
    """The sum of |x_i - x_j| |y_i - y_j| over all pairs (i, j), in n log^2 n steps.

    With rows sorted by x only the sign of y_i - y_j is open. Blocks of rows are merged two by two, and in each merge the
    rows of the right block take the sums of those rows of the left one whose y is smaller.
    """
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n = len(x)
    one = np.stack([np.ones(n), x, y, x * y])
    under = np.zeros((4, n))  # of the rows before with a smaller y: their number, and sums of x, y and xy
    half = 1
    while half < n:
        block = np.arange(n) // (2 * half)
        by = np.lexsort((np.arange(n), y, block))
        left = (by // half) % 2 == 0
        run = np.cumsum(one[:, by] * left, axis=1)
        starts = np.flatnonzero(np.diff(block[by], prepend=-1))
        base = np.repeat(np.where(starts > 0, run[:, starts - 1], 0.0), np.diff(np.append(starts, n)), axis=1)
        right = ~left
        under[:, by[right]] += (run - base)[:, right]
        half *= 2
    before = np.cumsum(one, axis=1) - one
    over = before - under
    # (x_i - x_j)(y_i - y_j) where y_j is smaller, its negative where it is not
    part = lambda t: t[0] * x * y - t[1] * y - t[2] * x + t[3]
    return float(2 * (part(under) - part(over)).sum())


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Distance correlation of paired values, exact, in n log^2 n time and memory of n; NaN under 4 pairs."""
    n = len(x)
    if n < 4 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return float("nan")
    # scaled and centred: distances don't care, sums of squares do
    x, y = (x - x.mean()) / np.ptp(x), (y - y.mean()) / np.ptp(y)
    rx, ry = _abs_sums(x), _abs_sums(y)

    def cov(joint: float, a: np.ndarray, b: np.ndarray) -> float:
        return joint / n**2 - 2 * (a * b).sum() / n**3 + a.sum() * b.sum() / n**4

    sxy = cov(_joint_abs_sum(x, y), rx, ry)
    sxx, syy = (cov(2 * n * (v * v).sum() - 2 * v.sum() ** 2, r, r) for v, r in ((x, rx), (y, ry)))
    return float(np.sqrt(max(sxy, 0) / np.sqrt(sxx * syy))) if sxx > 0 and syy > 0 else float("nan")


LEAF = 64  # points of a leaf of the tree


def _tree(p: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """An order of the points ``p`` (n x 2), and the boxes (lows, highs) of each level of a tree over runs of that order, the
    root first: a level cuts every run of the one before in the middle, across its wider side."""
    order, cuts = np.arange(len(p)), [0, len(p)]
    levels = []
    while True:
        starts = np.array(cuts[:-1])
        lows, highs = np.minimum.reduceat(p[order], starts), np.maximum.reduceat(p[order], starts)
        levels.append((lows, highs))
        if np.diff(cuts).max() <= LEAF:
            return order, levels
        run = np.repeat(np.arange(len(starts)), np.diff(cuts))
        wide = (highs - lows).argmax(1)
        order = order[np.lexsort((p[order, wide[run]], run))]
        cuts = [c for a, b in zip(cuts[:-1], cuts[1:]) for c in (a, (a + b) // 2)] + [len(p)]


def _kth_distances(p: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """The distance (larger side) of each of the distinct points ``p`` to its k-th neighbour; point i stands for ``w[i]`` rows.

    Leaves of a tree in turn: their own points bound the distances, and all leaves within the bound are met. Time of
    n log n, memory of n.
    """
    order, levels = _tree(p)
    q, v, out = p[order], w[order], np.empty(len(p))
    cuts = np.array([0, len(p)])
    for _ in levels[1:]:
        cuts = np.append(np.stack([cuts[:-1], (cuts[:-1] + cuts[1:]) // 2], axis=1).ravel(), len(p))

    def kth(lo: int, hi: int, at: np.ndarray) -> np.ndarray:
        d = np.maximum(np.abs(q[lo:hi, 0, None] - q[at, 0]), np.abs(q[lo:hi, 1, None] - q[at, 1]))
        m = min(k + 1, len(at))
        i = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(at) else np.broadcast_to(np.arange(m), d.shape)
        e = np.take_along_axis(d, i, 1)
        by = np.argsort(e, axis=1)
        seen = np.take_along_axis(v[at][i], by, 1).cumsum(1) - 1 >= k  # a point's own row is no neighbour
        return np.where(seen.any(1), np.take_along_axis(e, by, 1)[np.arange(len(d)), seen.argmax(1)], np.inf)

    for leaf, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        r = kth(lo, hi, np.arange(lo, hi)).max()
        low, high = levels[-1][0][leaf] - r, levels[-1][1][leaf] + r
        # a bound on rounding: distances are compared as differences, boxes as sums
        pad = 1e-12 * (np.abs(levels[0][0]).max() + np.abs(levels[0][1]).max())
        on = np.zeros(1, int)
        for lows, highs in levels[1:]:
            on = np.concatenate([2 * on, 2 * on + 1])
            on = on[((lows[on] <= high + pad) & (highs[on] >= low - pad)).all(1)]
        if len(on) * LEAF <= 1 << 16:
            out[lo:hi] = kth(lo, hi, np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in np.sort(on)]))
            continue
        # many leaves meet this one: a few rows and leaves at a time, with the nearest k + 1 of each row kept
        for i in range(lo, hi):
            d, u = np.empty(0), np.empty(0)
            for j in range(0, len(on), 1 << 10):
                at = np.concatenate([np.arange(cuts[t], cuts[t + 1]) for t in on[j : j + (1 << 10)]])
                d = np.append(d, np.maximum(np.abs(q[at, 0] - q[i, 0]), np.abs(q[at, 1] - q[i, 1])))
                u = np.append(u, v[at])
                best = np.argsort(d, kind="stable")[: k + 1]
                d, u = d[best], u[best]
            out[i] = d[np.argmax(u.cumsum() - 1 >= k)]
    back = np.empty(len(p))
    back[order] = out
    return back


def _between(u: np.ndarray, v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of the sorted ``u`` that differ by at most ``r`` from each of ``v``, which are among them. Sums are rounded, and
    the k-th neighbour lies just outside, so the ends are set by differences."""
    lo, hi = np.searchsorted(u, v - r, "left"), np.searchsorted(u, v + r, "right")
    last, moved = len(u) - 1, True
    while moved:
        less, more = v - u[np.minimum(lo, last)] > r, (lo > 0) & (v - u[np.maximum(lo - 1, 0)] <= r)
        far, near = u[np.maximum(hi - 1, 0)] - v > r, (hi <= last) & (u[np.minimum(hi, last)] - v <= r)
        lo, hi = lo + less - more, hi - far + near
        moved = less.any() or more.any() or far.any() or near.any()
    return lo, hi


def mutual_information_correlation(x: np.ndarray, y: np.ndarray, k: int = 3, w: np.ndarray | None = None) -> float:
    """sqrt(1 - exp(-2 MI)) with the nearest-neighbour estimate of MI, in [0, 1]; NaN under 4 pairs.

    Exact, in n log n time and memory of n. ``w``: how many rows have each pair, 1 by default.
    """
    w = np.ones(len(x), np.int64) if w is None else np.asarray(w, np.int64)
    n = int(w.sum())
    if n < 4 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return float("nan")
    xm, ym = np.average(x, weights=w), np.average(y, weights=w)
    x, y = (x - xm) / np.sqrt(np.average((x - xm) ** 2, weights=w)), (y - ym) / np.sqrt(np.average((y - ym) ** 2, weights=w))
    p, back = np.unique(np.stack([x, y], axis=1), axis=0, return_inverse=True)
    w = np.bincount(back.ravel(), weights=w).astype(np.int64)
    k = min(k, n - 1)
    r = np.nextafter(_kth_distances(p, w, k), 0)
    counts = []
    for v in p.T:
        u, at = np.unique(v, return_inverse=True)
        total = np.append(0, np.cumsum(np.bincount(at.ravel(), weights=w)))
        lo, hi = _between(u, v, r)
        counts.append(total[hi] - total[lo])
    mi = digamma(np.array([n]))[0] + digamma(np.array([k]))[0] - np.average(digamma(np.maximum(counts[0], 1)) + digamma(np.maximum(counts[1], 1)), weights=w)
    return float(np.sqrt(max(0.0, min(1.0, 1 - np.exp(-2 * max(mi, 0))))))


METHODS = {"distance": distance_correlation, "mutual_info": mutual_information_correlation}


def correlate_groups(long: DataFrame, keys: list[str], method: str) -> DataFrame:
    """``(*keys, r)`` of columns x and y per group. Spearman stays in the JVM; the others see one group at a time, mutual
    information each pair of values of it once, with the number of its rows."""
    if method == "spearman":
        return spearman(long, "x", "y", keys).select(*keys, F.col("rho").alias("r"))
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    f = METHODS[method]
    schema = ", ".join(f"{k} {long.schema[k].dataType.simpleString()}" for k in keys) + ", r double"
    if method == "mutual_info":
        long = long.groupBy(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.count("*").alias("w"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        more = {"w": pdf["w"].to_numpy()} if method == "mutual_info" else {}
        return pd.DataFrame([(*key, f(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), **more))], columns=[*keys, "r"])

    return long.groupBy(*keys).applyInPandas(run, schema)


def property_correlations(df: DataFrame, target: str, props: list[str], method: str) -> DataFrame:
    """``(property, r)`` of each property with a target column."""
    long = long_properties(df.withColumn("_y", finite_or_null(F.col(target))), ["_y"], props).where("value IS NOT NULL AND _y IS NOT NULL").select("property", F.col("value").alias("x"), F.col("_y").alias("y"))
    return correlate_groups(long, ["property"], method)
