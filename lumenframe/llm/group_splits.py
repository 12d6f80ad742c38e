"""Splits that keep related records together.

Records that share a key value, directly or through other records, form a group; groups are bundled by size and
profile, a min-cost flow gives every bundle's rows to the splits, and hashing picks the members.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.operators.graph import connected_components
from lumenframe.runtime import materialize

# fixed values: the ways a missing value is written
MISSING = ("", "nan", "n/a", "na", "none", "null", "unknown", "missing", "nil", "-", "--", "?", "<na>")


def whole_number(c: Column) -> Column:
    """The whole number a text writes (``1``, ``+1``, ``001``, ``1.0``, ``1e0``), as canonical digits; else null."""
    t = F.trim(F.regexp_replace(c.cast("string"), r"[\s ]+", ""))
    plain = F.regexp_extract(t, r"^\+?0*(\d+)(?:\.0*)?$", 1)
    minus = F.regexp_extract(t, r"^-0*(\d+)(?:\.0*)?$", 1)
    floating = t.rlike(r"(?i)^[+-]?(\d+\.?\d*|\.\d+)e[+-]?\d+$")
    number = F.when(floating, t.try_cast("double"))
    exact = F.when((F.abs(number) < 1e15) & (number == F.floor(number)), F.floor(number).cast("bigint").cast("string"))
    return F.when(plain != "", plain).when(minus == "0", "0").when(minus != "", F.concat(F.lit("-"), minus)).otherwise(exact)


def plain_label(c: Column) -> Column:
    """The label without case and spaces; null where missing, however that is written."""
    t = F.lower(F.regexp_replace(c.cast("string"), r"[\s ]+", ""))
    return F.when(~t.isin(*MISSING), t)


def related_groups(df: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """``(id, key, group)``: one row per distinct id with the group it belongs to.

    ``keys`` maps a short tag to the normalised key column. A null key ties nothing; a record without keys is a group of
    its own. Rows repeated under one id count once, and their keys tie as well. A null id is dropped (it names no
    record). ``group`` is a text: the smallest tagged key of the component, or ``id:<id>``.
    """
    tagged = [F.concat(F.lit(f"{tag}:"), c) for tag, c in keys.items()]
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.array_compact(F.array(*tagged)).alias("ks"))
    # written once: it is read four times, and the patterns above are costly
    rows = materialize(rows.select("id", "ks", F.when(F.size("ks") > 0, F.col("ks")[0]).alias("key")).distinct(), "keys")
    across = (
        rows.where(F.size("ks") > 1)
        .select(F.col("key").alias("src"), F.explode(F.slice("ks", 2, len(keys))).alias("dst"))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
        .select("src", "dst")
    )
    spread = rows.where("key IS NOT NULL").groupBy("id").agg(F.min("key").alias("m"), F.max("key").alias("x"))
    within = rows.join(spread.where("m < x"), "id", "left_semi").join(spread.where("m < x").select("id", "m"), "id").select(F.col("key").alias("src"), F.col("m").alias("dst")).where("src <> dst")
    comps = connected_components(across.unionByName(within)).withColumnsRenamed({"node": "key", "component": "comp"})
    one = rows.groupBy("id").agg(F.min("key").alias("key"))
    return one.join(comps, "key", "left").select("id", "key", F.coalesce("comp", "key", F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("group"))


def batch_groups(fold_labels: DataFrame) -> DataFrame:
    """``(image_index, group)`` of fold_labels: batches tie by whole number, labels by text without case and spaces."""
    g = related_groups(fold_labels, "image_index", {"b": whole_number(F.col("batch_id")), "l": plain_label(F.col("labels"))})
    return g.withColumnRenamed("id", "image_index")


def tied_batches(fold_labels: DataFrame) -> DataFrame:
    """Images whose group holds two or more batches, with the smallest batch number of the group."""
    g = materialize(batch_groups(fold_labels), "groups")
    numbers = g.where(F.col("key").startswith("b:")).groupBy("group", F.substring("key", 3, 40).cast("decimal(38,0)").alias("number")).agg(F.count("*").alias("n"))
    many = numbers.groupBy("group").agg(F.count("*").alias("batches"), F.min("number").cast("bigint").alias("group_batch")).where("batches >= 2")
    return g.join(many, "group").select("image_index", "group_batch")


class _Flow:
    """Min-cost flow: shortest paths with potentials, and all paths of one cost pushed at once, on float capacities."""

    def __init__(self, n: int):
        self.n, self.to, self.cap, self.cost, self.out = n, [], [], [], [[] for _ in range(n)]

    def edge(self, a: int, b: int, cap: float, cost: float) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0.0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        pot, to, cap, cost, eps = [0.0] * self.n, self.to, self.cap, self.cost, 1e-7
        while True:
            dist, heap = [float("inf")] * self.n, [(0.0, s)]
            dist[s] = 0.0
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u] + 1e-12:
                    continue
                for e in self.out[u]:
                    if cap[e] > eps and (nd := d + cost[e] + pot[u] - pot[to[e]]) < dist[to[e]] - 1e-12:
                        dist[to[e]] = nd
                        heapq.heappush(heap, (nd, to[e]))
            if dist[t] == float("inf"):
                return
            pot = [p + min(d, dist[t]) for p, d in zip(pot, dist)]
            while self._push(s, t, pot, eps):
                pass

    def _push(self, s: int, t: int, pot: list[float], eps: float) -> float:
        """A blocking flow over the edges that lie on cheapest paths, by levels."""
        to, cap, cost, out = self.to, self.cap, self.cost, self.out
        level, queue = [-1] * self.n, [s]
        level[s] = 0
        for u in queue:
            for e in out[u]:
                if cap[e] > eps and level[to[e]] < 0 and abs(cost[e] + pot[u] - pot[to[e]]) < 1e-9:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return 0.0
        at, path, done = [0] * self.n, [], 0.0
        u = s
        while True:
            if u == t:
                push = min(cap[e] for e in path)
                done += push
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if cap[e] <= eps)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if cap[e] > eps and level[to[e]] == level[u] + 1 and abs(cost[e] + pot[u] - pot[to[e]]) < 1e-9:
                    break
                at[u] += 1
            if at[u] < len(out[u]):
                path.append(e)
                u = to[e]
            elif path:
                e = path.pop()
                u = to[e ^ 1]
                at[u] += 1
            else:
                return done


def _divide(size: np.ndarray, n: np.ndarray, prof: np.ndarray, want: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rows of each bundle per split by min-cost flow: source -> bundle -> split within profile (what is wanted there free,
    beyond that at cost 1) -> split (what is wanted free, beyond that at cost 2) -> sink."""
    nb, (np_, k) = len(size), want.shape
    f = _Flow(2 + nb + np_ * k + k)
    s, t, mid, end, mass = 0, 1, 2 + nb, 2 + nb + np_ * k, size * n
    arcs: list = [None] * nb
    # many divisions cost the same; with large bundles first those are kept whole and small ones fill what is left
    for b in np.argsort(-size, kind="stable").tolist():
        f.edge(s, 2 + b, mass[b], 0.0)
        arcs[b] = [f.edge(2 + b, mid + prof[b] * k + j, mass[b], 0.0) for j in range(k)]
    for p in range(np_):
        for j in range(k):
            f.edge(mid + p * k + j, end + j, max(want[p, j], 0.0), 0.0)
            f.edge(mid + p * k + j, end + j, mass.sum(), 1.0)
    for j in range(k):
        f.edge(end + j, t, max(total[j], 0.0), 0.0)
        f.edge(end + j, t, mass.sum(), 2.0)
    f.run(s, t)
    return np.array([[f.cap[e ^ 1] for e in a] for a in arcs])


def split_quotas(bundles: pd.DataFrame, shares: list[float], large: float = 0.002) -> np.ndarray:
    """Groups of each bundle per split: ``bundles`` has size, profile, n; the result is (bundles, splits) of whole numbers.

    Rows are divided by min-cost flow (see :func:`_divide`). A bundle gets the whole groups of its flow; a group that the
    flow divides goes where the deviations of split and profile together grow least, as the flow of the bundles not yet
    rounded stands. Groups of more than ``large`` of all rows are settled first, and the flow is run again for the others
    with what these leave. Ties go to the split that lacks most, then to the first.
    """
    k, nb = len(shares), len(bundles)
    out = np.zeros((nb, k), dtype=np.int64)
    if not nb:
        return out
    share = np.asarray(shares, float) / max(sum(shares), 1e-300)
    size, n = bundles["size"].to_numpy(float), bundles["n"].to_numpy(np.int64)
    names, prof = np.unique(bundles["profile"].to_numpy(), return_inverse=True)
    mass = size * n
    want, total = np.bincount(prof, mass, minlength=len(names))[:, None] * share, mass.sum() * share
    big = size > large * mass.sum()
    for turn in (big, ~big):
        if not turn.any():
            continue
        rest = np.flatnonzero(turn | ~big)
        flow = np.zeros((nb, k))
        flow[rest] = _divide(size[rest], n[rest], prof[rest], want, total)
        mine = np.flatnonzero(turn)
        has, all_ = np.zeros_like(want), flow[mine].sum(0)
        np.add.at(has, prof[mine], flow[mine])
        # what large groups leave open the others can fill, so only what is too much counts
        off = (lambda x: np.maximum(x, 0.0)) if turn is big and (~big).any() else np.abs
        for b in mine[np.argsort(-size[mine], kind="stable")]:
            p = prof[b]
            whole = np.floor(flow[b] / size[b] + 1e-6).astype(np.int64)
            change = whole * size[b] - flow[b]
            has[p] += change
            all_ += change
            out[b] = whole
            for _ in range(int(n[b] - whole.sum())):
                grow = 2 * (off(all_ + size[b] - total) - off(all_ - total)) + off(has[p] + size[b] - want[p]) - off(has[p] - want[p])
                j = int(np.lexsort((np.arange(k), np.round(all_ - total, 6), np.round(grow, 6)))[0])
                out[b, j] += 1
                has[p, j] += size[b]
                all_[j] += size[b]
        done = out[mine] * size[mine, None]
        total = total - done.sum(0)
        np.subtract.at(want, prof[mine], done)
    return out


def assign_splits(groups: DataFrame, targets: list[tuple[str, float]], profile: Column | None = None, step: float = 0.5, seed: int = 17, ranges: int = 1024) -> DataFrame:
    """``(image_index, group, split_name)`` for rows ``(image_index, group)``; whole groups go to one split.

    ``profile`` (optional) is a number of the group's rows: its mean over the group, in steps of ``step`` and at most eight
    of them to either side of 0, is the label profile of the group; groups without a number have a profile of their own.
    The bundles are few: sizes add up to the rows, so there are at most ~sqrt(2 rows) of them per profile.
    Members of a bundle are ordered by hash; a position is the count of all lower hash ranges plus the rank in the own
    range, so no bundle is ever sorted in one task. An empty table gives an empty result.
    """
    spark = groups.sparkSession
    prof = F.lit(0) if profile is None else F.coalesce(F.greatest(F.lit(-8), F.least(F.lit(8), F.round(F.avg(profile) / step))), F.lit(-99)).cast("int")
    sized = groups.groupBy("group").agg(F.count("*").alias("size"), prof.alias("profile"))
    sized = materialize(sized.withColumn("h", F.xxhash64("group", F.lit(seed))).withColumn("range", F.pmod("h", F.lit(ranges)).cast("int")), "sizes")
    bundles = sized.groupBy("size", "profile").agg(F.count("*").alias("n")).toPandas().sort_values(["size", "profile"]).reset_index(drop=True)
    quota = split_quotas(bundles, [s for _, s in targets])
    rows, names = [], [n for n, _ in targets]
    for b in range(len(bundles)):
        upto = np.cumsum(quota[b])
        for j, name in enumerate(names):
            if quota[b, j]:
                rows.append((int(bundles["size"][b]), int(bundles["profile"][b]), int(upto[j] - quota[b, j]), int(upto[j]), name))
    cuts = spark.createDataFrame(rows, "size bigint, profile int, lo bigint, hi bigint, split_name string")
    per = sized.groupBy("size", "profile", "range").agg(F.count("*").alias("c"))
    before = per.withColumn("base", F.sum("c").over(Window.partitionBy("size", "profile").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("size", "profile", "range", F.coalesce("base", F.lit(0)).alias("base"))
    placed = sized.withColumn("r", F.row_number().over(Window.partitionBy("size", "profile", "range").orderBy("h", "group")) - 1)
    placed = placed.join(before, ["size", "profile", "range"]).withColumn("pos", F.col("r") + F.col("base"))
    c = cuts.alias("c")
    chosen = placed.alias("p").join(c, (F.col("p.size") == F.col("c.size")) & (F.col("p.profile") == F.col("c.profile")) & (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))).select("group", "split_name")
    return groups.join(chosen, "group").select("image_index", "group", "split_name")
