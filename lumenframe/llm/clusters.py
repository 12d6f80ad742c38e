"""Grouping vectors into similarity clusters.

Cluster-feature trees are built per partition and their leaves tree-reduced; the leaves that hold several vectors are
agglomerated by Ward's criterion; one full pass assigns every row to a leaf's typical member it is linked to. What is
linked to none is compared within the cells of a fitted index, so that small groups and fringes are found as well, and
connected components join what is linked. Rows tied to members of clusters that are still apart are then compared wherever
the angles to the members leave a link possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm import vectors as V
from lumenframe.operators.blocks import stream_groups
from lumenframe.operators.graph import connected_components
from lumenframe.runtime import materialize, partitions

LEAVES = 512  # most leaves a partition's tree hands on; rows of other leaves are found by the index
BRANCH = 24  # leaves under one inner node
BLOCK = 4_096  # rows held at a time where two clusters' rows meet


class FeatureTree:
    """Leaves (n, linear sum, typical member) under inner nodes; a vector goes to the nearest node, then leaf.

    Vectors are of length 1, so the squared sum of a leaf equals n and the linear sum alone gives its radius.
    """

    def __init__(self, dim: int, within: float):
        self.dim, self.within = dim, within
        self.n = np.zeros(0, np.int64)
        self.ls = np.zeros((0, dim))
        self.centre = np.zeros((0, dim), np.float32)
        self.rep_id = np.zeros(0, np.int64)
        self.rep = np.zeros((0, dim), np.float32)
        self.rep_sim = np.zeros(0)

    def insert(self, ids: np.ndarray, x: np.ndarray, n: np.ndarray | None = None, ls: np.ndarray | None = None) -> None:
        """Rows, or the leaves of another tree (``x`` their centres, ``n`` and ``ls`` their features)."""
        n = np.ones(len(x), np.int64) if n is None else n
        ls = x if ls is None else ls
        todo = np.arange(len(x))
        if len(self.n) and len(todo):
            s = x @ self.centre.T
            to = s.argmax(1)
            at = s[np.arange(len(x)), to]
            fit = at >= self.within
            self._take(to[fit], at[fit], ids[fit], x[fit], n[fit], ls[fit])
            todo = todo[~fit]
        while len(todo):
            # the next rows open leaves unless an opened one takes them
            lead = todo[: 4 * BRANCH]
            g = x[lead] @ x[lead].T >= self.within
            opened: list[int] = []
            for i in range(len(lead)):
                if not any(g[i, j] for j in opened):
                    opened.append(i)
            new = lead[opened]
            start = len(self.n)
            self.n = np.append(self.n, np.zeros(len(new), np.int64))
            self.ls = np.concatenate([self.ls, np.zeros((len(new), self.dim))])
            self.centre = np.concatenate([self.centre, x[new].astype(np.float32)])
            self.rep_id, self.rep = np.append(self.rep_id, ids[new]), np.concatenate([self.rep, x[new].astype(np.float32)])
            self.rep_sim = np.append(self.rep_sim, np.full(len(new), -1.0))
            s = x[todo] @ self.centre[start:].T
            to, at = s.argmax(1) + start, s.max(1)
            fit = at >= self.within
            t = todo[fit]
            self._take(to[fit], at[fit], ids[t], x[t], n[t], ls[t])
            todo = todo[~fit]

    def _take(self, to, at, ids, x, n, ls) -> None:
        if not len(to):
            return
        np.add.at(self.n, to, n)
        np.add.at(self.ls, to, ls)
        touched = np.unique(to)
        self.centre[touched] = (self.ls[touched] / np.maximum(np.linalg.norm(self.ls[touched], axis=1, keepdims=True), 1e-12)).astype(np.float32)
        order = np.lexsort((at, to))
        last = order[np.append(np.diff(to[order]) != 0, True)]
        better = at[last] > self.rep_sim[to[last]]
        i = last[better]
        self.rep_id[to[i]], self.rep[to[i]], self.rep_sim[to[i]] = ids[i], x[i], at[i]

    def largest(self, limit: int, least: int = 2) -> np.ndarray:
        order = np.lexsort((self.rep_id, -self.n))[:limit]
        return order[self.n[order] >= least]


LEAF = "part int, n bigint, ls array<double>, rep_id bigint, rep array<float>"
LEAF_ARROW = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("ls", pa.list_(pa.float64())), ("rep_id", pa.int64()), ("rep", pa.list_(pa.float32()))])


def _leaf_batch(t: FeatureTree, keep: np.ndarray, part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), part, np.int32)), pa.array(t.n[keep]), pa.array(list(t.ls[keep]), pa.list_(pa.float64())), pa.array(t.rep_id[keep]), pa.array(list(t.rep[keep]), pa.list_(pa.float32()))], schema=LEAF_ARROW)


def leaves(df: DataFrame, id_col: str, vec_col: str, dim: int, within: float, fan_in: int = 16) -> FeatureTree:
    """The tree of all leaves with several vectors: per partition, then merged ``fan_in`` partitions at a time."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, held = FeatureTree(dim, within), []
        for batch in batches:
            ids, x = V.read_batch(batch, id_col, vec_col, dim)
            if len(ids):
                t.insert(ids, V.unit(x).astype(np.float32))
            if len(t.n) > 8 * LEAVES:
                # out of room: small leaves go; their rows are met again in the assignment pass
                keep = t.largest(LEAVES, 1)
                t.n, t.ls, t.centre, t.rep_id, t.rep, t.rep_sim = t.n[keep], t.ls[keep], t.centre[keep], t.rep_id[keep], t.rep[keep], t.rep_sim[keep]
        held = t.largest(LEAVES)
        if len(held):
            yield _leaf_batch(t, held, TaskContext.get().partitionId())

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _merged(pdf, dim, within)
        keep = t.largest(LEAVES)
        return _leaf_batch(t, keep, int(pdf["part"].min()) // fan_in).to_pandas()

    out = materialize(df.mapInArrow(grow, LEAF), "leaves")
    n = (out.agg(F.max("part")).first()[0] or 0) + 1
    while n > fan_in:
        out = materialize(out.groupBy((F.col("part") / fan_in).cast("int").alias("g")).applyInPandas(join, LEAF), "leaves")
        n = -(-n // fan_in)
    # at most fan_in x LEAVES leaves remain
    return _merged(out.toPandas(), dim, within)


def _merged(pdf: pd.DataFrame, dim: int, within: float) -> FeatureTree:
    t = FeatureTree(dim, within)
    if len(pdf):
        pdf = pdf.sort_values(["n", "rep_id"], ascending=[False, True])
        ls = np.stack(pdf["ls"].to_numpy())
        x = (ls / np.maximum(np.linalg.norm(ls, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        rep = np.stack(pdf["rep"].to_numpy()).astype(np.float32)
        t.insert(pdf["rep_id"].to_numpy(np.int64), x, pdf["n"].to_numpy(np.int64), ls)
        # a typical member is a real row: carry the vector of the chosen id
        where = {i: r for i, r in zip(pdf["rep_id"].tolist(), rep)}
        t.rep = np.stack([where[i] for i in t.rep_id.tolist()]) if len(t.rep_id) else t.rep
    return t


def ward(n: np.ndarray, centre: np.ndarray, least: float) -> np.ndarray:
    """Labels of leaves after Ward agglomeration: the cheapest merge first, until no two clusters' centres reach ``least``."""
    k = len(n)
    label, size, c = np.arange(k), n.astype(float).copy(), centre.astype(float).copy()
    alive = np.ones(k, bool)
    dot = c @ c.T
    sq = np.diag(dot).copy()

    def costs(i: int) -> np.ndarray:
        cost = size[i] * size / np.maximum(size[i] + size, 1) * (sq[i] + sq - 2 * dot[i])
        cost[~(alive & (dot[i] >= least * np.sqrt(sq[i] * sq)))] = np.inf
        cost[i] = np.inf
        return cost

    # each cluster keeps its cheapest partner, so that a merge looks at few rows again
    best, to = np.full(k, np.inf), np.zeros(k, int)
    for i in range(k):
        r = costs(i)
        to[i] = r.argmin()
        best[i] = r[to[i]]
    while k and np.isfinite(best).any():
        a = int(best.argmin())
        b = int(to[a])
        c[a] = (size[a] * c[a] + size[b] * c[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b], best[b] = False, np.inf
        label[label == label[b]] = label[a]
        dot[a] = dot[:, a] = c @ c[a]
        sq[a] = dot[a, a]
        r = costs(a)
        stale = np.flatnonzero(alive & ((to == a) | (to == b)))
        nearer = alive & (r < best)
        best[nearer], to[nearer] = r[nearer], a
        for i in {a, *stale.tolist()}:
            x = costs(i)
            to[i] = x.argmin()
            best[i] = x[to[i]]
    return label


def _tied(exact: np.ndarray, u: np.ndarray, reps: np.ndarray, link: float) -> tuple[np.ndarray, np.ndarray]:
    """Similarities to the typical members, on the right side of ``link`` where it is close, and the member each row is
    tied to, or -1."""
    rep = np.full(len(u), -1, np.int64)
    s = u @ reps.T
    if not s.size:
        return s, rep
    close = np.abs(s - link) < 1e-5
    if close.any():
        i, j = np.nonzero(close)
        s[i, j] = np.where(np.einsum("ij,ij->i", exact[i], reps[j].astype(np.float64)) >= link, link + 1e-4, link - 1e-4)
    to = s.argmax(1)
    on = s[np.arange(len(u)), to] >= link
    rep[on] = to[on]
    return s, rep


def _notes(kind: int, ids: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
    """Rows that no cell takes: they pass through to the comparing tasks under a negative cell."""
    m = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(np.full(m, -kind, np.int64)), pa.array(np.zeros(m, np.int32)), pa.array(np.full(m, kind, np.int8)), pa.array(ids), pa.array(tag), pa.nulls(m, pa.binary())], schema=V.PLACE_ARROW)


class _Sets:
    def __init__(self):
        self.p: dict[int, int] = {}

    def root(self, x: int) -> int:
        self.p.setdefault(x, x)
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def tie(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.p[max(a, b)] = min(a, b)

    def links(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in self.p if self.root(x) != x]


def linked_clusters(df: DataFrame, id_col: str, vec_col: str, dim: int = 128, link: float = 0.75, within: float = 0.85, probes: int = 6, least_size: int = 1) -> DataFrame:
    """``(id, head, size)``: the cluster of every usable vector, named by its smallest id; ``size`` counts distinct ids.

    Two vectors belong together if a chain of vectors of pairwise similarity ``link`` or more joins them. Every link used
    is computed exactly between two rows; the tree, Ward's clusters and the cells only choose what is compared. Between
    rows tied to typical members no link is lost; rows tied to none meet others in ``probes`` cells only. Vectors
    without any link have themselves as head. ``least_size`` leaves out smaller clusters. No rows from an empty table.
    """
    spark = df.sparkSession
    data = df.select(id_col, vec_col)
    tree = leaves(data, id_col, vec_col, dim, within)
    keep = tree.largest(4 * LEAVES)
    reps, rep_ids = V.unit(tree.rep[keep]) if len(keep) else np.zeros((0, dim)), tree.rep_id[keep]
    group = ward(tree.n[keep], tree.centre[keep], link) if len(keep) else np.zeros(0, int)
    # within a Ward cluster the members of large leaves serve first; up to eight of them cover its spread
    chosen = [i for i in range(len(keep)) if (group[:i] == group[i]).sum() < 8]
    reps, rep_ids = reps[chosen].astype(np.float32), rep_ids[chosen]
    b = spark.sparkContext.broadcast((reps, rep_ids))

    def tie(batches: Iterator[pa.RecordBatch]):
        """Rows with the member they are tied to, of which those tied to none probe; then links between members (kind 2),
        and each member with the least similarity of a row tied to it (kind 3)."""
        reps, rep_ids = b.value
        ties = _Sets()
        known: set = set()
        least = np.full(len(rep_ids), 2.0)
        for batch in batches:
            ids, x = V.read_batch(batch, id_col, vec_col, dim)
            if not len(ids):
                continue
            exact = V.unit(x)
            s, rep = _tied(exact, exact.astype(np.float32), reps, link)
            if len(rep_ids):
                on = rep >= 0
                np.minimum.at(least, rep[on], s[on, rep[on]])
                hit, to = s >= link, s.argmax(1)
                i, j = np.nonzero(hit)
                pairs = np.unique(to[i] * len(rep_ids) + j)
                for p in pairs.tolist():
                    if p not in known:
                        known.add(p)
                        ties.tie(int(rep_ids[p // len(rep_ids)]), int(rep_ids[p % len(rep_ids)]))
            yield ids, x, np.where(rep >= 0, rep_ids[np.maximum(rep, 0)], -1) if len(rep_ids) else rep, rep < 0
        links = ties.links()
        if links:
            yield _notes(2, np.array([a for a, _ in links], np.int64), np.array([c for _, c in links], np.int64))
        seen = np.flatnonzero(least <= 1.5)
        if len(seen):
            # in millionths, a little too low rather than too high
            yield _notes(3, rep_ids[seen], np.floor((least[seen] - 2e-4) * 1e6).astype(np.int64))

    out_schema = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("node", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: a row and the member it is assigned to (or itself); kind 1: a link between two nodes; kind 3: a member
        and the least similarity of a row to it."""

        def against(state: list, ties: _Sets, t: pa.Table | None) -> None:
            if len(state) == 1:
                tab = pa.concat_tables(state[0]).combine_chunks()
                ids, at = np.unique(np.asarray(tab.column("id")), return_index=True)
                rep = tab.column("tag").combine_chunks()
                alone = np.asarray(rep.is_null())[at]
                node = np.where(alone, ids, np.asarray(rep.fill_null(-1))[at])
                state[:] = [V.unit(V.unpack(tab.column("vec").combine_chunks(), dim)[at]), ids, node, alone]
            o, oid, node, alone = state
            if t is None:
                q, qid = o[alone], oid[alone]
            else:
                qid, at = np.unique(np.asarray(t.column("id")), return_index=True)
                q = V.unit(V.unpack(t.column("vec").combine_chunks(), dim)[at])
                rep = t.column("tag").combine_chunks()
                qid = np.where(np.asarray(rep.is_null())[at], qid, np.asarray(rep.fill_null(-1))[at])
            of = o.astype(np.float32)
            for i in range(0, len(q), 1024):
                s = q[i : i + 1024].astype(np.float32) @ of.T
                a, c = np.nonzero(s >= link - 1e-5)
                sure = s[a, c] >= link + 1e-5
                if not sure.all():
                    w = np.flatnonzero(~sure)
                    sure[w] = np.einsum("ij,ij->i", q[i + a[w]], o[c[w]]) >= link
                a, c = a[sure] + i, c[sure]
                for x, y in np.unique(np.stack([qid[a], node[c]], 1), axis=0).tolist() if len(a) else ():
                    if x != y:
                        ties.tie(x, y)

        def close(state: list, ties: _Sets) -> Iterator[pa.RecordBatch]:
            against(state, ties, None)
            _, oid, node, _ = state
            links = ties.links()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(len(oid), np.int8), np.ones(len(links), np.int8)])), pa.array(np.concatenate([oid, np.array([a for a, _ in links], np.int64)])), pa.array(np.concatenate([node, np.array([c for _, c in links], np.int64)]))], schema=out_schema)

        state, ties = [], _Sets()
        for new, t in stream_groups(batches, ["cell", "block"]):
            if int(t.column("cell")[0].as_py()) < 0:
                yield pa.RecordBatch.from_arrays([pa.array(np.where(np.asarray(t.column("kind")) == 3, 3, 1).astype(np.int8)), t.column("id").combine_chunks(), t.column("tag").combine_chunks()], schema=out_schema)
                continue
            if new:
                if state:
                    yield from close(state, ties)
                state, ties = [], _Sets()
            kind = np.asarray(t.column("kind"))
            cut = int(np.searchsorted(kind, 1))
            if cut:
                if not state:
                    state = [[]]
                state[0].append(t.slice(0, cut))
            if cut < len(kind) and state:
                against(state, ties, t.slice(cut))
        if state:
            yield from close(state, ties)

    placed, n_rows = V.place(data, id_col, vec_col, dim, probes, prepare=tie)
    placed = placed.repartition(V.cell_tasks(n_rows, 1 + probes / 3, dim, partitions(spark)), "cell", "block").sortWithinPartitions("cell", "block", "kind", "id")
    done = materialize(placed.mapInArrow(compare, "kind byte, id bigint, node bigint"), "links")
    links = done.where("kind = 1").select(F.col("id").alias("src"), F.col("node").alias("dst"))
    comps = connected_components(links)
    if len(rep_ids):
        more = _bridges(data, done, comps, (id_col, vec_col, dim, link), reps, rep_ids, compare)
        if more is not None:
            comps = connected_components(links.unionByName(more))
    rows = done.where("kind = 0").select("id", "node").distinct()
    rows = rows.join(comps, "node", "left").select("id", F.coalesce("component", "node").alias("comp"))
    rows = materialize(rows, "members")
    sizes = rows.groupBy("comp").agg(F.count("*").alias("size"), F.min("id").alias("head")).where(F.col("size") >= least_size)
    return rows.join(sizes, "comp").select("id", "head", "size")


def _bridges(data: DataFrame, done: DataFrame, comps: DataFrame, how: tuple, reps: np.ndarray, rep_ids: np.ndarray, compare) -> DataFrame | None:
    """Links ``(src, dst)`` between typical members of different components, by all rows tied to them.

    If rows x and y are linked, the angle of x to y's member is at most the link's angle plus the largest angle of a row
    tied to that member, and likewise for y. Only rows for which this holds on both sides are compared, all with all, by
    pair of components and in blocks of bounded size. A first pass counts them: pairs that lack a side aren't sent.
    """
    id_col, vec_col, dim, link = how
    spark = data.sparkSession
    low = {r[0]: r[1] / 1e6 for r in done.where("kind = 3").groupBy("id").agg(F.min("node")).collect()}
    head = {r["node"]: r["component"] for r in comps.where(F.col("node").isin(rep_ids.tolist())).collect()}
    comp = np.unique([head.get(i, i) for i in rep_ids.tolist()], return_inverse=True)[1].astype(np.int64)
    k = int(comp.max()) + 1
    if k < 2:
        return None
    # no row has to meet a member to which none is tied
    bound = np.array([np.cos(min(np.pi, np.arccos(link) + np.arccos(np.clip(low[i], -1, 1)))) - 1e-4 if i in low else 2.0 for i in rep_ids.tolist()])
    b = spark.sparkContext.broadcast((reps, rep_ids, comp, bound))

    def near(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, vectors and members of rows, and what may have a link: row, pair of components, side."""
        reps, _, comp, bound = b.value
        ids, x = V.read_batch(batch, id_col, vec_col, dim)
        exact = V.unit(x)
        s, rep = _tied(exact, exact.astype(np.float32), reps, link)
        i, j = np.nonzero((s >= bound) & (rep >= 0)[:, None])
        own, other = comp[rep[i]], comp[j]
        i, own, other = i[own != other], own[own != other], other[own != other]
        i, at = np.unique(i * k + other, return_index=True)
        i, own, other = i // k, own[at], other[at]
        return ids, x, rep, i, np.minimum(own, other) * k + np.maximum(own, other), (own > other).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        for batch in batches:
            *_, pair, side = near(batch)
            for c, m in zip(*(v.tolist() for v in np.unique(pair * 2 + side, return_counts=True))):
                n[c] = n.get(c, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["c", "n"])

    n = {r[0]: r[1] for r in data.mapInArrow(count, "c bigint, n bigint").groupBy("c").agg(F.sum("n")).collect()}
    pairs = np.array(sorted(c // 2 for c in n if c % 2 == 0 and c + 1 in n), np.int64)
    if not len(pairs):
        return None
    sides = np.array([[n[2 * c], n[2 * c + 1]] for c in pairs.tolist()])
    plan = spark.sparkContext.broadcast((pairs, sides.argmax(1), -(-sides.max(1) // BLOCK)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, base, blocks = plan.value
        for batch in batches:
            ids, x, rep, i, pair, side = near(batch)
            at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            on = pairs[at] == pair
            i, at, side = i[on], at[on], side[on]
            if not len(i):
                continue
            # the larger side is cut into blocks, the other one visits them all
            kind = (side != base[at]).astype(np.int8)
            times = np.where(kind == 1, blocks[at], 1)
            block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, at, kind = np.repeat(i, times), np.repeat(at, times), np.repeat(kind, times)
            block = np.where(kind == 1, block, (V.mix(ids[row]) % blocks[at].astype(np.uint64)).astype(np.int64))
            packed = np.array(V.pack(x), dtype=object)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(block.astype(np.int32)), pa.array(kind), pa.array(ids[row]), pa.array(b.value[1][rep[row]]), pa.array(packed[row].tolist(), pa.binary())], schema=V.PLACE_ARROW)

    met = data.mapInArrow(send, V.PLACE)
    met = met.repartition(partitions(spark), "cell", "block").sortWithinPartitions("cell", "block", "kind", "id")
    more = met.mapInArrow(compare, "kind byte, id bigint, node bigint").where("kind = 1").select(F.col("id").alias("src"), F.col("node").alias("dst"))
    more = materialize(more, "bridges")
    return None if more.isEmpty() else more


def describe(df: DataFrame, members: DataFrame, id_col: str, vec_col: str, dim: int = 128, typical: int = 3) -> DataFrame:
    """``(head, size, rank, id, similarity)``: the ``typical`` members of each cluster nearest to its centre.

    Centres are sums of unit vectors, added up per partition before anything is shuffled; ties by the smaller id.
    """
    v = df.select(F.col(id_col).alias("id"), vec_col).dropDuplicates(["id"]).join(members, "id")
    v = materialize(v, "clustered")
    names = ["head", "s"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            heads = np.asarray(batch.column("head"))
            _, x = V.read_batch(batch, "id", vec_col, dim)
            order = np.argsort(heads, kind="stable")
            cuts = np.flatnonzero(np.diff(heads[order], prepend=heads[order][:1] - 1)) if len(order) else np.empty(0, int)
            for h, s in zip(heads[order][cuts].tolist(), np.add.reduceat(V.unit(x)[order], cuts, axis=0) if len(cuts) else ()):
                sums[h] = sums[h] + s if h in sums else s
            if len(sums) > 8 * BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=names)
                sums = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums arrive sorted by cluster: one is held at a time."""
        now, s = None, None
        for new, t in stream_groups(batches, ["head"]):
            if new and s is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([s], pa.list_(pa.float64()))], names=names)
            x = np.asarray(t.column("s").combine_chunks().flatten()).reshape(-1, dim).sum(0)
            now, s = t.column("head")[0].as_py(), x if new or s is None else s + x
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([s], pa.list_(pa.float64()))], names=names)

    kind = "head bigint, s array<double>"
    centre = v.mapInArrow(partial, kind).repartition(partitions(df.sparkSession), "head").sortWithinPartitions("head").mapInArrow(total, kind)
    dot = F.aggregate(F.zip_with(vec_col, "s", lambda a, c: a.cast("double") * c), F.lit(0.0), lambda a, x: a + x)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), lambda a, x: a + x))
    near = v.join(centre, "head").select("head", "size", "id", (dot / (norm(F.col(vec_col)) * norm(F.col("s")))).alias("similarity"))
    # Spark keeps the first ``typical`` of each partition before the shuffle, so a large cluster is no hot group
    w = Window.partitionBy("head").orderBy(F.desc("similarity"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= typical)
