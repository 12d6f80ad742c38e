"""The most similar vectors of every vector, by randomly rotated one-bit codes inside the cells of a fitted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions.vectors import is_usable
from lumenframe.llm import vectors as V
from lumenframe.operators.blocks import stream_groups
from lumenframe.runtime import materialize, partitions

OUT = "query bigint, neighbour bigint, similarity double"
ARROW = pa.schema([("query", pa.int64()), ("neighbour", pa.int64()), ("similarity", pa.float64())])


def exact(q: np.ndarray, o: np.ndarray, qi: np.ndarray, oi: np.ndarray, step: int = 65_536) -> np.ndarray:
    """Cosines of pairs, in double precision (rows of ``q`` and ``o`` are unit vectors)."""
    if len(qi) > 0.03 * len(q) * len(o):  # many of all pairs: one product costs less than to fetch them
        return (q @ o.T)[qi, oi]
    out = np.empty(len(qi))
    for i in range(0, len(qi), step):
        out[i : i + step] = np.einsum("ij,ij->i", q[qi[i : i + step]], o[oi[i : i + step]])
    return out


def best(qid: np.ndarray, oid: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k most similar of each query; ties by the smaller neighbour id."""
    order = np.lexsort((oid, -sim, qid))
    q = qid[order]
    first = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - first < k]


def search(codes: V.OneBitCodes, o: np.ndarray, oid: np.ndarray, q: np.ndarray, qid: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k nearest of each query among the coded vectors; ``least`` drops lower similarities. A row is not its own neighbour."""
    est, width = codes.estimate(q.astype(np.float32))
    width += 1e-5
    est[qid[:, None] == oid[None, :]] = -9
    upper = est + width
    floor = np.full(len(q), -np.inf if least is None else least)
    if least is None and est.shape[1] > k:
        # the k-th largest lower bound: nothing whose upper bound is below it can be among the k
        lower = est - width
        floor = -np.partition(-lower, k - 1, axis=1)[:, k - 1]
    qi, oi = np.nonzero((upper >= floor[:, None]) & (est > -8))
    sim = exact(q, o, qi, oi)
    if least is not None:
        on = sim >= least
        qi, oi, sim = qi[on], oi[on], sim[on]
    keep = best(qid[qi], oid[oi], sim, k)
    return qid[qi[keep]], oid[oi[keep]], sim[keep]


def full(o: np.ndarray, oid: np.ndarray, q: np.ndarray, qid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k nearest of each query by all products."""
    s = q @ o.T
    s[qid[:, None] == oid[None, :]] = -9
    m = min(k, s.shape[1])
    floor = -np.partition(-s, m - 1, axis=1)[:, m - 1]
    qi, oi = np.nonzero((s >= floor[:, None]) & (s > -8))
    keep = best(qid[qi], oid[oi], s[qi, oi], k)
    return qid[qi[keep]], oid[oi[keep]], s[qi[keep], oi[keep]]


def search_close(signs: V.Signs, codes: tuple, o: np.ndarray, oid: np.ndarray, q: np.ndarray, qid: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k nearest of each query of similarity ``least`` or more: what the counts of differing bits leave possible is computed exactly."""
    mean, base = codes
    pairs = list(signs.close(signs.of(q.astype(np.float32) - mean), base, float(np.sqrt(max(0.0, 2 - 2 * least)))))
    qi, oi = (np.concatenate([p[i] for p in pairs]) for i in (0, 1)) if pairs else (np.empty(0, int), np.empty(0, int))
    qi, oi = qi[qid[qi] != oid[oi]], oi[qid[qi] != oid[oi]]
    sim = exact(q, o, qi, oi)
    on = sim >= least
    qi, oi, sim = qi[on], oi[on], sim[on]
    keep = best(qid[qi], oid[oi], sim, k)
    return qid[qi[keep]], oid[oi[keep]], sim[keep]


def _surplus_copies(data: DataFrame, id_col: str, vec_col: str, k: int, dim: int) -> tuple[DataFrame, DataFrame] | None:
    """Of more than k + 1 ids with the very same usable vector: (the ids beyond the k + 1 smallest, the k + 1 smallest).

    The smaller copies win every tie, so the others are never among anyone's k nearest, and have the k smallest copies as
    their own. That keeps a vector that a third of all rows share from being compared with itself over and over. Copies
    are found by 128 bits of hash; ranks are taken within 64 salts first, so no task sees a whole group.
    """
    # zero and NaN vectors repeat in every dirty table; most go here without a look at all elements
    some = F.exists(vec_col, lambda x: x != 0) & ~F.isnan(F.get(vec_col, F.lit(0)))
    v = data.where(F.col(id_col).isNotNull() & (F.size(vec_col) == dim) & some).select(F.col(id_col).alias("id"), vec_col, F.xxhash64(F.lit(1), vec_col).alias("h1"), F.xxhash64(F.lit(2), vec_col).alias("h2"))
    h = v.select("id", "h1", "h2")
    many = materialize(h.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("h1", "h2"), "copies")
    if many.isEmpty():
        return None
    many = materialize(v.join(many, ["h1", "h2"], "left_semi").where(is_usable(F.col(vec_col), dim)).select("h1", "h2").distinct(), "copies")
    if many.isEmpty():
        return None
    s = h.join(many, ["h1", "h2"]).distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    s = materialize(s.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2", "salt").orderBy("id"))), "ranks")
    keep = s.where(F.col("r") <= k + 1).withColumn("rank", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id")))
    keep = materialize(keep.where(F.col("rank") <= k + 1).select("id", "h1", "h2", "rank"), "kept")
    surplus = s.select("id", "h1", "h2").join(keep.select("id"), "id", "left_anti")
    return surplus, keep


def nearest_neighbours(df: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 128, least: float | None = None, probes: int = 4, slack: float = 0.4, beam: int = 8, margin: float | None = None) -> DataFrame:
    """``(query, neighbour, similarity)``: up to k most similar other vectors of every usable vector.

    Every vector is placed in its nearest cell and looked up in its ``probes`` nearest cells. With ``least`` only
    neighbours of at least that similarity are wanted: a further cell is probed only where the vector lies within
    ``slack`` times the distance such a neighbour can have from the border to it, and what first travels to the cells are
    one-bit codes alone (see :class:`Signs`). Only vectors that a code leaves a possible neighbour follow, and in the cell
    codes about their mean choose what is computed exactly. Without ``least`` all vectors travel, and the estimates of
    :class:`OneBitCodes` choose.

    Approximate: a neighbour is missed where its cell isn't probed, or where a bound that holds but for some standard
    deviations fails. Ties go to the smaller id; an empty table gives no rows. Cells are proportional to the table; one
    with many rows alike is cut into blocks of bounded size by id, and a task holds one block while queries stream by.
    """
    spark = df.sparkSession
    data = df.select(id_col, vec_col)
    copies = _surplus_copies(data, id_col, vec_col, k, dim)
    if copies:
        data = data.join(copies[0].select(F.col("id").alias(id_col)), id_col, "left_anti")
    turn = V.rotation(dim)
    b = spark.sparkContext.broadcast(turn)
    apart = None if least is None else float(np.sqrt(max(0.0, 2 - 2 * least)))
    signs = V.Signs(turn)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the coded rows of a cell, those that may have a neighbour there."""

        def close(state: list) -> pa.RecordBatch:
            _, ids, (cell, block), on, _ = state
            guests = [np.unique(g) for g in state[4]]
            out = np.concatenate([ids[on], *guests])
            kind = np.concatenate([np.zeros(int(on.sum()), np.int8), np.ones(len(out) - int(on.sum()), np.int8)])
            m = len(out)
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, cell, np.int64)), pa.array(np.full(m, block, np.int32)), pa.array(kind), pa.array(out)], names=["cell", "block", "kind", "id"])

        base, state = [], None
        for new, t in stream_groups(batches, ["cell", "block"]):
            if new:
                if base or state:
                    yield close(state or begin(base))
                base, state = [], None
            kind = np.asarray(t.column("kind"))
            cut = int(np.searchsorted(kind, 1))
            if cut:
                base.append(t.slice(0, cut))
            if cut < len(kind) and (base or state):
                state = state or begin(base)
                t = t.slice(cut)
                qid = np.asarray(t.column("id"))
                for a, c in signs.close(signs.load(t.column("vec").combine_chunks()), state[0], apart):
                    a, c = a[qid[a] != state[1][c]], c[qid[a] != state[1][c]]
                    state[3][c] = True
                    state[4].append(qid[np.unique(a)])
        if base or state:
            yield close(state or begin(base))

    def begin(base: list) -> list:
        t = pa.concat_tables(base).combine_chunks()
        ids, at = np.unique(np.asarray(t.column("id")), return_index=True)
        codes = tuple(v[at] for v in signs.load(t.column("vec").combine_chunks()))
        on = np.zeros(len(ids), bool)
        for a, c in signs.close(codes, codes, apart):
            on[a[a != c]] = True
        return [codes, ids, (int(t.column("cell")[0].as_py()), int(t.column("block")[0].as_py())), on, []]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = V.read_batch(batch, id_col, vec_col, dim)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(V.pack(x), pa.binary())], names=["id", "vec"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = b.value

        def flush(base: list, waiting: list) -> Iterator[pa.RecordBatch]:
            """The block against itself and against the queries read so far."""
            if not isinstance(base[0], pa.Table):
                codes, o, oid = base
            else:
                t = pa.concat_tables(base).combine_chunks()
                oid, at = np.unique(np.asarray(t.column("id")), return_index=True)
                o = V.unit(V.unpack(t.column("vec").combine_chunks(), dim)[at])
                mean = o.mean(0).astype(np.float32)
                codes = V.OneBitCodes(o.astype(np.float32), mean, turn) if least is None else (mean, signs.of(o.astype(np.float32) - mean))
                base[:] = [codes, o, oid]
                waiting.insert(0, None)
            for t in waiting:
                if t is None:
                    q, qid = o, oid
                else:
                    qid, at = np.unique(np.asarray(t.column("id")), return_index=True)
                    q = V.unit(V.unpack(t.column("vec").combine_chunks(), dim)[at])
                for i in range(0, len(q), 256):
                    if least is None:
                        a, n_, s = search(codes, o, oid, q[i : i + 256], qid[i : i + 256], k, None)
                    else:
                        a, n_, s = search_close(signs, codes, o, oid, q[i : i + 256], qid[i : i + 256], k, least)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n_), pa.array(s)], schema=ARROW)
            waiting.clear()

        base, waiting = [], []
        for new, t in stream_groups(batches, ["cell", "block"]):
            if new:
                if base:
                    yield from flush(base, waiting)
                base, waiting = [], []
            kind = np.asarray(t.column("kind"))
            cut = int(np.searchsorted(kind, 1))
            if cut:
                base.append(t.slice(0, cut))
            if cut < len(kind) and base:
                waiting.append(t.slice(cut))
                if sum(len(w) for w in waiting) >= 16_384:
                    yield from flush(base, waiting)
        if base:
            yield from flush(base, waiting)

    by = ["cell", "block"]
    if least is None:
        placed, n = V.place(data, id_col, vec_col, dim, probes, beam=beam, margin=margin)
        placed = placed.select(*by, "kind", "id", "vec").repartition(V.cell_tasks(n, probes, dim, partitions(spark)), *by)
    else:
        placed, n = V.place(data, id_col, vec_col, dim, probes, reach=slack * apart, codes=signs, beam=beam)
        coded = placed.select(*by, "kind", "id", "vec").repartition(V.cell_tasks(n, probes, dim // 8, partitions(spark)), *by).sortWithinPartitions(*by, "kind", "id")
        follow = coded.mapInArrow(choose, "cell bigint, block int, kind byte, id bigint")
        placed = follow.hint("shuffle_hash").join(data.mapInArrow(packed, "id bigint, vec binary"), "id").select(*by, "kind", "id", "vec").repartition(V.cell_tasks(n, 1, dim, partitions(spark)), *by)
    found = placed.sortWithinPartitions(*by, "kind", "id").mapInArrow(scan, OUT).dropDuplicates(["query", "neighbour"])
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "neighbour", "similarity")
    if copies:
        near = copies[1].where(F.col("rank") <= k).select("h1", "h2", F.col("id").alias("neighbour"))
        found = found.unionByName(copies[0].join(near, ["h1", "h2"]).select(F.col("id").alias("query"), "neighbour", F.lit(1.0).alias("similarity")))
    return found


def search_queries(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 10, dim: int = 128, block: int = 32_768, exact_scan: bool = False) -> DataFrame:
    """``(query, neighbour, similarity, rank)``: the k most similar vectors of each of a stated set of queries, by one scan.

    Every row is coded against the mean of the fitted sample and met by all queries, ``block`` of them at a time: a
    broadcast of at most ``block`` vectors, whatever the size of the query set. Bounds of the codes choose what is computed
    exactly, so a neighbour is missed only where its bound fails; with ``exact_scan`` all products are computed, in blocks,
    to measure what the codes miss. Ties by the smaller id.
    """
    spark = df.sparkSession
    data = df.select(id_col, vec_col)
    fit, _ = V.sample(data, id_col, vec_col, dim, rows=4_096)
    centre = fit.mean(0) if len(fit) else np.zeros(dim, np.float32)
    turn = V.rotation(dim)
    n_blocks = max(1, -(-queries.count() // block))
    out = None
    for i in range(n_blocks):
        part = queries.select(id_col, vec_col).where(F.pmod(F.xxhash64(id_col, F.lit(9)), F.lit(n_blocks)) == i).toArrow()
        got = [V.read_batch(x, id_col, vec_col, dim) for x in part.to_batches()]
        qid = np.concatenate([g[0] for g in got]) if got else np.empty(0, np.int64)
        qx = np.concatenate([g[1] for g in got]) if got else np.empty((0, dim), np.float32)
        qid, at = np.unique(qid, return_index=True)
        b = spark.sparkContext.broadcast((qid, V.unit(qx[at]) if len(qid) else qx, centre, turn))

        def scan(batches: Iterator[pa.RecordBatch], b=b) -> Iterator[pa.RecordBatch]:
            qid, q, centre, turn = b.value
            held: list = []
            best_q = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for batch in batches:
                ids, x = V.read_batch(batch, id_col, vec_col, dim)
                if not len(ids) or not len(qid):
                    continue
                ids, at = np.unique(ids, return_index=True)
                o = V.unit(x[at])
                codes = None if exact_scan else V.OneBitCodes(o.astype(np.float32), centre, turn)
                for j in range(0, len(q), 512):
                    held.append(search(codes, o, ids, q[j : j + 512], qid[j : j + 512], k, None) if codes else full(o, ids, q[j : j + 512], qid[j : j + 512], k))
                a, n_, s = (np.concatenate(z) for z in zip(best_q, *held))
                held = []
                _, first = np.unique(np.stack([a, n_]), axis=1, return_index=True) if len(a) else (None, np.empty(0, int))
                a, n_, s = a[first], n_[first], s[first]
                keep = best(a, n_, s, k)
                best_q = a[keep], n_[keep], s[keep]
            if len(best_q[0]):
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in best_q], schema=ARROW)

        found = data.mapInArrow(scan, OUT)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return out.dropDuplicates(["query", "neighbour"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def close_pairs(df: DataFrame, id_col: str, vec_col: str, k: int = 5, least: float = 0.97, **options) -> DataFrame:
    """``(image_a, image_b)``: pairs, smaller id first, of similarity ``least`` or more where one is among the k nearest of the other."""
    n = nearest_neighbours(df, id_col, vec_col, k=k, least=least, **options)
    return n.select(F.least("query", "neighbour").alias("image_a"), F.greatest("query", "neighbour").alias("image_b")).distinct()
