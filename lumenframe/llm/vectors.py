"""Vector tables: reading usable vectors, a fitted cell index, and one-bit codes.

Usable means: the stated number of finite values, not all zero. Everything else (null, wrong length, null or non-finite
elements, zero vectors) and rows with a null id are left out by every operator here. Rows repeated under one id count
once. Similarity is the cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.blocks import stream_groups
from lumenframe.runtime import materialize, partitions

FIT_ROWS = 32_768  # most rows the top centres are fitted on
CELL_ROWS = 400  # rows wanted per cell
CELL_FIT = 24  # rows a cell's centre is fitted on
BLOCK_ROWS = 4_096  # rows of a cell that one task holds at a time
SPREAD_MB = 64  # most megabytes of centres that are broadcast; beyond, rows travel to the centres
SALT_ROWS = 200_000  # rows of a top cell that travel to one task


def read_batch(batch: pa.RecordBatch, id_col: str, vec_col: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float32 vectors of the usable rows."""
    vec, ids = batch.column(vec_col), batch.column(id_col)
    ok = pc.fill_null(pc.equal(pc.list_value_length(vec), dim), False)
    ok = pc.and_(ok, pc.is_valid(ids))
    vec, ids = vec.filter(ok), ids.filter(ok)
    flat = vec.flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return np.asarray(ids.to_numpy(zero_copy_only=False), np.int64)[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow for huge values
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pack(x: np.ndarray) -> list[bytes]:
    """Lossless bytes of float32 rows: half precision where that gives back every value, else single."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    same = (half.astype(np.float32) == x).all(1)
    return [h.tobytes() if s else f.tobytes() for h, f, s in zip(half, np.ascontiguousarray(x), same)]


def unpack(col: pa.Array, dim: int) -> np.ndarray:
    size = np.asarray(pc.binary_length(col))
    if len(size) and (size == 2 * dim).all() and col.null_count == 0:
        buf = col.buffers()
        off = np.frombuffer(buf[1], np.int32 if pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1]
        return np.frombuffer(buf[2], np.uint8)[off[0] : off[-1]].view(np.float16).reshape(-1, dim).astype(np.float32)
    return np.stack([np.frombuffer(v, np.float16 if len(v) == 2 * dim else np.float32).astype(np.float32) for v in col.to_pylist()]) if len(size) else np.empty((0, dim), np.float32)


def sample(df: DataFrame, id_col: str, vec_col: str, dim: int, rows: int = FIT_ROWS, salt: int = 5) -> tuple[np.ndarray, int]:
    """At most about ``rows`` usable unit vectors, chosen by a hash of the id, and the number of rows of the table."""
    n = df.count()
    keep = min(1.0, rows / max(n, 1))
    s = df.where(F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(1 << 30)) < int(keep * (1 << 30))).select(id_col, vec_col).limit(2 * rows)
    parts = [read_batch(b, id_col, vec_col, dim) for b in s.toArrow().to_batches()]
    x = np.concatenate([p[1] for p in parts]) if parts else np.empty((0, dim), np.float32)
    ids = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
    x = x[np.argsort(ids, kind="stable")]
    return (unit(x).astype(np.float32) if len(x) else x), n


def kmeans(x: np.ndarray, k: int, rounds: int = 4, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres by spherical k-means, and how many rows each has."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = nearest(x, c, 1)[:, 0]
        order = np.argsort(a, kind="stable")
        cuts = np.searchsorted(a[order], np.arange(k))
        full = np.bincount(a, minlength=k) > 0
        sums = np.zeros_like(c)
        sums[full] = np.add.reduceat(x[order], cuts[full], axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c).astype(np.float32)
    return c, np.bincount(nearest(x, c, 1)[:, 0], minlength=k)


class Centres:
    """Cell centres in two levels: a row looks for its cells under the ``beam`` top centres nearest to it.

    About the square root of the number of cells is on top, so that finding a cell costs as much as that, however large the
    table. ``blocks`` is how many pieces of BLOCK_ROWS rows a cell is cut into; it is 1 but where many rows are alike.
    """

    def __init__(self, top: np.ndarray, owner: np.ndarray, sub: np.ndarray, blocks: np.ndarray, number: np.ndarray | None = None):
        order = np.argsort(owner, kind="stable")
        self.top, self.sub, self.blocks = top, sub[order], blocks[order]
        self.start = np.searchsorted(owner[order], np.arange(len(top) + 1))
        self.number = order if number is None else number[order]

    def cells(self, u: np.ndarray, probes: int, beam: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the ``probes`` nearest cells of each row, best first, and similarities; -1 where there are fewer."""
        step = max(256, 2_000_000 // (beam * probes))  # bounds the arrays below
        if len(u) > step:
            parts = [self.cells(u[i : i + step], probes, beam) for i in range(0, len(u), step)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        near = nearest(u, self.top, beam)
        sims = np.full((len(u), near.shape[1], probes), -9, np.float32)
        at = np.full((len(u), near.shape[1], probes), -1, np.int64)
        flat = near.ravel()
        order = np.argsort(flat, kind="stable")
        ends = np.searchsorted(flat[order], np.arange(len(self.top) + 1))
        for t in np.flatnonzero(np.diff(ends)):
            lo, hi = self.start[t], self.start[t + 1]
            if lo == hi:
                continue
            mine = order[ends[t] : ends[t + 1]]
            row, slot = mine // near.shape[1], mine % near.shape[1]
            s = u[row] @ self.sub[lo:hi].T
            m = min(probes, hi - lo)
            best = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < hi - lo else np.tile(np.arange(m), (len(s), 1))
            sims[row, slot, :m] = np.take_along_axis(s, best, 1)
            at[row, slot, :m] = best + lo
        sims, at = sims.reshape(len(u), -1), at.reshape(len(u), -1)
        best = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(at, best, 1), np.take_along_axis(sims, best, 1)


CENTRE = "top int, sub int, rows bigint, centre binary"


def fit_centres(data: DataFrame, id_col: str, vec_col: str, dim: int, n: int, x: np.ndarray) -> tuple[np.ndarray, DataFrame, float]:
    """``(top centres, table of cells (top, sub, rows, centre), share of rows fitted on)`` for a table of ``n`` rows.

    n / CELL_ROWS cells. The top centres are fitted on the sample ``x``; those below each of them on the executors, on
    CELL_FIT rows a cell chosen by a hash, by one task a top centre (at most eight times the usual number of its rows).
    """
    want = max(1, n // CELL_ROWS)
    k = int(min(np.ceil(np.sqrt(want)), max(1, len(x) // 8)))
    top = kmeans(x, k)[0] if len(x) else np.zeros((1, dim), np.float32)
    share = min(1.0, CELL_FIT * want / max(n, 1))
    most = int(8 * CELL_FIT * np.ceil(want / k))
    spark = data.sparkSession
    b = spark.sparkContext.broadcast(top)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = read_batch(batch, id_col, vec_col, dim)
            if len(ids):
                t = nearest(unit(x).astype(np.float32), b.value, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(ids), pa.array(pack(x), pa.binary())], names=["top", "id", "vec"])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.Table]) -> pa.RecordBatch:
            t = pa.concat_tables(held).combine_chunks()
            x = unit(unpack(t.column("vec").combine_chunks(), dim)).astype(np.float32)
            c, m = kmeans(x, max(1, len(x) // CELL_FIT))
            c, m = c[m > 0], m[m > 0]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), t.column("top")[0].as_py(), np.int32)), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(m.astype(np.int64)), pa.array([v.tobytes() for v in c.astype(np.float16)], pa.binary())], names=["top", "sub", "rows", "centre"])

        held, rows = [], 0
        for new, t in stream_groups(batches, ["top"]):
            if new and held:
                yield done(held)
            if new:
                held, rows = [], 0
            t = t.slice(0, max(0, most - rows))
            held.append(t)
            rows += t.num_rows
        if held:
            yield done(held)

    s = data.where(F.pmod(F.xxhash64(id_col, F.lit(6)), F.lit(1 << 30)) < int(share * (1 << 30))).select(id_col, vec_col)
    s = s.mapInArrow(chosen, "top int, id bigint, vec binary").repartition(partitions(spark), "top").sortWithinPartitions("top", F.xxhash64("id"))
    return top, materialize(s.mapInArrow(below, CENTRE), "cells"), share


def _centres(t: pa.Table, top: np.ndarray, dim: int, share: float) -> Centres:
    own, sub = np.asarray(t.column("top"), np.int64), np.asarray(t.column("sub"), np.int64)
    c = unpack(t.column("centre").combine_chunks(), dim) if t.num_rows else np.zeros((0, dim), np.float32)
    blocks = np.maximum(1, np.ceil(1.2 * np.asarray(t.column("rows"), float) / share / BLOCK_ROWS)).astype(np.int64)
    lone = np.setdiff1d(np.arange(len(top)), own)  # a top centre without cells is one itself
    own, sub = np.append(own, lone), np.append(sub, np.zeros(len(lone), np.int64))
    return Centres(top, own, np.concatenate([c, top[lone].astype(np.float16).astype(np.float32)]), np.append(blocks, np.ones(len(lone), np.int64)), own << 32 | sub)


def _slices(probes: int, *columns) -> Iterator[tuple]:
    """Pieces of equally long columns, so that a piece in all its cells stays small; None stays None."""
    step = max(256, 200_000 // probes)
    for i in range(0, len(columns[0]), step):
        yield tuple(None if c is None else c[i : i + step] for c in columns)


PLACE = "cell bigint, block int, kind byte, id bigint, tag bigint, vec binary"
PLACE_ARROW = pa.schema([("cell", pa.int64()), ("block", pa.int32()), ("kind", pa.int8()), ("id", pa.int64()), ("tag", pa.int64()), ("vec", pa.binary())])


def _rows(c: Centres, ids: np.ndarray, x: np.ndarray, tag: np.ndarray, probe: np.ndarray, home: np.ndarray, probes: int, beam: int, reach: float | None, codes, margin: float | None = None) -> pa.RecordBatch:
    """Rows in their cells: kind 0 in their own, kind 1 where they are looked up (``probe``); not ``home``: guests, which
    have no cell of their own here."""
    u = unit(x).astype(np.float32)
    near, sims = c.cells(u, probes, beam)
    own = near[:, 0]
    block = (mix(ids) % c.blocks[own].astype(np.uint64)).astype(np.int64)
    at = np.flatnonzero(home)
    cells, blks, kinds, rows = [own[at]], [block[at]], [np.zeros(len(at), np.int8)], [at]
    for j in range(near.shape[1]):
        go = np.flatnonzero(probe & (near[:, j] >= 0))
        if j and margin is not None:
            go = go[sims[go, j] >= sims[go, 0] - margin]
        cell = near[go, j]
        if j and reach is not None:
            d = c.sub[own[go]] - c.sub[cell]
            gap = np.einsum("ij,ij->i", u[go], d) / np.maximum(np.linalg.norm(d, axis=1), 1e-9)
            go, cell = go[gap <= reach], cell[gap <= reach]
        for extra in range(int(c.blocks[cell].max(initial=0))):
            sel = (c.blocks[cell] > extra) & ((cell != own[go]) | (block[go] != extra) | ~home[go])
            cells.append(cell[sel])
            blks.append(np.full(int(sel.sum()), extra))
            kinds.append(np.ones(int(sel.sum()), np.int8))
            rows.append(go[sel])
    cells, rows = np.concatenate(cells), np.concatenate(rows)
    if codes is None:
        packed = np.array(pack(x), dtype=object)[rows].tolist()
    else:
        packed = codes(u[rows] - c.sub[cells])
    no = np.zeros(len(ids), bool) if tag is None else tag < 0
    tags = np.zeros(len(ids), np.int64) if tag is None else tag
    return pa.RecordBatch.from_arrays([pa.array(c.number[cells]), pa.array(np.concatenate(blks).astype(np.int32)), pa.array(np.concatenate(kinds)), pa.array(ids[rows]), pa.array(tags[rows], mask=no[rows]), pa.array(packed, pa.binary())], schema=PLACE_ARROW)


def place(data: DataFrame, id_col: str, vec_col: str, dim: int, probes: int, prepare=None, reach: float | None = None, codes=None, beam: int = 8, margin: float | None = None) -> tuple[DataFrame, int]:
    """Rows spread over the cells of a fitted index, ready to be met there, and the number of rows of the table.

    ``prepare`` turns a batch iterator into ``(ids, vectors, tag, probe)`` or finished record batches of PLACE, which pass
    through; by default every usable row probes. Each row is kind 0 in its own cell and kind 1 in the ``probes`` nearest
    (a further one only where the row lies within ``reach`` of the border to it, and where its centre is at most ``margin``
    less similar than the nearest). Sent along are the vectors, or what
    ``codes`` makes of the residuals. While all centres have SPREAD_MB or less they are broadcast; beyond, a row travels
    to its top centre (and as a guest to others whose border is within reach), and the cells below are found there, so
    that nothing that grows with the table is broadcast.
    """
    spark = data.sparkSession
    x, n = sample(data, id_col, vec_col, dim)
    top, cells, share = fit_centres(data, id_col, vec_col, dim, n, x)

    def usable(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, x = read_batch(batch, id_col, vec_col, dim)
            if len(ids):
                yield ids, x, None, np.ones(len(ids), bool)

    prepare = prepare or usable
    m = cells.count()
    if m * dim * 2 <= SPREAD_MB * 1e6:
        b = spark.sparkContext.broadcast(_centres(cells.toArrow(), top, dim, share))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for got in prepare(batches):
                if isinstance(got, pa.RecordBatch):
                    yield got
                    continue
                for part in _slices(probes, *got):
                    yield _rows(b.value, *part, np.ones(len(part[0]), bool), probes, beam, reach, codes, margin)

        return data.mapInArrow(whole, PLACE), n

    salts = np.maximum(1, np.ceil(np.bincount(nearest(x, top, 1)[:, 0], minlength=len(top)) / max(len(x), 1) * n / SALT_ROWS)).astype(np.int64)
    t = spark.sparkContext.broadcast((top, salts))
    far = np.sqrt(2.0) if reach is None else reach

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind -1 passes through; 0 home and 1 guest rows, plus 2 where the row doesn't probe. cell is the top centre."""
        top, salts = t.value
        for got in prepare(batches):
            if isinstance(got, pa.RecordBatch):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(got.num_rows, -1, np.int64)), pa.array(np.zeros(got.num_rows, np.int32)), pa.array(np.full(got.num_rows, -1, np.int8)), got.column("id"), got.column("tag"), pa.array([k.as_py().to_bytes(1, "little", signed=True) for k in got.column("kind")], pa.binary())], schema=PLACE_ARROW)
                continue
            ids, x, tag, probe = got
            u = unit(x).astype(np.float32)
            near = nearest(u, top, beam)
            own = near[:, 0]
            packed = np.array(pack(x), dtype=object)
            tags = np.zeros(len(ids), np.int64) if tag is None else tag
            for j in range(near.shape[1]):
                go = np.arange(len(ids)) if not j else np.flatnonzero(probe)
                if j:
                    d = top[own[go]] - top[near[go, j]]
                    go = go[np.einsum("ij,ij->i", u[go], d) / np.maximum(np.linalg.norm(d, axis=1), 1e-9) <= far]
                to = near[go, j]
                kind = np.where(probe[go], 1 if j else 0, 2).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array((mix(ids[go], 7) % salts[to].astype(np.uint64)).astype(np.int32)), pa.array(kind), pa.array(ids[go]), pa.array(tags[go]), pa.array(packed[go].tolist(), pa.binary())], schema=PLACE_ARROW)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, _ = t.value
        here, parts = None, []
        for new, rows in stream_groups(batches, ["cell", "block"]):
            at = int(rows.column("cell")[0].as_py())
            kind = np.asarray(rows.column("kind"))
            if at < 0:
                vec = rows.column("vec").to_pylist()
                k = np.array([int.from_bytes(v, "little", signed=True) for v in vec], np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(-k.astype(np.int64)), pa.array(np.zeros(len(k), np.int32)), pa.array(k), rows.column("id").combine_chunks(), rows.column("tag").combine_chunks(), pa.nulls(len(k), pa.binary())], schema=PLACE_ARROW)
                continue
            if new:
                here, parts = None, []
            cut = int(np.searchsorted(kind, 0))
            if cut:
                parts.append(rows.slice(0, cut))
            rows, kind = rows.slice(cut), kind[cut:]
            if not len(kind):
                continue
            if here is None:
                c = pa.concat_tables(parts).combine_chunks() if parts else None
                own = pa.table({"top": pa.array(np.zeros(0 if c is None else c.num_rows, np.int64)), "sub": c.column("id") if c else pa.array([], pa.int64()), "rows": c.column("tag") if c else pa.array([], pa.int64()), "centre": c.column("vec") if c else pa.array([], pa.binary())})
                here = _centres(own, top[at : at + 1], dim, share)
                here.number = here.number | (at << 32)
            vec = rows.column("vec").combine_chunks()
            for part in _slices(probes, np.asarray(rows.column("id")), unpack(vec, dim), np.asarray(rows.column("tag")), kind < 2, kind != 1):
                yield _rows(here, *part, probes, 1, reach, codes, margin)

    lead = cells.select(F.col("top").cast("bigint").alias("cell"), F.explode(F.sequence(F.lit(0), F.element_at(F.lit(salts.tolist()), F.col("top") + 1).cast("int") - 1)).alias("block"), F.lit(-1).cast("byte").alias("kind"), F.col("sub").cast("bigint").alias("id"), F.col("rows").alias("tag"), F.col("centre").alias("vec"))
    both = data.mapInArrow(travel, PLACE).unionByName(lead)
    return both.repartition(cell_tasks(n, 2, dim, partitions(spark)), "cell", "block").sortWithinPartitions("cell", "block", "kind", "id").mapInArrow(find, PLACE), n


def nearest(x: np.ndarray, c: np.ndarray, m: int, step: int = 4_096) -> np.ndarray:
    """Indices of the ``m`` centres most similar to each row, best first."""
    out = np.empty((len(x), min(m, len(c))), np.int64)
    for i in range(0, len(x), step):
        s = x[i : i + step] @ c.T
        if m == 1:
            out[i : i + step, 0] = s.argmax(1)
        else:
            top = np.argpartition(-s, min(m, len(c)) - 1, axis=1)[:, :m] if m < len(c) else np.tile(np.arange(len(c)), (len(s), 1))
            out[i : i + step] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), 1, kind="stable"), 1)
    return out


def cell_tasks(n: int, copies: float, dim: int, least: int, mb: int = 12) -> int:
    """Tasks for ``n`` rows placed in ``copies`` cells each, so that one reads about ``mb`` MB, however large the table."""
    return max(least, int(np.ceil(n * copies * (2 * dim + 50) / (mb * 1e6))))


def mix(ids: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit mixing hash of whole numbers."""
    z = ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Signs:
    """One-bit codes of rotated residuals: what travels to a cell in place of a vector (the bits and the length).

    EPS standard deviations: of pairs that lie just within the distance asked for, under 1 % are missed, of closer ones fewer.
    """

    EPS = 2.4

    def __init__(self, turn: np.ndarray):
        self.turn, self.dim = turn, len(turn)
        self.bytes = -(-self.dim // 64) * 8

    def __call__(self, residuals: np.ndarray) -> list[bytes]:
        r = np.linalg.norm(residuals, axis=1).astype(np.float32)
        bits = np.zeros((len(r), self.bytes), np.uint8)
        bits[:, : -(-self.dim // 8)] = np.packbits(residuals @ self.turn.T > 0, axis=1)
        whole = np.concatenate([bits, r[:, None].view(np.uint8)], axis=1)
        step = whole.shape[1]
        flat = whole.tobytes()
        return [flat[i : i + step] for i in range(0, len(flat), step)]

    def of(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.load(pa.array(self(residuals), pa.binary()))

    def load(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits as 64-bit words, and lengths."""
        buf = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), self.bytes + 4)
        return np.ascontiguousarray(buf[:, : self.bytes]).view(np.uint64), np.ascontiguousarray(buf[:, self.bytes :]).view(np.float32)[:, 0].astype(float)

    def most(self, angle: np.ndarray) -> np.ndarray:
        """Most differing bits at an angle: a bit differs with probability angle / pi; EPS standard deviations above the mean."""
        p = angle / np.pi
        return np.minimum(self.dim, np.floor(self.dim * p + self.EPS * np.sqrt(self.dim * p * (1 - p)) + 1))

    def close(self, q: tuple, o: tuple, apart: float, step: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that can lie within ``apart`` of each other, a chunk of queries at a time: differing bits are counted, then the
        triangle of the two residuals tells the angle they may have."""
        (qb, qr), (ob, orr) = q, o

        def wide(r):
            return np.where(r > apart, self.most(np.arcsin(np.minimum(1.0, apart / np.maximum(r, 1e-12)))), self.dim)

        qm, om = wide(qr).astype(np.uint16), wide(orr).astype(np.uint16)
        for i in range(0, len(qb), step):
            h = np.zeros((min(step, len(qb) - i), len(ob)), np.uint16 if self.dim > 255 else np.uint8)
            for w in range(qb.shape[1]):
                h += np.bitwise_count(qb[i : i + step, w, None] ^ ob[None, :, w])
            a, c = np.nonzero(h <= qm[i : i + step, None].astype(h.dtype))
            n = h[a, c]
            on = n <= om[c]
            a, c, n = a[on] + i, c[on], n[on]
            cos = (qr[a] ** 2 + orr[c] ** 2 - apart * apart) / np.maximum(2 * qr[a] * orr[c], 1e-12)
            on = (np.abs(qr[a] - orr[c]) <= apart + 1e-6) & (n <= self.most(np.arccos(np.clip(cos, -1, 1))))
            yield a[on], c[on]


class OneBitCodes:
    """Randomly rotated one-bit codes of vectors relative to a centre.

    A vector o = c + r u (u of length 1) is kept as the packed signs of the rotated u, with the scalars r, o.c and
    f = <code, u>. A query's rotated residual is rounded to four bits, so its product with a code is four counts of common
    bits; u.q is estimated as <code, rotated q> / f. But for a small chance (EPS standard deviations) it is within
    ``EPS |q| sqrt((1 - f^2) / (f^2 (D - 1)))`` and the rounding. Only candidates whose bound can still matter are computed
    exactly.
    """

    EPS, PLANES = 2.4, 4

    def __init__(self, o: np.ndarray, centre: np.ndarray, rotation: np.ndarray):
        d = o.shape[1]
        u = o - centre
        self.r = np.linalg.norm(u, axis=1)
        u = (u / np.maximum(self.r, 1e-12)[:, None]) @ rotation.T
        self.bits = self._pack(u > 0)
        self.ones = np.bitwise_count(self.bits).sum(1).astype(np.float32)
        self.f = np.maximum(np.abs(u).sum(1) / np.sqrt(d), 1e-6)
        self.uc = o @ centre - centre @ centre
        self.centre, self.rotation, self.d = centre, rotation, d
        self.width = self.EPS * self.r * np.sqrt(np.maximum(1 - self.f**2, 0) / (self.f**2 * (d - 1)))
        self.scale = (self.r / (self.f * np.sqrt(d))).astype(np.float32)

    @staticmethod
    def _pack(on: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(on), -(-on.shape[1] // 64) * 8), np.uint8)
        bits[:, : -(-on.shape[1] // 8)] = np.packbits(on, axis=1)
        return bits.view(np.uint64)

    def estimate(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated similarities (queries x vectors), and their half widths as a matrix."""
        p = q - self.centre
        y = p @ self.rotation.T
        lo = y.min(1, keepdims=True)
        unit_ = np.maximum((y.max(1, keepdims=True) - lo) / (2**self.PLANES - 1), 1e-12)
        level = np.rint((y - lo) / unit_).astype(np.uint8)
        common = np.zeros((len(q), len(self.bits)), np.uint16)
        for k in range(self.PLANES):
            plane = self._pack((level >> k) & 1 > 0)
            n = np.bitwise_count(plane[:, 0, None] & self.bits[None, :, 0])
            for w in range(1, plane.shape[1]):  # beyond 255 bits a byte may be too small
                n = (n if self.d < 256 else n.astype(np.uint16)) + np.bitwise_count(plane[:, w, None] & self.bits[None, :, w])
            common += n.astype(np.uint16) << np.uint16(k)
        est = common.astype(np.float32)
        est *= 2 * unit_.astype(np.float32)
        est += (2 * lo).astype(np.float32) * self.ones[None, :] - (level.sum(1, keepdims=True) * unit_ + self.d * lo).astype(np.float32)
        est *= self.scale
        est += self.uc.astype(np.float32)
        est += (q @ self.centre)[:, None]
        size = np.linalg.norm(p, axis=1)
        width = size[:, None] * self.width[None, :] + self.EPS * unit_ / np.sqrt(12) * np.sqrt(self.d) * self.scale[None, :]
        return est, width.astype(np.float32)


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)
