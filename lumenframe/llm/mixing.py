"""Mixing sources to target weights, with soft membership for records of unknown source."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.cuts import lowest
from lumenframe.runtime import materialize, release

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the split pattern of the byte-level vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FIT_ROWS = 6_000  # most labelled rows the classifier is fitted on
WIDTH = 1 << 13  # hashed features


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(r) for a, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(texts: list[str | None], path: str) -> np.ndarray:
    """Tokens of each text; 0 for null or empty."""
    e = _encoder(path)
    return np.array([len(e.encode_ordinary(t)) if t else 0 for t in texts], np.int64)


def features(text: str) -> np.ndarray:
    """Hashed lower-case words of a text, each once."""
    return np.unique(np.array([zlib.crc32(w.encode()) % WIDTH for w in re.findall(r"\w+", text.lower())], np.int64)) if text else np.empty(0, np.int64)


def _labelled(c: str):
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def fit_domains(bags: list[np.ndarray], y: np.ndarray, k: int, rounds: int = 40, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a softmax classifier of ``k`` sources over bags of hashed words."""
    w, bias = np.zeros((WIDTH, k)), np.zeros(k)
    if not len(y):
        return w, bias
    rows = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
    cols = np.concatenate(bags).astype(np.int64) if len(rows) else np.empty(0, np.int64)
    scale = 1 / np.sqrt(np.maximum([len(x) for x in bags], 1))
    order = np.argsort(cols, kind="stable")
    cuts = np.flatnonzero(np.diff(cols[order], prepend=-1))
    hot = np.eye(k)[y]
    m, v = np.zeros_like(w), np.zeros_like(w)
    bias = np.log((hot.sum(0) + 1) / (len(y) + k))
    starts = np.searchsorted(rows, np.arange(len(y)))
    some = np.flatnonzero(np.bincount(rows, minlength=len(y)))
    for t in range(1, rounds + 1):
        z = np.zeros((len(y), k))
        z[some] = np.add.reduceat(w[cols], starts[some], axis=0) if len(some) else 0
        z = z * scale[:, None] + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        e = (p - hot) / len(y)
        g = ridge * w
        if len(cuts):
            g[cols[order][cuts]] += np.add.reduceat((e * scale[:, None])[rows[order]], cuts, axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w, bias


def _classifier(d: DataFrame, domains: list[str], fit_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Fitted on about ``fit_rows`` labelled rows (twice that at most), chosen by a hash of the id; words are hashed on the executors."""
    d = d.where(F.col("source").isin(domains) & F.col("text").isNotNull()) if domains else d.limit(0)
    keep = min(1.0, fit_rows / max(d.count(), 1))
    rows = d.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(keep * (1 << 30))).select("source", "text").limit(2 * fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("source"), pa.array([features(t) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], names=["source", "bag"])

    got = rows.mapInArrow(run, "source string, bag array<bigint>").toPandas()
    index = {s: i for i, s in enumerate(domains)}
    return fit_domains(list(got["bag"]), got["source"].map(index).to_numpy(int), len(domains))


def members(documents: DataFrame, domains: list[str], text: str = "text", source: str = "source", doc_id: str = "doc_id", tokenizer: str = TOKENIZER, soft: bool = True, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, source, tokens, member)``: the tokens of every document and its membership of each domain.

    A document with a source belongs to it alone (to none of the domains, if it isn't one of them); without a source
    (null or blank) it has the classifier's posteriors, to four digits. Not ``soft``: documents without a source are left
    out, and nothing is fitted. The classifier is fitted on about ``fit_rows`` labelled rows.
    """
    spark = documents.sparkSession
    d = documents.select(F.col(doc_id).alias("doc_id"), F.when(_labelled(source), F.trim(source)).alias("source"), F.col(text).alias("text"))
    if not soft:
        d = d.where("source IS NOT NULL")
    b = spark.sparkContext.broadcast((domains, *(_classifier(d, domains, fit_rows) if soft else (None, None))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        domains, w, bias = b.value
        index = {s: i for i, s in enumerate(domains)}
        for batch in batches:
            texts, sources = batch.column("text").to_pylist(), batch.column("source").to_pylist()
            out = np.zeros((len(texts), len(domains)))
            for i, (t, s) in enumerate(zip(texts, sources)):
                if s is not None:
                    if s in index:
                        out[i, index[s]] = 1
                elif domains:
                    f = features(t or "")
                    z = w[f].sum(0) / np.sqrt(max(len(f), 1)) + bias
                    p = np.exp(z - z.max())
                    out[i] = np.round(p / p.sum(), 4)
            off = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(domains))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n_tokens(texts, tokenizer)), pa.ListArray.from_arrays(off, pa.array(out.ravel()))], names=["doc_id", "source", "tokens", "member"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, source string, tokens bigint, member array<double>")


def rates(p: np.ndarray, cap: np.ndarray, misses: list[np.ndarray]) -> np.ndarray:
    """Rates of rows with memberships ``p`` after the gradient steps: each adds what is missing, kept between 0 and the cap.

    The cap is that of a row's likeliest domain. A rate depends on the row and the steps so far alone, so it is worked out
    anew where the row is, and nothing is kept or sent between the steps but one number a domain.
    """
    most = np.where(p.any(1), cap[p.argmax(1)], 0.0) if p.shape[1] else np.zeros(len(p))
    r = np.zeros(len(p))
    for m in misses:
        r = np.clip(r - p @ m, 0, most)
    return r


def _matrix(col: pa.Array, k: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, k) if k else np.zeros((len(col), 0))


def fit_rates(classes: DataFrame, need: np.ndarray, have: np.ndarray, cap: np.ndarray, rounds: int = 60, tol: float = 1e-6) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps of projected gradient least squares, and the expected totals they reach.

    The sum over domains of (drawn - need)^2 / have is minimised over rates 0 <= r <= cap. With rows weighted by their
    tokens the gradient of a row is its membership times the relative misses, and a step of 1 never overshoots, since
    memberships add up to at most 1. ``classes`` (member, tokens) stays distributed: a round sums a number per domain on
    the executors. Ends when no total moves by more than ``tol`` of its need.
    """
    k, misses, total = len(need), [], np.zeros(len(need))
    for _ in range(rounds):
        misses.append((total - need) / have)
        steps = list(misses)

        def sums(batches: Iterator[pa.RecordBatch], steps=steps) -> Iterator[pa.RecordBatch]:
            s = np.zeros(k)
            for b in batches:
                p = _matrix(b.column("member"), k)
                s += (rates(p, cap, steps) * np.asarray(b.column("tokens"), float)) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(s)], names=["i", "s"])

        new = np.zeros(k)
        for r in classes.mapInArrow(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
            new[r["i"]] = r["s"]
        still = np.abs(new - total).max(initial=0) <= tol * max(need.max(initial=0), 1.0)
        total = new
        if still:
            break
    return misses, total


def mix(documents: DataFrame, targets: DataFrame, soft: bool = False, tokenizer: str = TOKENIZER, seed: int = 41, total: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(plan, report)``.

    plan ``(doc_id, source, tokens, copies)``: how often each drawn document is used, at most the ``max_repeats`` of its
    (likeliest) source; report ``(source, token_share, tokens, need, passes, short, drawn, actual_share, alone_passes, alone_short)``,
    a row a target.

    A source needs ``token_share`` of ``total``: the tokens of all documents with a source, another number, or
    "reachable": the largest total, up to the first, at which no source runs out (sources without any tokens aside).
    With ``soft`` documents without a source are drawn by their posteriors as well, and what is drawn is credited by
    membership; else they aren't read. Rates come from :func:`fit_rates`. A rate's whole part is copies for all; its
    fraction goes, per likeliest source, to the documents of the smallest hash over fraction, until the tokens wanted are
    reached to one document. ``passes`` is the rate of the source's own documents rounded up (``max_repeats`` where a source in
    need has no tokens); ``short`` tells that its documents must be repeated or do not suffice. Where ``soft`` documents help,
    ``alone_passes`` and ``alone_short`` say the same of its own documents without them: a second run of the gradient over the
    documents with a source. Documents of sources that
    are no targets aren't drawn. Rows repeated under one id, or without one, are drawn each by itself. Targets are few by
    nature; a null share or source is ignored.
    """
    spark = documents.sparkSession
    t = targets.where("source IS NOT NULL AND token_share IS NOT NULL").groupBy("source").agg(F.sum("token_share").alias("token_share"), F.max("max_repeats").alias("max_repeats")).orderBy("source").toPandas()
    domains, k = t["source"].tolist(), len(t)
    share, cap = t["token_share"].to_numpy(float), t["max_repeats"].fillna(1).to_numpy(float)
    m = materialize(members(documents, domains, tokenizer=tokenizer, soft=soft), "members")
    by = {r[0]: int(r[1] or 0) for r in m.groupBy(F.when(F.col("source").isin(domains), F.col("source")).otherwise(F.when(F.col("source").isNotNull(), "")).alias("s")).agg(F.sum("tokens")).collect()} if k else {}
    own = np.array([by.get(s, 0) for s in domains], float)
    # equal memberships share a rate: labelled documents make one row a source, however many they are
    classes = materialize(m.groupBy("member").agg(F.sum("tokens").alias("tokens")), "classes")
    have = np.zeros(k)
    if k:
        r = classes.agg(*[F.sum(F.col("member")[i] * F.col("tokens")) for i in range(k)]).first()
        have = np.array([x or 0.0 for x in r])
    whole = float(sum(v for s, v in by.items() if s is not None))
    if total == "reachable":
        on = (have > 0) & (share > 0)
        whole = min([whole, *(cap[on] * have[on] / share[on])])
    elif total is not None:
        whole = float(total)
    need = share * whole
    misses, reached = fit_rates(classes, need, np.maximum(have, 1e-9), cap)
    release(classes)
    fits = [(misses, reached)] * 2
    if soft:
        alone = materialize(m.where("source IS NOT NULL").groupBy("member").agg(F.sum("tokens").alias("tokens")), "alone")
        fits[1] = fit_rates(alone, need, np.maximum(own, 1e-9), cap)
        release(alone)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _matrix(b.column("member"), k)
            r = rates(p, cap, misses)
            base = np.floor(r + 1e-9)
            dom = np.where(p.any(1), p.argmax(1), -1) if k else np.full(len(p), -1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "tokens", "member")), pa.array(dom, pa.int32()), pa.array(base, pa.int32()), pa.array(np.maximum(r - base, 0.0))], names=["doc_id", "source", "tokens", "member", "dom", "base", "frac"])

    kind = m.schema["doc_id"].dataType.simpleString()
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rated = m.mapInArrow(rate, f"doc_id {kind}, source string, tokens bigint, member array<double>, dom int, base int, frac double").where("dom >= 0 AND (base > 0 OR frac > 1e-9)")
    # rows are known by a number of their own: ids may repeat or be null
    rated = materialize(rated.withColumn("turn", F.when(F.col("frac") > 1e-9, u / F.col("frac"))).withColumn("row", F.monotonically_increasing_id()), "rated")
    part = rated.where("turn IS NOT NULL")
    want = {r[0]: r[1] for r in part.groupBy("dom").agg(F.sum(F.col("frac") * F.col("tokens"))).collect()}
    extra = lowest(part, want, "turn", "row", "tokens", "dom", nearest=True).withColumn("base", F.col("base") + 1)
    rest = rated.where("base > 0").join(extra.select("row"), "row", "left_anti") if want else rated.where("base > 0")
    plan = materialize(rest.select("doc_id", "source", "tokens", F.col("base").alias("copies"), "member").unionByName(extra.select("doc_id", "source", "tokens", F.col("base").alias("copies"), "member")), "plan")
    release(m)
    release(rated)
    got = np.zeros(k)
    if k:
        r = plan.agg(*[F.sum(F.col("member")[i] * F.col("tokens") * F.col("copies")) for i in range(k)]).first()
        got = np.array([x or 0.0 for x in r])
    fitted = [(rates(np.eye(k), cap, steps), to) for steps, to in fits]
    rows = []
    for i, s in enumerate(domains):
        short = [bool(need[i] > 0 and (own[i] == 0 or rate[i] > 1 + 1e-9 or to[i] < need[i] * (1 - 1e-6))) for rate, to in fitted]
        passes = [(int(cap[i]) if not own[i] else max(1, int(np.ceil(rate[i] - 1e-9)))) if need[i] > 0 else 0 for rate, _ in fitted]
        rows.append((s, float(share[i]), int(own[i]), float(need[i]), passes[0], short[0], int(round(got[i])), round(float(got[i] / max(got.sum(), 1.0)), 6), passes[1], short[1]))
    report = spark.createDataFrame(rows, "source string, token_share double, tokens bigint, need double, passes int, short boolean, drawn bigint, actual_share double, alone_passes int, alone_short boolean")
    return plan.drop("member"), report
