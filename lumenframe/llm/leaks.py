"""Evaluation texts that leaked into training documents.

Both sides are brought to plain words. N-grams of the test items are seeds: where several fall together in a document, its
part meets the items by the seeds that are rarest in the corpus, and a local alignment with a budget of edits decides.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.runtime import materialize, partitions

WORDS, CHARS = 16, 30  # least stretch, in words and in characters of scripts without spaces
EDIT = 8  # one unit in EDIT may differ
SEED_WORDS, SEED_CHARS = 5, 6  # the longest runs that every allowed stretch is sure to hold unchanged
# by words and by characters: L units with e <= L / EDIT edits keep at least L - n + 1 - e n seeds of n units at different
# places, over all L from the least on two of words (L = 16, e = 2) and three of characters (L = 32, e = 4)
LEAST_SEEDS = {False: 2, True: 3}
REACH = {False: 2 * WORDS + 4, True: 2 * CHARS + 8}  # units in which a stretch shorter than twice the least lies, edits included
# beyond its outermost seeds such a stretch goes on for as long as its edits can spoil seeds: n units and one an edit
BEYOND = {False: (2 * WORDS - 1) // EDIT * (SEED_WORDS + 1), True: (2 * CHARS - 1) // EDIT * (SEED_CHARS + 1)}
PIECE = 400  # units by which long parts are cut
MAX_BITS = 26

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}--[\p{Mn}&&[\p{Devanagari}\p{Thai}\p{Arabic}\p{Hebrew}]]]+", regex.V1)
_TAG = regex.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>")
_BLOCK = frozenset("p br div li ul ol tr td th table h1 h2 h3 h4 h5 h6 hr".split())
_LINK = regex.compile(r"!?\[([^\[\]]+)\]\([^()\s]+\)")
_MARK = regex.compile(r"[*_`~]+")
_HYPHEN = regex.compile(r"(?<=\w)[-‐‑](?:\s*\n\s*)?(?=\w)")
_WORD = regex.compile(r"\w+")
_ASCII_WORD = re.compile(r"\w+")  # the same there, and faster
_DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def plain(text: str) -> str:
    """Case, typography, mark-up, hyphenation and invisible characters taken away."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " if m[2].lower() in _BLOCK else "", text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    plain_already = text.isascii()
    if not plain_already:
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text).replace("­", ""))
    text = _MARK.sub("", text)
    text = _HYPHEN.sub("", text)
    return text.lower() if plain_already else unicodedata.normalize("NFC", text).casefold()


def words(plain_text: str) -> list[str]:
    return (_ASCII_WORD if plain_text.isascii() else _WORD).findall(plain_text)


def dense(tokens: list[str]) -> bool:
    """Whether a text is counted in characters: over a fifth of it is in scripts without spaces."""
    joined = "".join(tokens)
    return bool(joined) and len(_DENSE.findall(joined)) > 0.2 * len(joined)


class _Hashes(dict):
    """64-bit hashes of words, the same on every machine."""

    def __missing__(self, w: str) -> int:
        if len(self) > 400_000:
            self.clear()
        v = self[w] = xxhash.xxh64_intdigest(w)
        return v


_HASHES = _Hashes()


def unit_hashes(tokens: list[str], by_chars: bool) -> np.ndarray:
    """A number for each word, or for each character of the words put together."""
    if by_chars:
        return np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))


def seed_hashes(units: np.ndarray, by_chars: bool) -> np.ndarray:
    """Hashes of the n-grams of a sequence of numbers; words and characters never share a hash but by chance."""
    n = SEED_CHARS if by_chars else SEED_WORDS
    if len(units) < n:
        return np.empty(0, np.uint64)
    m = len(units) - n + 1
    h = np.full(m, 0x9E3779B97F4A7C15 if by_chars else 0xC2B2AE3D27D4EB4F, np.uint64)
    for i in range(n):
        h = (h ^ units[i : i + m]) * np.uint64(0x100000001B3F)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class SeedFilter:
    """Bits that tell which hashes may be seeds of the items: two probes, at most MAX_BITS bits (8 MB), whatever their number.

    Beyond some millions of seeds more other hashes pass, which the join then drops; none is lost.
    """

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.table = bits, words.view(np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for at in (h >> np.uint64(64 - self.bits), h & np.uint64((1 << self.bits) - 1)):
            ok &= (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return ok


def seed_filter(seeds: DataFrame) -> SeedFilter:
    """Built on the executors: each seed gives two bit places, places meet in words of 64 bits."""
    n = max(1, seeds.count())
    bits = int(min(MAX_BITS, max(16, np.ceil(np.log2(32 * n)))))
    s = F.col("seed")
    at = seeds.select(F.explode(F.array(F.shiftrightunsigned(s, 64 - bits), s.bitwiseAND((1 << bits) - 1))).alias("at"))
    # least significant bit first, as numpy reads the bytes of a word
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("b"))
    got = words.toArrow()
    out = np.zeros(max(1, (1 << bits) // 64), np.int64)
    out[np.asarray(got.column("w"))] = np.asarray(got.column("b"))
    return SeedFilter(bits, out)


ITEM = "item_id bigint, by_chars boolean, units string, seeds array<bigint>"


def item_table(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, by_chars, units, seeds)`` of items long enough to leak; an id counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                w = words(plain(t))
                chars = dense(w)
                u = unit_hashes(w, chars)
                if len(u) >= (CHARS if chars else WORDS):
                    rows.append((i, chars, ("" if chars else " ").join(w), np.unique(seed_hashes(u, chars)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int64())))], names=["item_id", "by_chars", "units", "seeds"])

    t = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    return t.groupBy("item_id").agg(F.min("text").alias("text")).mapInArrow(run, ITEM)


def _pieces(at: np.ndarray, n_units: int, by_chars: bool) -> list[tuple[int, int]]:
    """Ranges of a document that can hold a stretch, from the places of its seeds.

    Any allowed stretch holds an allowed one shorter than twice the least, whose seeds lie within REACH units and are at
    least LEAST_SEEDS. Long ranges are cut with an overlap in which such a stretch has room.
    """
    reach, least = REACH[by_chars], LEAST_SEEDS[by_chars]
    cuts = np.flatnonzero(np.diff(at) > reach) + 1
    out = []
    for run in np.split(at, cuts):
        if len(run) < least:
            continue
        lo, hi = max(0, int(run[0]) - reach), min(n_units, int(run[-1]) + reach + SEED_CHARS)
        for s in range(lo, max(lo + 1, hi - 3 * reach), PIECE):
            out.append((s, min(hi, s + PIECE + 3 * reach)))
    return out


def passages(documents: DataFrame, known: SeedFilter, by_words: bool, by_chars: bool, doc_id: str = "doc_id", text: str = "text", chunk: int = 400_000) -> DataFrame:
    """``(pid, doc_id, by_chars, units, seeds, drop)``: the parts of documents in which seeds of items fall together.

    One scan of the texts, whole and of any length; a part has at most PIECE + 3 REACH units. ``drop`` is how many of its
    seeds, the most frequent ones, need not be looked up: one less than an allowed stretch keeps, 0 where a seed repeats.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    b = documents.sparkSession.sparkContext.broadcast(known)
    schema = f"pid bigint, doc_id {kind}, by_chars boolean, units string, seeds array<bigint>, drop int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, serial = b.value, TaskContext.get().partitionId() << 33

        def look(held: list, chars: bool) -> list[tuple]:
            """All texts of a chunk at once: n-grams across a border are marked off."""
            if not held:
                return []
            n = SEED_CHARS if chars else SEED_WORDS
            sizes = np.array([len(u) for _, _, u in held])
            h = seed_hashes(np.concatenate([u for _, _, u in held]), chars)
            ends = np.cumsum(sizes)
            at = np.flatnonzero(known(h))
            who = np.searchsorted(ends, at, "right")
            on = at + n <= ends[who]
            at, who = at[on], who[on]
            out = []
            for k in np.unique(who).tolist():
                mine = at[who == k]
                start = int(ends[k] - sizes[k])
                d, tokens, units = held[k]
                seq = "".join(tokens) if chars else tokens
                for lo, hi in _pieces(mine - start, len(units), chars):
                    s = h[mine[(mine >= start + lo) & (mine + n <= start + hi)]]
                    if len(s) >= LEAST_SEEDS[chars]:
                        once = np.unique(s)
                        out.append((d, chars, seq[lo:hi] if chars else " ".join(seq[lo:hi]), once.view(np.int64), LEAST_SEEDS[chars] - 1 if len(once) == len(s) else 0))
            return out

        def batch(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
            nonlocal serial
            cols = [pa.array(range(serial, serial + len(rows)), pa.int64())] + [pa.array([r[k] for r in rows], t) for k, t in enumerate((ids, pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.int32()))]
            serial += len(rows)
            return pa.RecordBatch.from_arrays(cols, names=["pid", "doc_id", "by_chars", "units", "seeds", "drop"])

        for rb in batches:
            ids = rb.schema.field("doc_id").type
            held, size = {False: [], True: []}, {False: 0, True: 0}
            for d, t in zip(rb.column("doc_id").to_pylist(), rb.column("text").to_pylist()):
                tokens = words(plain(t))
                for chars in (False, True):
                    if not (by_chars and _DENSE.search("".join(tokens)) if chars else by_words):
                        continue
                    u = unit_hashes(tokens, chars)
                    if len(u) < (CHARS if chars else WORDS) * 7 // 8:
                        continue
                    held[chars].append((d, tokens, u))
                    size[chars] += len(u)
                    if size[chars] >= chunk:
                        if rows := look(held[chars], chars):
                            yield batch(rows, ids)
                        held[chars], size[chars] = [], 0
            for chars in (False, True):
                if rows := look(held[chars], chars):
                    yield batch(rows, ids)

    d = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return d.mapInArrow(run, schema)


def candidates(parts: DataFrame, items: DataFrame) -> DataFrame:
    """``(pid, item_id)``: parts and items that share one of the part's rarer seeds.

    Seeds are counted over all parts. A part that holds a stretch shares at least LEAST_SEEDS seeds with the item, so it
    is enough to look up all its seeds but ``drop`` of the most frequent: the usual turns of phrase join nothing.
    """
    h = parts.select("pid", "drop", F.explode("seeds").alias("seed"))
    often = h.groupBy("seed").agg(F.count("*").alias("often"))
    s = h.join(often, "seed").groupBy("pid", "drop").agg(F.array_sort(F.collect_list(F.struct("often", "seed"))).alias("s"))  # at most PIECE + 3 REACH seeds a part
    rare = s.select("pid", F.explode(F.slice("s", 1, F.greatest(F.lit(0), F.size("s") - F.col("drop")))).alias("x")).select("pid", "x.seed")
    return rare.join(items.select("item_id", F.explode("seeds").alias("seed")), "seed").select("pid", "item_id").distinct()


def align(item: np.ndarray, doc: np.ndarray, least: int, budget: int = EDIT) -> tuple[int, int]:
    """Best (stretch of the item, edits) of a local alignment with edits <= stretch / budget, or (0, 0).

    Smith-Waterman with one plane per number of edits: a cell holds the longest stretch of the item that ends there. Any
    allowed stretch can be cut into allowed ones shorter than twice ``least``, so planes up to that length's edits decide.
    """
    top = (2 * least - 1) // budget
    none = -(10**6)
    old = np.full((top + 1, len(doc) + 1), none, np.int32)
    old[0] = 0
    best, best_e = 0, 0
    floor = np.maximum(least, budget * np.arange(top + 1))
    for w in item:
        new = np.full_like(old, none)
        np.copyto(new[:, 1:], old[:, :-1] + 1, where=doc == w)
        np.maximum(new[1:, 1:], old[:-1, :-1] + 1, out=new[1:, 1:])
        np.maximum(new[1:], old[:-1] + 1, out=new[1:])
        np.maximum(new[0], 0, out=new[0])
        for e in range(1, top + 1):
            np.maximum(new[e, 1:], new[e - 1, :-1], out=new[e, 1:])
        score = new.max(1)
        if (score >= floor).any():
            for e in np.flatnonzero(score >= floor):
                if score[e] - budget * e > best - budget * best_e or not best:
                    best, best_e = int(score[e]), int(e)
        old = new
    return best, best_e


class _Item:
    """An item ready for alignment: its units by number, and the places of its seeds."""

    def __init__(self, units: str, by_chars: bool):
        t = units if by_chars else units.split(" ")
        self.code = {w: c for c, w in enumerate(dict.fromkeys(t))}
        self.units = np.array([self.code[w] for w in t], np.int32)
        self.at: dict = {}
        n = SEED_CHARS if by_chars else SEED_WORDS
        for j in range(len(t) - n + 1):
            self.at.setdefault(self.units[j : j + n].tobytes(), []).append(j)


def best_stretch(item: _Item, units: str, by_chars: bool, memo: dict) -> tuple[int, int]:
    """The best allowed stretch of an item in a part of a document, or (0, 0)."""
    n, reach = (SEED_CHARS if by_chars else SEED_WORDS), REACH[by_chars]
    doc = np.array([item.code.get(w, -1) for w in (units if by_chars else units.split(" "))], np.int32)
    hits = [(p, j) for p in range(len(doc) - n + 1) if doc[p] >= 0 for j in item.at.get(doc[p : p + n].tobytes(), ())]
    best = (0, 0)
    for run in np.split(np.array(hits, np.int64).reshape(-1, 2), np.flatnonzero(np.diff([p for p, _ in hits]) > reach) + 1) if hits else ():
        # by counting, an allowed stretch keeps this many seeds at different places of the item: fewer are chance
        if len(np.unique(run[:, 1])) < LEAST_SEEDS[by_chars]:
            continue
        more = BEYOND[by_chars]
        d = doc[max(0, run[0, 0] - more) : run[-1, 0] + n + more]
        lo, hi = max(0, int(run[:, 1].min()) - more), int(run[:, 1].max()) + n + more
        key = (lo, hi, d.tobytes())
        if key not in memo:
            memo[key] = align(item.units[lo:hi], d, CHARS if by_chars else WORDS)
        m, e = memo[key]
        if m and (not best[0] or m - EDIT * e > best[0] - EDIT * best[1]):
            best = (m, e)
    return best


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``(doc_id, item_id, stretch, edits)``: every document that holds a stretch of an item, each pair once.

    A stretch is at least WORDS consecutive words of the item (CHARS characters in scripts without spaces) with at most
    one in EDIT changed, dropped or added. By counting, such a stretch shares LEAST_SEEDS seeds with the document, so
    asking for them loses none. Words dropped at the ends of a stretch count as its edits, so 14 unchanged words (27
    characters) in a row suffice. The corpus is read once, whatever the number of items: parts with seeds meet the items by
    their rarer seeds in a join, and alignment decides each pair. ``stretch`` is the best one within a part.
    Null or empty texts match nothing; rows with a null id are left out; shorter items can't match. Of rows repeated
    under one doc_id any may hold the stretch; of items repeated under one id the smaller text counts.
    """
    known = materialize(item_table(items, item_id, text), "items")
    seeds = known.select(F.explode("seeds").alias("seed")).distinct()
    kinds = {r[0] for r in known.select("by_chars").distinct().collect()}
    parts = materialize(passages(documents, seed_filter(seeds), False in kinds, True in kinds, doc_id, text), "passages")
    pairs = candidates(parts, known)
    kind = parts.schema["doc_id"].dataType.simpleString()
    j = pairs.join(parts.select("pid", "doc_id", "by_chars", "units"), "pid").join(known.select("item_id", "by_chars", F.col("units").alias("item")), ["item_id", "by_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict = {}
        for b in batches:
            out = []
            for d, i, chars, units, item in zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "by_chars", "units", "item"))):
                if i not in ready:
                    if len(ready) > 2_000:
                        ready.clear()
                    ready[i] = (_Item(item, chars), {})
                it, memo = ready[i]
                if len(memo) > 5_000:
                    memo.clear()
                m, e = best_stretch(it, units, chars, memo)
                if m:
                    out.append((d, i, m, e))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((b.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "stretch", "edits"])

    # a stated number of tasks: aligning costs far more than these few bytes let the planner think
    j = j.select("doc_id", "item_id", "by_chars", "units", "item").repartition(partitions(parts.sparkSession), "doc_id", "item_id")
    found = j.mapInArrow(run, f"doc_id {kind}, item_id bigint, stretch int, edits int")
    w = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("stretch") - EDIT * F.col("edits")).alias("s"), "stretch", "edits")).alias("x"))
    return w.select("doc_id", "item_id", "x.stretch", "x.edits")
