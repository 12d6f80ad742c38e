"""Sentence units of texts in any script.

Candidate boundaries are marks (and, in scripts that end statements with a space, blanks); a maximum-entropy classifier
decides each from its neighbours. It is trained on reliable boundaries of the texts themselves: paragraph breaks, and line
breaks after a mark. A first model tells how much more often such a break follows in a context than elsewhere; contexts in
which it (almost) never does are reliable non-boundaries, those in which it does are boundaries, and the second model,
which decides, learns from these.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_DOCS = 5_000  # most documents the classifier is fitted on
WIDTH = 1 << 18  # hashed features
JOINED = 5.0  # log odds that speak against an end where the blank after the mark is missing: most such marks are within a name

# fixed values: marks that can end a sentence, and pairs that enclose text
FULL = "。！？｡．！？"
MARKS = ".!?…‥؟۔।॥" + FULL + "։።"
PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "„": "“", "‹": "›", "［": "］"}
CLOSE = "".join(sorted({*PAIRS.values(), '"', "'", "’", "”"}))
EITHER = frozenset(MARKS + CLOSE)
SPACED = "฀-๿຀-໿ក-៿က-႟"

_BREAK = regex.compile(r"\n[^\S\n]*\n\s*")
_CAND = regex.compile(rf"[{regex.escape(MARKS)}]+|(?<=[{SPACED}])\s+(?=\S)|(?<=\S)\s+(?=[{SPACED}])")
_TOKEN = regex.compile(r"\S+")
_QUOTE = regex.compile(r"[\"“”«»「」『』（）()\[\]【】《》„‹›［］]")
_AHEAD = regex.compile(r"(\S+)(?:\s+(\S+))?")
_NUMBER = regex.compile(r"\d{1,4}[.)]\s+")
_DIGITS = regex.compile(r"\d+")
_RUN_ON = regex.compile(r"^\p{Ll}\.\p{Lu}\p{Ll}")
_LIST = regex.compile(r"^\s*(?:\d{1,4}|[A-Za-z])[.)]$")


def _pairs(p: str) -> list[tuple[int, int]]:
    """Closed pairs of quotes and brackets in a paragraph, as (open, close) positions; unclosed ones don't count."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _QUOTE.finditer(p):
        c, i = m[0], m.start()
        if c == '"':
            if any(o == '"' for o, _ in stack):
                want = '"'
            else:
                stack.append(('"', i))
                continue
        elif c == "“" and any(o == "„" for o, _ in stack):
            want = "„"
        elif c in PAIRS:
            stack.append((c, i))
            continue
        else:
            opener = [o for o, x in PAIRS.items() if x == c]
            want = next((o for o, _ in reversed(stack) if o in opener), None)
            if want is None:
                continue
        while stack and stack[-1][0] != want:
            stack.pop()
        if stack:
            _, at = stack.pop()
            out.append((at, i))
    return sorted(out)


def _outer(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    top: list[tuple[int, int]] = []
    for a, b in pairs:
        if not top or a > top[-1][1]:
            top.append((a, b))
    return top


@lru_cache(maxsize=65_536)
def _shape(w: str) -> str:
    """Kinds of characters, runs shortened: Ab -> Xx, 3.5 -> 9.9."""
    out = []
    for c in w[:16]:
        k = "x" if c.islower() else "9" if c.isdigit() else "X" if c.isupper() else "o" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:8])


def _script(c: str) -> str:
    o = ord(c)
    return "L" if o < 0x250 else "C" if o < 0x530 else "A" if 0x600 <= o < 0x780 else "D" if 0x900 <= o < 0x980 else "T" if 0xE00 <= o < 0x1100 or 0x1780 <= o < 0x1800 else "J" if 0x2E80 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0xFF00 <= o else "O"


def candidates(text: str) -> Iterator[tuple[int, int, bool, tuple]]:
    """``(end of the left side, start of the right side, at a line or paragraph break, context)``, one at a time.

    A context is what the classifier sees, cut from bounded windows around the mark, so that time and memory follow the
    text, however long a paragraph is. Paragraph breaks themselves are listed for training, with a start of -1.

    Marks within closed quotes or brackets are no candidates, nor is the number that opens a list line. The last mark of a
    text has nothing to its right and needs no decision.
    """
    at, last = 0, None
    for lo, hi in [*((m.start(), m.end()) for m in _BREAK.finditer(text)), (len(text), len(text))]:
        if text[at:lo].strip():
            if last:
                yield from _between(text, *last, at, lo)
            yield from _paragraph(text, at, lo)
            last = (at, lo)
        at = hi


def _between(text: str, lo: int, end: int, nxt: int, hi: int) -> Iterator[tuple[int, int, bool, tuple]]:
    """The break after a paragraph that ends like a sentence; the next paragraph goes from ``nxt`` to ``hi``."""
    while end > lo and text[end - 1].isspace():
        end -= 1
    c = text[end - 1]
    if c in MARKS or c in CLOSE or _script(c) == "T":
        while text[nxt].isspace():
            nxt += 1
        pairs = {b: a for a, b in _pairs(text[lo:end])} if c in CLOSE else {}
        yield end, -1, True, context(text, lo, end, nxt, hi, {b + lo: a + lo for b, a in pairs.items()}, True)


def _paragraph(text: str, lo: int, hi: int) -> Iterator[tuple[int, int, bool, tuple]]:
    pairs = [(a + lo, b + lo) for a, b in _pairs(text[lo:hi])]
    inside, openers, closers = _outer(pairs), {a for a, _ in pairs}, {b: a for a, b in pairs}
    n_in, ends = 0, len(inside)
    line = lo  # where the line of the mark begins
    for m in _CAND.finditer(text, lo, hi):
        s, e = m.span()
        c = text[s]
        if c.isspace():
            left, right = s, e
            if n_in < ends:
                while n_in < ends and inside[n_in][1] < s:
                    n_in += 1
                if n_in < ends and inside[n_in][0] < s and inside[n_in][1] >= e:
                    continue
        else:
            while e < hi:
                # closers stay with the mark; a sign that opens a pair starts the next unit
                x = text[e]
                if x in CLOSE and e not in openers:
                    e += 1
                elif e + 1 in closers and x.isspace():
                    e += 2
                else:
                    break
            if n_in < ends:
                while n_in < ends and inside[n_in][1] < s:
                    n_in += 1
                if n_in < ends and inside[n_in][0] < s and inside[n_in][1] >= e:
                    continue
            left = right = e
            while right < hi and text[right].isspace():
                right += 1
            if right >= hi:
                continue
            if right == left:
                nxt = text[right]
                if c == ".":
                    if s > lo and text[s - 1].isdigit() and nxt.isdigit():
                        continue
                elif c in "!?":
                    if not (nxt.isupper() or nxt in PAIRS or _script(nxt) not in "LC"):
                        continue
                elif c == "．" and nxt.isdigit():
                    continue
            if e - s == 1:
                line = max(line, text.rfind("\n", line, s) + 1)
                if s - line <= 40 and _LIST.match(text[line:e]):
                    head = text[line:s].strip()
                    if head and not head.isalpha():
                        continue
        brk = right > left and "\n" in text[left:right]
        yield left, right, brk, context(text, lo, left, right, hi, closers, brk)


_EDGE = "".join(sorted(set("\"'“”«»「」『』（）()[]【】《》„‹›’¿¡") | {*PAIRS}))


@lru_cache(maxsize=65_536)
def _fold(w: str) -> str:
    return w if w.isalpha() else _DIGITS.sub("9", w)


def _script_before(text: str, lo: int, left: int) -> str:
    """The script before a mark."""
    return next((_script(c) for c in reversed(text[max(lo, left - 12) : left]) if c not in MARKS and c not in CLOSE and not c.isspace()), "O")


EDGE = frozenset(_EDGE)
WINDOW = 120  # characters on either side of a mark that a context is cut from


def context(text: str, lo: int, left: int, right: int, hi: int, closers: dict[int, int], brk: bool) -> tuple[str, ...]:
    """What the classifier sees of a candidate: the mark with its closers, the words about it, what the quote before the mark
    opens after, and how it is joined to what follows. Figures are folded, so contexts recur.

    ``lo`` is where the paragraph of the mark begins, ``hi`` where that of the right side ends, ``closers`` the places of closing signs and where their pairs open.
    """
    i, low = left, left - WINDOW
    if low < lo:
        low = lo
    while i > low and ((c := text[i - 1]) in EITHER or c.isspace() and i < left and text[i] in CLOSE):
        i -= 1
    mark = text[i:left] if left - i < 2 else "".join(text[i:left].split())
    ws = text[max(low, i - 80) : i].rsplit(None, 2)
    w1, w2 = ws[-1] if ws else "", ws[-2] if len(ws) > 1 else ""
    quote = ""
    if mark and mark[-1] in CLOSE:
        o = closers.get(left - 1)
        if o is None:
            quote = "none"
        else:
            k = o
            while k > max(lo, o - WINDOW) and text[k - 1].isspace():
                k -= 1
            p = text[k - 1] if k > lo else ""
            quote = "start" if not p or p in MARKS or p in CLOSE or "\n" in text[k:o] else "colon" if p in ":：" else "comma" if p in ",，、" else "mid"
    end = min(hi, right + WINDOW)
    at = right
    if brk and (m := _NUMBER.match(text, at, end)):
        at = m.end()
    m = _AHEAD.match(text, at, end)
    r1, r2 = m.groups() if m else ("", None)
    opener = ""
    if r1:
        if r1[0] in EDGE:
            opener = r1[0]
            r1 = r1.strip(_EDGE) or r1
        elif r1[-1] in EDGE:
            r1 = r1.strip(_EDGE)
    # a full stop or ellipsis without the blank its script has
    joined = ""
    if left == right:
        k = left
        while k > low and text[k - 1] in CLOSE:
            k -= 1
        z = text[k - 1 : k]
        if z == "." or z in ("…", "‥") and _script(text[right]) != "J":
            joined = "plain" if _RUN_ON.search(text[max(lo, left - 2) : left] + text[right : right + 2]) else "odd"
    return mark, w1 if w1.isalpha() else _fold(w1), w2 if w2.isalpha() else _fold(w2), quote, opener, r1 if r1.isalpha() else _fold(r1), "" if not r2 else r2 if r2.isalpha() else _fold(r2), joined


@lru_cache(maxsize=100_000)
def hashed(mark: str, w1: str, w2: str, quote: str, opener: str, n1: str, n2: str) -> tuple[int, ...]:
    """Feature numbers of a context."""
    script = _script((w1 or mark or "a")[-1]) if not mark or mark[0] not in FULL else "J"
    if script == "T" or script == "J":
        a, b = w1[-6:], n1[:6]
        f = [f"a3{a[-3:]}", f"a6{a}", f"a1{a[-1:]}", f"b3{b[:3]}", f"b6{b}", f"b2{b[:2]}", f"ab{a[-2:]}|{b[:2]}", f"sa{_shape(w1)[-3:]}|{_shape(n1)[:2]}", f"w2{w2[-4:]}|{a[-3:]}", f"n2{b[:3]}|{n2[:3]}"]
    else:
        l1, l2 = w1.lower().strip(_EDGE), w2.lower().strip(_EDGE)
        s1, t1 = _shape(w1.strip(_EDGE)), _shape(n1)
        r1 = n1.rstrip(".,;:!?")
        f = [f"w{l1}", f"s{s1}", f"n{r1}", f"t{t1[:3]}", f"wn{l1}|{t1[:2]}", f"st{s1}|{t1[:2]}", f"sn{s1}|{r1}", f"ww{l2}|{s1}", f"l{min(len(w1), 6)}|{t1[:1]}", f"wnn{l1}|{r1}", f"nn{r1}|{_shape(n2)[:2]}", f"w2s{_shape(w2)[:3]}|{s1}|{t1[:2]}"]
    f += [f"m{mark}", f"m0{mark[:1]}|{quote}", f"q{quote}|{_shape(n1)[:1]}", f"qn{quote}|{n1[:3]}" if quote else "q", f"o{opener}|{mark[:1]}", "1"]
    seed = zlib.crc32(script.encode())  # as if the script stood before each feature
    return tuple([zlib.crc32(x.encode(), seed) % WIDTH for x in f])


def fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, rounds: int = 70, seen: int = 6) -> np.ndarray:
    """Weights of a logistic model with hashed binary features, by Adam on all rows; rare features keep weight 0."""
    n = len(y)
    on = np.bincount(cols, minlength=WIDTH) >= seen
    use = on[cols]
    rows, cols = rows[use], cols[use]
    names, cols = np.unique(cols, return_inverse=True)
    k = len(names)
    w, m, v = np.zeros(k), np.zeros(k), np.zeros(k)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], minlength=n)
        g = (np.bincount(cols, ((1 / (1 + np.exp(-z))) - y)[rows], minlength=k) + 1.0 * w) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    out = np.zeros(WIDTH)
    out[names] = w
    return out


SCRIPTS = "LCADTJO"


def train(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", fit_docs: int = FIT_DOCS) -> np.ndarray:
    """Weights of the deciding model, trained on about ``fit_docs`` documents (twice that at most), chosen by a hash of the id.

    No break can follow a full stop without a blank, so training leaves such marks out, but for the plain case of a small
    letter before and a capitalised word after, which is nearly always an end.
    """
    n = documents.count()
    keep = min(1.0, fit_docs / max(n, 1))
    d = documents.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(1 << 30)) < int(keep * (1 << 30)))).select(text).limit(2 * fit_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, ks, fs = [], [], []
            for t in batch.column(0).to_pylist():
                for end, start, brk, c in candidates(t):
                    if start >= 0 and c[7] == "odd":
                        continue
                    ys.append(int(brk))
                    ks.append(SCRIPTS.index(_script_before(t, 0, end)))
                    fs.append(hashed(*c[:7]))
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int8()), pa.array(ks, pa.int8()), pa.array(fs, pa.list_(pa.int32()))], names=["y", "k", "f"])

    got = d.mapInArrow(run, "y byte, k byte, f array<int>").toArrow()
    y, k = np.asarray(got.column("y"), float), np.asarray(got.column("k"), int)
    lists = got.column("f").combine_chunks() if got.num_rows else None
    if lists is None or not y.sum():
        return np.zeros(WIDTH)
    cols = np.asarray(lists.flatten(), np.int64)
    rows = np.repeat(np.arange(len(y)), np.diff(np.asarray(lists.offsets)))
    return learn(rows, cols, y, k)


def learn(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, k: np.ndarray, never: float = 0.04, often: float = 0.2) -> np.ndarray:
    """Weights of the deciding model. ``y``: a line or paragraph break follows; ``k``: script; rows are sorted.

    Two-fold, so that no candidate is judged by a model that has seen it. A candidate's break probability is set against
    the mean of its script's breaks: at or under ``never`` it is no boundary, from ``often`` on it is one.
    """
    n = len(y)
    p = np.zeros(n)
    for fold in range(2):
        own = np.arange(n) // 64 % 2 == fold
        use = ~own[rows]
        place = np.cumsum(~own) - 1
        w = fit(place[rows[use]], cols[use], y[~own])
        p[own] = (1 / (1 + np.exp(-np.bincount(rows, w[cols], minlength=n))))[own]
    share = np.full(len(SCRIPTS), p[y == 1].mean())
    for i in range(len(SCRIPTS)):
        on = (k == i) & (y == 1)
        if on.sum() >= 30:
            share[i] = p[on].mean()
    ratio = p / np.maximum(share[k], 1e-9)
    label = np.where((y == 1) | (ratio >= often), 1.0, 0.0)
    sure = (y == 1) | (ratio >= often) | (ratio <= never)
    place = np.cumsum(sure) - 1
    use = sure[rows]
    return fit(place[rows[use]], cols[use], label[sure])


def units(text: str, w: np.ndarray | list[float], known: dict | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of the sentence units of one text; ``known`` keeps scores of contexts between texts."""
    known = {} if known is None else known
    if not text or not text.strip():
        return []
    cuts = [(m.start(), m.end()) for m in _BREAK.finditer(text)]
    for left, right, _, c in candidates(text):
        if right >= 0:
            z = known.get(c)
            if z is None:
                z = known[c] = sum([w[i] for i in hashed(*c[:7])]) - (JOINED if c[7] else 0)
            if z >= 0:
                cuts.append((left, right))
    cuts.sort()
    out, at = [], 0
    for a, b in [*cuts, (len(text), len(text))]:
        s = at
        while s < a and text[s].isspace():
            s += 1
        while a > s and text[a - 1].isspace():
            a -= 1
        if a > s:
            out.append((s, a))
        at = max(at, b)
    return out


def split_sentences(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", fit_docs: int = FIT_DOCS, train_on: DataFrame | None = None) -> DataFrame:
    """``(doc_id, start_char, end_char)``: the units of every document; offsets count code points, the end is exclusive.

    Null, empty or blank texts have no units. Texts are processed whole, in time and memory that follow their length. Rows
    repeated under one id give their units again. The model is trained on the texts themselves, or on those of another
    table of the same columns, and broadcast (2 MB, whatever the corpus).
    """
    spark = documents.sparkSession
    b = spark.sparkContext.broadcast(train(documents if train_on is None else train_on, text, doc_id, fit_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = b.value.tolist(), {}  # single weights come faster from a list
        for batch in batches:
            if len(known) > 200_000:
                known.clear()
            found = [units(t, w, known) if t else [] for t in batch.column("text").to_pylist()]
            n = np.array([len(u) for u in found], np.int64)
            flat = np.array([x for u in found for x in u], np.int32).reshape(-1, 2)
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["doc_id", "start_char", "end_char"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, start_char int, end_char int")
