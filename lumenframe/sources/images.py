"""Reading pixels, inspecting files, and computing properties and embeddings per image, in Arrow batches."""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import image_properties as ip
from lumenframe.runtime import partitions


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of filtered bytes (the first of each is the kind) to plain bytes; ``step`` bytes make a pixel."""
    kinds, rows = raw[:, 0], raw[:, 1:]
    h, stride = rows.shape
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    w = -(-stride // step)
    x = np.zeros((h + 1, w + 1, step), np.int16)  # a row of zeros above, a pixel of zeros on the left
    data = np.zeros((h, w * step), np.int16)
    data[:, :stride] = rows
    data = data.reshape(h, w, step)
    if kinds.max(initial=0) <= 2:
        for y in range(h):
            x[y + 1, 1:] = np.cumsum(data[y], axis=0, dtype=np.int64) & 255 if kinds[y] == 1 else (data[y] + (x[y, 1:] if kinds[y] == 2 else 0)) & 255
    else:
        # a pixel needs those to its left and above: all pixels of a diagonal are ready together
        for d in range(h + w - 1):
            y = np.arange(max(0, d - w + 1), min(h - 1, d) + 1)
            c = d - y
            left, up, corner, k = x[y + 1, c], x[y, c + 1], x[y, c], kinds[y][:, None]
            p = left + up - corner
            pa, pb, pc = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
            paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
            x[y + 1, c + 1] = (data[y, c] + np.select([k == 1, k == 2, k == 3, k == 4], [left, up, (left + up) // 2, paeth], 0)) & 255
    return x[1:, 1:].reshape(h, w * step)[:, :stride].astype(np.uint8)


# fixed values: the seven passes of an interlaced PNG, as (first row, row step, first column, column step)
PASSES = [(0, 8, 0, 8), (0, 8, 4, 8), (4, 8, 0, 4), (0, 4, 2, 4), (2, 4, 0, 2), (0, 2, 1, 2), (1, 2, 0, 1)]


def decode_png(b: bytes) -> np.ndarray:
    """PNG of any bit depth, interlaced or not: gray, gray+alpha, RGB, RGBA, palette."""
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, palette = 8, [], None
    while at < len(b):
        n, kind = struct.unpack(">I4s", b[at : at + 8])
        body = b[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, color, _, _, lace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    flat = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)

    def plane(flat: np.ndarray, h: int, w: int) -> np.ndarray:
        stride = (w * c * depth + 7) // 8
        out = _unfilter(flat[: h * (stride + 1)].reshape(h, stride + 1), max(1, c * depth // 8))
        if depth == 16:
            x = np.ascontiguousarray(out).view(">u2").astype(np.uint16)
        elif depth == 8:
            x = out
        else:
            x = np.unpackbits(out, axis=1).reshape(h, -1, depth) @ (1 << np.arange(depth)[::-1])
            x = x[:, : w * c].astype(np.uint8)
        return x.reshape(h, w, c)

    if not lace:
        x = plane(flat, h, w)
    else:
        x, at = np.zeros((h, w, c), np.uint16 if depth == 16 else np.uint8), 0
        for y0, ys, x0, xs in PASSES:
            ph, pw = len(range(y0, h, ys)), len(range(x0, w, xs))
            if ph and pw:
                x[y0::ys, x0::xs] = plane(flat[at:], ph, pw)
                at += ph * ((pw * c * depth + 7) // 8 + 1)
    return palette[x[..., 0]] if color == 3 else x


def decode_tiff(b: bytes) -> np.ndarray:
    """Baseline TIFF: strips, 8 to 64 bits, uncompressed or deflate, horizontal predictor."""
    e = {b"II": "<", b"MM": ">"}.get(b[:2])
    if e is None or struct.unpack(e + "H", b[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack(e + "I", b[4:8])[0]
    sizes, codes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}, {1: "B", 3: "H", 4: "I", 16: "Q"}
    tags: dict[int, list] = {}
    for i in range(struct.unpack(e + "H", b[at : at + 2])[0]):
        tag, kind, n = struct.unpack(e + "HHI", b[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind in codes:
            size = sizes[kind] * n
            pos = at + 10 + 12 * i if size <= 4 else struct.unpack(e + "I", b[at + 10 + 12 * i : at + 14 + 12 * i])[0]
            tags[tag] = list(struct.unpack(f"{e}{n}{codes[kind]}", b[pos : pos + size]))
    w, h, bits, c = tags[256][0], tags[257][0], tags.get(258, [1])[0], tags.get(277, [1])[0]
    packed, fmt = tags.get(259, [1])[0], tags.get(339, [1])[0]
    if packed not in (1, 8, 32946) or 273 not in tags or tags.get(284, [1])[0] != 1:
        raise ValueError("this TIFF layout is not supported")
    dt = np.dtype(f"{e}{ {1: 'u', 2: 'i', 3: 'f'}[fmt] }{bits // 8}")
    strips = [b[o : o + n] for o, n in zip(tags[273], tags[279])]
    raw = b"".join(zlib.decompress(s) if packed != 1 else s for s in strips)
    x = np.frombuffer(raw, dt, w * h * c).reshape(h, w, c)
    if tags.get(317, [1])[0] == 2:
        x = np.cumsum(x, axis=1, dtype=x.dtype)
    return x.astype(dt.newbyteorder("="))


def decode_nifti(b: bytes) -> np.ndarray:
    """NIfTI-1 in one file, also gzipped; first volume."""
    if b[:2] == b"\x1f\x8b":
        b = zlib.decompress(b, 31)
    e = "<" if struct.unpack("<i", b[:4])[0] == 348 else ">"
    dim = struct.unpack(e + "8h", b[40:56])
    code = struct.unpack(e + "h", b[70:72])[0]
    kinds = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
    if code not in kinds:
        raise ValueError(f"NIfTI type {code} is not supported")
    at = int(struct.unpack(e + "f", b[108:112])[0])
    n = [max(1, d) for d in dim[1 : 1 + dim[0]]][:3]
    dt = np.dtype(e + kinds[code])
    x = np.frombuffer(b, dt, int(np.prod(n)), at).reshape(n, order="F")
    return x.astype(dt.newbyteorder("="))


def decode(b: bytes, path: str) -> np.ndarray:
    """Pixels in native type. npy without objects; npz takes its first array."""
    p = path.lower()
    if p.endswith(".npy"):
        return np.load(io.BytesIO(b), allow_pickle=False)
    if p.endswith(".npz"):
        z = np.load(io.BytesIO(b), allow_pickle=False)
        return z[z.files[0]]
    if p.endswith((".nii", ".nii.gz")):
        return decode_nifti(b)
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(b)
    if b[:2] in (b"II", b"MM"):
        return decode_tiff(b)
    try:
        from PIL import Image  # optional

        return np.asarray(Image.open(io.BytesIO(b)))
    except ImportError as e:
        raise ValueError(f"no decoder for {path}") from e


def ensure_hwc(x: np.ndarray) -> np.ndarray:
    """Height, width, channels: 2-D gains an axis; of three axes the smallest, if at most 16, is the channels."""
    if x.ndim == 2:
        return x[..., None]
    if x.ndim != 3:
        raise ValueError(f"an image has 2 or 3 axes, not {x.ndim}")
    a = int(np.argmin(x.shape))
    return np.moveaxis(x, a, 2) if x.shape[a] <= 16 and x.shape[2] != x.shape[a] else x


def read_bytes(path: str) -> bytes:
    """The bytes of one file, by its path on this machine or on any file system Arrow knows; read where it is wanted."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))
        with system.open_input_stream(at) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def file_rows(catalog: DataFrame, root: str | None = None, path: str = "image_path", key: str = "image_index", mask: str | None = None, per_task: int = 64) -> DataFrame:
    """``(key, paths, mask)``: the files of each record, spread over tasks of about ``per_task`` records.

    Only paths travel; the task that needs an image reads its files. Relative paths lie below ``root``.
    """
    below = lambda c: F.when(c.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:/)"), c).otherwise(F.concat(F.lit(f"{root.rstrip('/')}/"), c)) if root else c
    paths = F.coalesce(F.col("channel_paths"), F.array(path)) if "channel_paths" in catalog.columns else F.array(path)
    r = catalog.select(key, F.transform(paths, below).alias("paths"), (below(F.col(mask)) if mask else F.lit(None).cast("string")).alias("mask"))
    return r.repartition(max(partitions(catalog.sparkSession), -(-r.count() // per_task)))


def load(paths: list[str]) -> np.ndarray:
    """An image of one or more files, channels in their order; a missing file raises."""
    return np.concatenate([ensure_hwc(decode(read_bytes(p), p)) for p in paths], 2)


def _why(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:200]


def inspect(catalog: DataFrame, root: str | None = None, path: str = "image_path", key: str = "image_index") -> DataFrame:
    """``(key, path, height, width, channels, dtype, min, max, error)`` per file; unreadable files keep their row with the error."""
    kind = catalog.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, paths in zip(pdf[key].tolist(), pdf["paths"]):
                for p in paths:
                    try:
                        x = load([p])
                        out.append((k, p, *x.shape, str(x.dtype), float(x.min()), float(x.max()), None))
                    except Exception as e:
                        out.append((k, p, None, None, None, None, None, None, _why(e)))
            yield pd.DataFrame(out, columns=[key, "path", "height", "width", "channels", "dtype", "min", "max", "error"])

    return file_rows(catalog, root, path, key).mapInPandas(run, f"{key} {kind}, path string, height int, width int, channels int, dtype string, min double, max double, error string")


def property_names(functions: list[tuple[str, ip.PropertyFunction]], channels: list[str]) -> list[str]:
    """Output names, found by running the functions on a small ramp."""
    img, msk = np.arange(64, dtype=float).reshape(8, 8), np.ones((8, 8))
    out: list[str] = []
    for need, f in functions:
        for name in f(img, msk):
            out += [name] if need == "mask" or len(channels) < 2 else [f"{name}_{c}" for c in channels]
    if len(set(out)) < len(out):
        raise ValueError("two functions give the same property name")
    return out


def compute_properties(catalog: DataFrame, functions: list[tuple[str, ip.PropertyFunction]], channels: list[str] | None = None, root: str | None = None, mask: str | None = None, key: str = "image_index") -> DataFrame:
    """``(key, <properties>, error)``: one row per image; a function that fails leaves nulls, an unreadable image an error.

    ``mask`` names the column with the mask's path. Images and masks are read, measured and dropped one at a time in the
    task that holds their row; nothing but the numbers is shuffled.
    """
    channels = channels or ["0"]
    names = property_names(functions, channels)
    kind = catalog.schema[key].dataType.simpleString()

    def measure(paths: list[str], mask_path: str | None) -> dict:
        row = {}
        x = load(paths).astype(np.float32)
        msk = load([mask_path])[..., 0] if mask_path else None
        for need, fn in functions:
            if need in ("mask", "both") and msk is None:
                continue
            for c in range(1 if need == "mask" else min(len(channels), x.shape[2])):
                try:
                    got = fn(None if need == "mask" else x[..., c], msk)
                except Exception:
                    continue
                for n, v in got.items():
                    row[n if need == "mask" or len(channels) < 2 else f"{n}_{channels[c]}"] = None if v is None or not np.isfinite(v) else float(v)
        return row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, paths, m in zip(pdf[key].tolist(), pdf["paths"], pdf["mask"].tolist()):
                try:
                    rows.append(measure(list(paths), m) | {key: k, "error": None})
                except Exception as e:
                    rows.append({key: k, "error": _why(e)})
            yield pd.DataFrame(rows, columns=[key, *names, "error"])

    schema = f"{key} {kind}, " + ", ".join(f"`{n}` double" for n in names) + ", error string"
    return file_rows(catalog, root, key=key, mask=mask).mapInPandas(run, schema)


def extract_embeddings(catalog: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int | None = 224, channel_mode: str = "combined", batch_size: int = 32, root: str | None = None, key: str = "image_index", preprocess: Callable | None = None, transforms: list[Callable] | None = None, pad: int | None = None, normalize: tuple | None = None) -> DataFrame:
    """``(key, embedding, error)``: a model maps (B, C, H, W) float32 to (B, D); it is made once per Python worker and gets up
    to ``batch_size`` images at a time.

    combined feeds three channels; split feeds every channel as gray RGB, normalises each vector and concatenates them.
    Steps: values to [0, 1] by their range, ``preprocess``, black margins up to ``pad``, resizing to ``size`` (None leaves
    it, for images of one size), three channels, ``normalize`` by (means, deviations), then ``transforms`` one after the other. Images that cannot be read keep their row with the error; a model that fails ends the job.
    """
    kind = catalog.schema[key].dataType.simpleString()

    def planes(paths: list[str]) -> list[np.ndarray]:
        x = load(paths)
        lo, div = ip.resolve_scale(float(x.min()), float(x.max()), x.dtype)
        x = (x.astype(np.float32) - lo) / div
        x = preprocess(x) if preprocess else x
        x = ip.pad_to(x, pad) if pad else x
        x = (ip.resize(x, size) if size else x).astype(np.float32)
        out = [ip.to_rgb(x)] if channel_mode == "combined" else [ip.to_rgb(x[..., i : i + 1]) for i in range(x.shape[2])]
        if normalize:
            out = [ip.standardize(p, *normalize) for p in out]
        for t in transforms or ():
            out = [np.asarray(t(p), np.float32) for p in out]
        return [p.transpose(2, 0, 1) for p in out]

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None

        def flush(rows: list[tuple]) -> pd.DataFrame:
            nonlocal model
            stack = [p for _, ps, _ in rows for p in ps]
            y = np.zeros((0, 0), np.float32)
            if stack:
                model = model or make_model()
                y = np.asarray(model(np.stack(stack)), np.float32)
                if y.ndim != 2 or len(y) != len(stack):
                    raise ValueError(f"the model returned {y.shape} for {len(stack)} images")
                if channel_mode != "combined":
                    y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            at, vecs = 0, []
            for _, ps, _ in rows:
                vecs.append(y[at : at + len(ps)].ravel() if ps else None)
                at += len(ps)
            return pd.DataFrame({key: [r[0] for r in rows], "embedding": vecs, "error": [r[2] for r in rows]})

        for pdf in batches:
            held: list[tuple] = []
            for k, paths in zip(pdf[key].tolist(), pdf["paths"]):
                try:
                    held.append((k, planes(list(paths)), None))
                except Exception as e:
                    held.append((k, [], _why(e)))
                if len(held) >= batch_size:
                    yield flush(held)
                    held = []
            if held:
                yield flush(held)

    return file_rows(catalog, root, key=key).mapInPandas(embed, f"{key} {kind}, embedding array<float>, error string")
