"""Scalar properties of one image plane and its mask, in numpy. Each function takes (image, mask) and returns a dict."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

Plane = np.ndarray
PropertyFunction = Callable[[Plane | None, Plane | None], dict[str, float]]

# fixed values: statistics by name, and the measures of each preset
STATS: dict[str, Callable] = {"mean": np.mean, "std": np.std, "min": np.min, "max": np.max, "median": np.median, "variance": np.var, "sum": np.sum}
SHAPE = ("area", "perimeter", "major_axis_length", "minor_axis_length", "eccentricity", "solidity", "convex_hull_area", "orientation", "euler_number", "extent", "equivalent_diameter", "aspect_ratio", "circularity", "roundness")
TEXTURE = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "asm")
NAN = float("nan")


def foreground(mask: Plane) -> Plane:
    return np.asarray(mask) > 0.5


def _hull_area(p: np.ndarray) -> float:
    """Pixels whose centres lie in the convex hull of the pixel corners' midpoints."""
    pts = np.unique(np.concatenate([p + d for d in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))]), axis=0)
    pts = pts[np.lexsort((pts[:, 1], pts[:, 0]))]

    cross = lambda a, b: a[0] * b[1] - a[1] * b[0]

    def chain(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and cross(out[-1] - out[-2], q - out[-2]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = np.array(chain(pts) + chain(pts[::-1]))
    lo, hi = np.floor(hull.min(0)).astype(int), np.ceil(hull.max(0)).astype(int)
    gy, gx = np.mgrid[lo[0] : hi[0] + 1, lo[1] : hi[1] + 1]
    inside = np.ones(gy.shape, bool)
    for a, b in zip(hull, np.roll(hull, -1, 0)):
        inside &= (b[0] - a[0]) * (gx - a[1]) - (b[1] - a[1]) * (gy - a[0]) >= -1e-9
    return float(inside.sum())


def _perimeter(m: Plane) -> float:
    """Length of the border from 4-connected border pixels, diagonal steps counted as the root of two."""
    p = np.pad(m, 1)
    core = p & np.roll(p, 1, 0) & np.roll(p, -1, 0) & np.roll(p, 1, 1) & np.roll(p, -1, 1)
    edge = (p & ~core).astype(int)
    straight = sum(np.roll(edge, s, a) for a in (0, 1) for s in (1, -1))
    diag = sum(np.roll(np.roll(edge, a, 0), b, 1) for a in (1, -1) for b in (1, -1))
    code = edge * (1 + 2 * straight + 10 * diag)
    # fixed values: weights of neighbourhood codes of border pixels
    one, root, both = (5, 7, 15, 17, 25, 27), (21, 33), (13, 23)
    return float(np.isin(code, one).sum() + math.sqrt(2) * np.isin(code, root).sum() + (1 + math.sqrt(2)) / 2 * np.isin(code, both).sum())


def _euler(m: Plane) -> int:
    """Components minus holes, 8-connected, from 2x2 patterns."""
    p = np.pad(m, 1).astype(int)
    q = p[:-1, :-1] + p[1:, :-1] + p[:-1, 1:] + p[1:, 1:]
    diagonal = (q == 2) & (p[:-1, :-1] == p[1:, 1:])
    return int(round(((q == 1).sum() - (q == 3).sum() - 2 * diagonal.sum()) / 4))


def shape(image: Plane | None, mask: Plane | None) -> dict[str, float]:
    """All foreground is one region; NaN for an empty mask."""
    m = foreground(mask)
    yx = np.argwhere(m).astype(float)
    n = len(yx)
    if not n:
        return dict.fromkeys(SHAPE, NAN)
    d = yx - yx.mean(0)
    a, c, b = (d[:, 0] ** 2).mean() + 1 / 12, (d[:, 1] ** 2).mean() + 1 / 12, -(d[:, 0] * d[:, 1]).mean()
    root = math.sqrt(4 * b * b + (a - c) ** 2)
    l1, l2 = (a + c + root) / 2, max((a + c - root) / 2, 0)
    major, minor = 4 * math.sqrt(l1), 4 * math.sqrt(l2)
    angle = (-math.pi / 4 if b < 0 else math.pi / 4) if a == c else 0.5 * math.atan2(-2 * b, c - a)
    if a == c and b == 0:
        angle = math.pi / 4
    perimeter, hull = _perimeter(m), _hull_area(yx)
    box = np.prod(yx.max(0) - yx.min(0) + 1)
    return {
        "area": float(n), "perimeter": perimeter, "major_axis_length": major, "minor_axis_length": minor,
        "eccentricity": math.sqrt(1 - l2 / l1) if l1 else 0.0, "solidity": n / max(hull, n), "convex_hull_area": max(hull, float(n)), "orientation": angle,
        "euler_number": float(_euler(m)), "extent": n / float(box), "equivalent_diameter": math.sqrt(4 * n / math.pi),
        "aspect_ratio": major / minor if minor else NAN, "circularity": 4 * math.pi * n / perimeter**2 if perimeter else NAN, "roundness": 4 * n / (math.pi * major**2) if major else NAN,
    }


def intensity(stat: str) -> PropertyFunction:
    f = STATS[stat]

    def run(image: Plane | None, mask: Plane | None) -> dict[str, float]:
        return {f"intensity_{stat}": float(f(image)) if image is not None and image.ndim == 2 and image.size else NAN}

    return run


def masked_intensity(stat: str) -> PropertyFunction:
    """Over the foreground; std and variance need two pixels; NaN if shapes differ."""
    f = STATS[stat]

    def run(image: Plane | None, mask: Plane | None) -> dict[str, float]:
        x = image[foreground(mask)] if image is not None and mask is not None and image.shape == mask.shape else np.empty(0)
        return {f"intensity_{stat}_masked": float(f(x)) if len(x) >= (2 if stat in ("std", "variance") else 1) else NAN}

    return run


def entropy(image: Plane | None, mask: Plane | None) -> dict[str, float]:
    """Shannon entropy in bits over distinct values."""
    _, n = np.unique(image, return_counts=True)
    p = n / n.sum()
    return {"intensity_entropy": float(-(p * np.log2(p)).sum())}


def _box(x: Plane, size: int, axis: int) -> Plane:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (size // 2, size - 1 - size // 2)
    c = np.cumsum(np.insert(np.pad(x, pad, mode="edge"), 0, 0, axis=axis), axis=axis)
    n = x.shape[axis]
    return (np.take(c, np.arange(size, size + n), axis) - np.take(c, np.arange(n), axis)) / size


def sharpness(image: Plane | None, mask: Plane | None, size: int = 11) -> dict[str, float]:
    """How blurred an image is, 0 sharp to 1: the loss of gradient when it is blurred again; the larger of both axes."""
    x = np.asarray(image, float)
    out = []
    for axis in (0, 1):
        if x.shape[axis] < 3:
            continue
        grad = lambda v: np.abs(np.gradient(v, axis=axis))  # noqa: E731,B023
        sharp, blurred = grad(x), grad(_box(x, size, axis))
        inner = (slice(2, -1), slice(2, -1)) if min(x.shape) > 4 else (slice(None), slice(None))
        s = sharp[inner].sum()
        out.append(abs(s - np.maximum(0, sharp - blurred)[inner].sum()) / s if s else 0.0)
    return {"sharpness_metric": float(max(out)) if out else NAN}


def edge_distance(m: Plane) -> Plane:
    """Exact euclidean distance of foreground pixels to the background (the frame is not background)."""
    h, w = m.shape
    big = float(h + w) ** 2
    f = np.where(m, big, 0.0)
    for axis in (0, 1):
        g = f if axis == 0 else f.T
        n = g.shape[0]
        i = np.arange(n)
        cost = (i[:, None] - i[None, :]) ** 2
        g = np.stack([(cost + col[None, :]).min(1) for col in g.T], 1)
        f = g if axis == 0 else g.T
    return np.sqrt(f)


def rings(count: int = 3, stats: tuple[str, ...] = ("mean", "std")) -> PropertyFunction:
    """Statistics in concentric rings of equal width in distance to the edge; ring 1 is the outermost."""

    def run(image: Plane | None, mask: Plane | None) -> dict[str, float]:
        m = foreground(mask)
        out = {f"ring_{i + 1}_{s}": NAN for i in range(count) for s in stats}
        if not m.any() or image is None or image.shape != m.shape:
            return out
        d = edge_distance(m)
        ring = np.minimum((d / d.max() * count + 1e-12).astype(int), count - 1)
        for i in range(count):
            x = image[m & (ring == i)]
            if len(x):
                out |= {f"ring_{i + 1}_{s}": float(STATS[s](x)) for s in stats}
        return out

    return run


def texture(image: Plane | None, mask: Plane | None, levels: int = 256) -> dict[str, float]:
    """Co-occurrence measures at distance 1 in the frame of the foreground, mean over 0, 45, 90 and 135 degrees; intensities
    are scaled to [0, 1] and the background is level 0. NaN without a fitting mask."""
    out = {f"texture_{n}": NAN for n in TEXTURE}
    if image is None or mask is None or image.shape != mask.shape or not foreground(mask).any():
        return out
    m = foreground(mask)
    ys, xs = np.flatnonzero(m.any(1)), np.flatnonzero(m.any(0))
    box = (slice(ys[0], ys[-1] + 1), slice(xs[0], xs[-1] + 1))
    x = np.asarray(image, float)[box]
    if x.size < 4:
        return out
    lo, div = resolve_scale(float(x.min()), float(x.max()), np.dtype(float))
    q = np.where(m[box], (x - lo) / div * (levels - 1), 0).astype(int)
    got = []
    h, w = q.shape
    for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1)):
        a = q[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
        b = q[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
        if not a.size:
            continue
        g = np.bincount(a.ravel() * levels + b.ravel(), minlength=levels * levels).reshape(levels, levels).astype(float)
        g = g + g.T
        g /= g.sum()
        i, j = np.mgrid[:levels, :levels]
        mi, mj = (g * i).sum(), (g * j).sum()
        si, sj = math.sqrt((g * (i - mi) ** 2).sum()), math.sqrt((g * (j - mj) ** 2).sum())
        asm = (g * g).sum()
        got.append(((g * (i - j) ** 2).sum(), (g * abs(i - j)).sum(), (g / (1 + (i - j) ** 2)).sum(), math.sqrt(asm), 1.0 if si < 1e-15 or sj < 1e-15 else (g * (i - mi) * (j - mj)).sum() / (si * sj), asm))
    return {f"texture_{n}": float(v) for n, v in zip(TEXTURE, np.mean(got, 0))} if got else out


def _gauss(x: Plane, sigma: float) -> Plane:
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        x = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, np.pad(x, pad, mode="edge"))
    return x


def _overlap(r1: float, r2: float, d: float) -> float:
    """Common area of two discs as a share of the smaller one."""
    if d >= r1 + r2:
        return 0.0
    if d <= abs(r1 - r2):
        return 1.0
    a1 = r1 * r1 * math.acos((d * d + r1 * r1 - r2 * r2) / (2 * d * r1))
    a2 = r2 * r2 * math.acos((d * d + r2 * r2 - r1 * r1) / (2 * d * r2))
    lens = 0.5 * math.sqrt(max(0.0, (r1 + r2 - d) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2)))
    return (a1 + a2 - lens) / (math.pi * min(r1, r2) ** 2)


# fixed values: the defaults of the blob measure, and the widest sigma it looks for (the shorter side over 12, within 5 and 50)
WIDEST = (12.0, 5.0, 50.0)


def blobs(image: Plane | None, mask: Plane | None, low: float = 2.0, ratio: float = 1.6, threshold: float = 0.06, relative: float = 0.1, overlap: float = 0.3, border: int = 2) -> dict[str, float]:
    """Bright blobs by difference of Gaussians: their number, and mean and std of area 2 pi sigma^2 and of the scaled
    intensity at the centre. The widest sigma follows the image size; of blobs that overlap by over ``overlap`` the larger
    stays. NaN for a missing, non-finite or not two-dimensional image; zeros where nothing is found."""
    names = ("blob_count", "blob_area_mean", "blob_area_std", "blob_intensity_mean", "blob_intensity_std")
    if image is None or image.ndim != 2 or not np.isfinite(image).all():
        return dict.fromkeys(names, NAN)
    x = np.asarray(image, float)
    h, w = x.shape
    if min(h, w) < 3 or np.ptp(x) <= 0:
        return dict.fromkeys(names, 0.0)
    lo, div = resolve_scale(float(x.min()), float(x.max()), image.dtype)
    x = (x - lo) / div
    high = max(WIDEST[1], min(WIDEST[2], min(h, w) / WIDEST[0]))
    sig = low * ratio ** np.arange(int(math.log(high / low, ratio) + 1) + 1)
    levels = [_gauss(x, s) for s in sig]
    cube = np.stack([(a - b) / (ratio - 1) for a, b in zip(levels, levels[1:])])
    p = np.pad(cube, 1, constant_values=-np.inf)
    top = np.max([p[1 + a : p.shape[0] - 1 + a, 1 + b : p.shape[1] - 1 + b, 1 + c : p.shape[2] - 1 + c] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)], 0)
    at = np.argwhere((cube == top) & (cube > max(threshold, relative * cube.max())))
    at = at[(at[:, 1] >= border) & (at[:, 1] < h - border) & (at[:, 2] >= border) & (at[:, 2] < w - border)]
    kept: list = []
    for k, y, c in at[np.argsort(-at[:, 0], kind="stable")]:
        r = math.sqrt(2) * sig[k]
        if all(_overlap(r, math.sqrt(2) * sig[k2], math.hypot(y - y2, c - c2)) <= overlap for k2, y2, c2 in kept):
            kept.append((k, y, c))
    if not kept:
        return dict.fromkeys(names, 0.0)
    area = np.array([2 * math.pi * sig[k] ** 2 for k, _, _ in kept])
    light = np.array([x[y, c] for _, y, c in kept])
    return dict(zip(names, (float(len(kept)), float(area.mean()), float(area.std()), float(light.mean()), float(light.std()))))


# fixed values: shape measures of the presets
BASIC_SHAPE = ("area", "perimeter", "eccentricity", "solidity")
FULL_SHAPE = ("area", "major_axis_length", "minor_axis_length", "perimeter", "eccentricity", "solidity")
EXTENDED_SHAPE = (*FULL_SHAPE, "orientation", "extent", "equivalent_diameter", "euler_number", "circularity")


def shape_of(names: tuple[str, ...], derived: dict[str, Callable[[dict], float]] | None = None) -> PropertyFunction:
    """Some of the shape measures, and further ones derived from them."""
    wrong = [n for n in names if n not in SHAPE]
    if wrong:
        raise ValueError(f"unknown shape measures {wrong}")

    def run(image: Plane | None, mask: Plane | None) -> dict[str, float]:
        s = shape(image, mask)
        return {n: s[n] for n in names} | {n: float(f(s)) for n, f in (derived or {}).items()}

    return run


def preset(name: str) -> list[tuple[str, PropertyFunction]]:
    """``(requirement, function)`` of a preset; requirements are image, mask, both or any."""
    four = [("image", intensity(s)) for s in ("mean", "std", "min", "max")]
    masked = lambda *s: [("both", masked_intensity(x)) for x in s]
    table = {
        "none": [],
        "basic": [*four[:2], ("mask", shape_of(BASIC_SHAPE)), *masked("mean", "std")],
        "shape": [("mask", shape_of(FULL_SHAPE))],
        "intensity": four,
        "standard": [*four, ("mask", shape_of(FULL_SHAPE)), *masked("mean", "std"), ("both", rings())],
        "complete": [*four, ("image", sharpness), ("image", entropy), ("mask", shape_of(EXTENDED_SHAPE)), *masked("mean", "std", "min", "max"), ("both", rings()), ("both", texture)],
    }
    if name not in table:
        raise ValueError(f"preset must be one of {sorted(table)}, not {name!r}")
    return table[name]


def resolve_scale(lo: float, hi: float, dtype: np.dtype) -> tuple[float, float]:
    """(offset, divisor) to [0, 1]: identity up to 1; min-max where negative; else the first of 255, 65535 and 2^32 - 1 that
    holds the values, the type's maximum, or the data's. What is seen counts before the type."""
    if lo < 0:
        return lo, (hi - lo) or 1.0
    if hi <= 1:
        return 0.0, 1.0
    for top in (255.0, 65535.0, 4294967295.0):
        if hi <= top:
            return 0.0, top
    return 0.0, float(np.iinfo(dtype).max) if np.issubdtype(dtype, np.integer) else hi


def scale_minmax(x: Plane) -> Plane:
    """Per channel to [0, 1]; a constant channel becomes 0."""
    lo, hi = x.min((0, 1), keepdims=True), x.max((0, 1), keepdims=True)
    return (x - lo) / np.where(hi > lo, hi - lo, 1)


def quantile_normalize(x: Plane, q: float = 0.99) -> Plane:
    lo, hi = np.quantile(x, 1 - q, (0, 1), keepdims=True), np.quantile(x, q, (0, 1), keepdims=True)
    return np.clip((x - lo) / np.where(hi > lo, hi - lo, 1), 0, 1)


def pad_to(x: Plane, size: int) -> Plane:
    h, w = x.shape[:2]
    t, left = max(0, size - h) // 2, max(0, size - w) // 2
    return np.pad(x, ((t, max(0, size - h) - t), (left, max(0, size - w) - left), *[(0, 0)] * (x.ndim - 2)))


# fixed values: mean and standard deviation of the three channels that most public vision models expect
IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))


def standardize(x: Plane, mean: tuple[float, ...], std: tuple[float, ...]) -> Plane:
    """Per channel (x - mean) / std; with more channels than means the first of them holds for all."""
    c = x.shape[2]
    m, d = (np.asarray(v[:c] if len(v) >= c else (v[0],) * c, np.float32) for v in (mean, std))
    return (x - m) / d


def resize(x: Plane, size: int) -> Plane:
    """Bilinear to size x size."""
    h, w = x.shape[:2]
    ys, xs = (np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1) for n in (h, w))
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    if x.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    return (x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx) * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy


def to_rgb(x: Plane) -> Plane:
    """Three channels: one is repeated, two get a zero third, more are cut."""
    c = x.shape[2]
    if c == 1:
        return np.repeat(x, 3, 2)
    return np.concatenate([x, np.zeros_like(x[..., :1])], 2) if c == 2 else x[..., :3]
