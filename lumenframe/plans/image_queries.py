"""Queries over image files. Each writes a few small images to the shared folder and works on those; the SQL has what must
come out, counted from the pixels' formula."""

from __future__ import annotations

import io
import math
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import image_properties as ip
from lumenframe.plans.catalogue import query
from lumenframe.plans.session import ImageFailures, Session
from lumenframe.runtime import shared_dir, ship
from lumenframe.sources import discovery as Y
from lumenframe.sources import images as I
from lumenframe.sources.store import ResultStore


def png_bytes(x: np.ndarray) -> bytes:
    """A plain PNG of 8 or 16 bits."""
    h, w, c = x.shape
    raw = b"".join(b"\0" + r.astype(x.dtype.newbyteorder(">")).tobytes() for r in x)
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", w, h, x.itemsize * 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def tiff_bytes(x: np.ndarray) -> bytes:
    """A TIFF of one gray strip."""
    data, h, w = x.tobytes(), *x.shape
    tags = [(256, 4, w), (257, 4, h), (258, 3, x.itemsize * 8), (259, 3, 1), (273, 4, 8), (277, 3, 1), (279, 4, len(data)), (339, 3, 1)]
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I", v) for t, k, v in tags) + b"\0\0\0\0"
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + body


def npy_bytes(x: np.ndarray) -> bytes:
    b = io.BytesIO()
    np.save(b, x)
    return b.getvalue()


RAMP = np.arange(256, dtype=np.uint8).reshape(16, 16, 1)  # pixel (y, x) has 16 y + x
SQUARE = np.zeros((16, 16, 1), np.uint8)
SQUARE[3:13, 3:13] = 1
FILES = {
    "in/DrugA/24h/sample_1.png": png_bytes(np.full((16, 16, 3), 10, np.uint8)),
    "in/DrugA/24h/sample_2.png": png_bytes(np.full((16, 16, 3), 80, np.uint8)),
    "in/DrugB/48h/sample_3.png": png_bytes(np.full((16, 16, 3), 200, np.uint8)),
    "in/notes.txt": b"no image",
    "mixed/a/gray.npy": npy_bytes(np.arange(24, dtype=np.uint16).reshape(2, 4, 3)),
    "mixed/a/deep.png": png_bytes((np.arange(12, dtype=np.uint16) * 5000).reshape(3, 4, 1)),
    "mixed/b/plate.tif": tiff_bytes((np.arange(12, dtype=np.uint16) * 7).reshape(3, 4)),
    "mixed/b/broken.png": b"not an image",
    "mixed/b/ramp.png": png_bytes(RAMP),
    "masks/b/ramp.png": png_bytes(SQUARE),
    "masks/a/gray.png": png_bytes(SQUARE[:2, :4]),
    "masks/x/deep.png": png_bytes(SQUARE),
    "masks/y/deep.png": png_bytes(SQUARE),
    "wells/w1_c0.png": png_bytes(np.full((4, 4, 1), 30, np.uint8)),
    "wells/w1_c1.png": png_bytes(np.full((4, 4, 1), 60, np.uint8)),
    "wells/w2_c0.png": png_bytes(np.full((4, 4, 1), 90, np.uint8)),
    "wells/w2_c1.png": png_bytes(np.full((4, 4, 1), 120, np.uint8)),
}


def fixture(s: SparkSession) -> str:
    """Folder with the files above, below the shared folder."""
    ship(s)
    root = f"{shared_dir(s)}/images-{uuid.uuid4().hex}"
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for name, data in FILES.items():
        out = system.create(path(f"{root}/{name}"), True)
        out.write(bytearray(data))
        out.close()
    return root


def _tail(c: str, folder: str):
    return F.regexp_replace(c, f"^.*/{folder}/", f"{folder}/")


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if v is None else repr(v) for v in r) + ')' for r in rows)}) t({names})"


@query(_values([(n, len(b)) for n, b in FILES.items() if n.startswith("in/") and n.endswith(".png")], "file, size").replace("SELECT *", "SELECT file, size::BIGINT AS size"))
def image_scan(s, d):
    return Y.scan(s, fixture(s) + "/in").select(_tail("file_path", "in").alias("file"), "size")


@query(_values([("mixed/a/deep.png",), ("mixed/b/broken.png",), ("mixed/b/ramp.png",)], "file"))
def image_glob(s, d):
    return Y.scan(s, fixture(s) + "/mixed/*/*.png").select(_tail("file_path", "mixed").alias("file"))


@query(_values([(0, "DrugA", "24h", "sample_1"), (1, "DrugA", "24h", "sample_2"), (2, "DrugB", "48h", "sample_3")], "image_index, drug, time, name").replace("SELECT *", "SELECT image_index::BIGINT AS image_index, drug, time, name"))
def image_discover(s, d):
    return Session.find_files(s, fixture(s) + "/in", template=".../(drug)/(time)/(name).*").catalog.select("image_index", "drug", "time", "name")


@query("SELECT * FROM (VALUES (0::BIGINT, 'w1', 2::BIGINT, 'wells/w1_c0.png'), (1, 'w2', 2, 'wells/w2_c0.png')) t(image_index, well, channels, first)")
def image_discover_channels(s, d):
    """A table with one file-name column a channel."""
    lut = s.createDataFrame([("w1_c0", "w1_c1.png", "w1"), ("w2_c0", "w2_c1", "w2")], "ch0 string, ch1 string, well string")
    c = Session.find_files(s, fixture(s) + "/wells", lookup=lut, filename=["ch0", "ch1"]).catalog
    return c.select("image_index", "well", F.size("channel_paths").cast("bigint").alias("channels"), _tail("image_path", "wells").alias("first"))


def _number(path: str) -> dict:
    return {"number": int(path.rsplit("_", 1)[1].split(".")[0]) * 10}  # a ValueError or IndexError where there is none


@query(_values([("sample_1", "10"), ("sample_2", "20"), ("sample_3", "30")], "name, number"))
def image_discover_function(s, d):
    f = Y.callable_metadata(Y.scan(s, fixture(s) + "/in").select("file_path"), _number, ["number"])
    return f.select(F.regexp_extract("file_path", r"([^/]+)\.png$", 1).alias("name"), "number")


SEEN = [
    ("mixed/a/deep.png", 3, 4, 1, "uint16", 0.0, 55000.0), ("mixed/a/gray.npy", 4, 3, 2, "uint16", 0.0, 23.0),  # the smallest axis is the channels
    ("mixed/b/broken.png", -1, -1, -1, None, -1.0, -1.0), ("mixed/b/plate.tif", 3, 4, 1, "uint16", 0.0, 77.0), ("mixed/b/ramp.png", 16, 16, 1, "uint8", 0.0, 255.0),
]


@query("SELECT file, height::INTEGER AS height, width::INTEGER AS width, channels::INTEGER AS channels, dtype, low::DOUBLE AS low, high::DOUBLE AS high, height < 0 AS failed FROM (" + _values(SEEN, "file, height, width, channels, dtype, low, high") + ")")
def image_inspect(s, d):
    i = I.inspect(Session.find_files(s, fixture(s) + "/mixed").catalog)
    known = {c: F.coalesce(c, F.lit(-1)) for c in ("height", "width", "channels")} | {n: F.coalesce(c, F.lit(-1.0)) for n, c in (("low", "min"), ("high", "max"))}
    return i.withColumns(known).select(_tail("path", "mixed").alias("file"), "height", "width", "channels", "dtype", "low", "high", F.col("error").isNotNull().alias("failed"))


@query(_values([("error", "1 files cannot be read"), ("warning", "3 different shapes"), ("warning", "2 different types")], "level, finding"))
def image_preflight(s, d):
    return Y.findings(Y.preflight(I.inspect(Session.find_files(s, fixture(s) + "/mixed").catalog), ["path"]))


@query(_values([("mixed/a/deep.png", None), ("mixed/a/gray.npy", "masks/a/gray.png"), ("mixed/b/broken.png", None), ("mixed/b/plate.tif", None), ("mixed/b/ramp.png", "masks/b/ramp.png")], "file, mask"))
def image_masks(s, d):
    """Masks under another root, by relative path or by an unambiguous name."""
    root = fixture(s)
    plain = root.removeprefix("file://")
    c = Y.resolve_masks(Session.find_files(s, root + "/mixed").catalog, Y.scan(s, root + "/masks").select("file_path"), root=f"{plain}/mixed", mask_root=f"{plain}/masks")
    return c.select(_tail("image_path", "mixed").alias("file"), _tail("mask_path", "masks").alias("mask"))


# the ramp under the square mask: every figure follows from the pixels
_PX = {
    "px": "SELECT y, x, (16 * y + x)::DOUBLE AS v, (y BETWEEN 3 AND 12 AND x BETWEEN 3 AND 12) AS m, least(y - 2, 13 - y, x - 2, 13 - x) AS d FROM range(16) a(y), range(16) b(x)",
    "ring": "SELECT v, least((d * 3) // 5, 2) + 1 AS k FROM px WHERE m",
    "step": "SELECT o, abs(a.v - b.v) AS gap FROM px a JOIN px b ON a.m AND b.m JOIN (VALUES (1, 0, 1), (2, -1, 1), (3, -1, 0), (4, -1, -1)) t(o, dy, dx) ON b.y = a.y + dy AND b.x = a.x + dx",
    "whole": "SELECT avg(v) AS intensity_mean, stddev_pop(v) AS intensity_std, min(v) AS intensity_min, max(v) AS intensity_max, -sum(1 / 256.0 * log2(1 / 256.0)) AS intensity_entropy FROM px",
    "inner": "SELECT avg(v) AS intensity_mean_masked, stddev_pop(v) AS intensity_std_masked, min(v) AS intensity_min_masked, max(v) AS intensity_max_masked, count(*)::DOUBLE AS area FROM px WHERE m",
    # a filled square of side a: 4 (a - 1) border steps, second moments (a^2 - 1) / 12 + 1 / 12
    "form": f"SELECT area, 4 * (sqrt(area) - 1) AS perimeter, 4 * sqrt(area / 12) AS major_axis_length, 4 * sqrt(area / 12) AS minor_axis_length, 0.0::DOUBLE AS eccentricity, 1.0::DOUBLE AS solidity, {math.pi} / 4 AS orientation, 1.0::DOUBLE AS extent, sqrt(4 * area / {math.pi}) AS equivalent_diameter, 1.0::DOUBLE AS euler_number, 4 * {math.pi} * area / (4 * (sqrt(area) - 1)) ** 2 AS circularity FROM inner_",
    "rings": "SELECT " + ", ".join(f"avg(v) FILTER (k = {k}) AS ring_{k}_mean, stddev_pop(v) FILTER (k = {k}) AS ring_{k}_std" for k in (1, 2, 3)) + " FROM ring",
    "grain": "SELECT avg(c) AS texture_contrast, avg(l) AS texture_dissimilarity, avg(h) AS texture_homogeneity FROM (SELECT o, avg(gap * gap) AS c, avg(gap) AS l, avg(1 / (1 + gap * gap)) AS h FROM step GROUP BY o)",
}
_PX = {("inner_" if k == "inner" else k): v for k, v in _PX.items()}
_HOME = {"whole": "intensity_mean intensity_std intensity_min intensity_max intensity_entropy", "inner_": "intensity_mean_masked intensity_std_masked intensity_min_masked intensity_max_masked", "form": "area perimeter major_axis_length minor_axis_length eccentricity solidity orientation extent equivalent_diameter euler_number circularity", "rings": "ring_1_mean ring_1_std ring_2_mean ring_2_std ring_3_mean ring_3_std", "grain": "texture_contrast texture_dissimilarity texture_homogeneity"}
_OPEN = ("sharpness_metric", "texture_energy", "texture_correlation", "texture_asm")  # no closed form: held against numpy in the tests


def _preset(name: str):
    names = [n for n in I.property_names(ip.preset(name), ["0"]) if n not in _OPEN]
    where = {n: k for k, v in _HOME.items() for n in v.split()}

    def run(s: SparkSession, d: str) -> DataFrame:
        root = fixture(s)
        c = Session.find_files(s, root + "/mixed").catalog.where(F.col("image_path").endswith("ramp.png")).withColumn("mask_path", F.lit(root + "/masks/b/ramp.png"))
        p = Session(c).compute_properties(None, name).properties
        cells = [F.struct(F.lit(n).alias("property"), F.round(n, 4).alias("value")) for n in names]
        return p.select(F.explode(F.array(*cells)).alias("x")).select("x.*")

    run.__name__ = f"image_preset_{name}"
    run.__doc__ = f"The properties of preset {name} of a ramp under a square mask."
    query(" UNION ALL ".join(f"SELECT '{n}' AS property, round({n}, 4) AS value FROM {where[n]}" for n in names), **_PX)(run)
    return run


for _name in ("basic", "shape", "intensity", "standard", "complete"):
    _preset(_name)


def toy_model():
    """Eight numbers an image: its mean plus 0 to 7."""
    return lambda b: b.mean((1, 2, 3))[:, None] + np.arange(8, dtype=np.float32)


_EMB = "SELECT image_index::BIGINT AS image_index, pos::BIGINT AS pos, round({x}, 5) AS x FROM (VALUES (0, 10 / 255.0), (1, 80 / 255.0), (2, 200 / 255.0)) t(image_index, m), range({n}) r(pos)"


def _flat(e: DataFrame, digits: int = 5) -> DataFrame:
    return e.select("image_index", F.posexplode("embedding").alias("pos", "x")).select("image_index", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("x").cast("double"), digits).alias("x"))


@query(_EMB.format(x="m + pos", n=8))
def image_embeddings(s, d):
    root = fixture(s) + "/in"
    return _flat(Session.find_files(s, root).process_images(None, toy_model, size=32, batch_size=2).embeddings)


@query(_EMB.format(x="(m + pos % 8) / sqrt(8 * m * m + 56 * m + 140)", n=24))
def image_embeddings_split(s, d):
    """One vector a channel, normalised and put together."""
    return _flat(Session.find_files(s, fixture(s) + "/in").process_images(None, toy_model, size=32, channel_mode="split").embeddings)


@query(_EMB.format(x="((m / 4 - 0.485) / 0.229 + (m / 4 - 0.456) / 0.224 + (m / 4 - 0.406) / 0.225) / 3 * 2 + pos", n=8))
def image_transforms(s, d):
    """Black margins to twice the side, means and deviations of the channels, and a function of the caller."""
    c = Session.find_files(s, fixture(s) + "/in")
    return _flat(c.process_images(None, toy_model, size=None, pad=32, normalize=ip.IMAGENET, transforms=[lambda x: x * 2]).embeddings)


@query("SELECT 1::BIGINT AS first, 3::BIGINT AS total, 3::BIGINT AS images, 0::BIGINT AS again")
def image_resume(s, d):
    """A run over one drug, then one over all: stored images are not computed twice."""
    root = fixture(s)
    st = ResultStore(s, root + "/store")
    c = Session.find_files(s, root + "/in", template=".../(drug)/(time)/(name).*")
    c.process_images(None, toy_model, {"drug": "DrugB"}, st=st, size=32)
    first = st.read("embeddings").count()
    c.process_images(None, toy_model, st=st, size=32)
    then = len(st._manifest()["tables"]["embeddings"])
    c.process_images(None, toy_model, st=st, size=32)
    e = st.read("embeddings")
    again = e.count() - 3
    return e.agg(F.lit(first).cast("bigint").alias("first"), F.count("*").alias("total"), F.count_distinct("image_index").alias("images"), F.lit(again).cast("bigint").alias("again")).where(F.lit(then == 2))


@query("SELECT * FROM (VALUES ('memory', 4::BIGINT, 4::BIGINT, 0::BIGINT), ('stored', 5, 4, 1)) t(mode, images, kept, raised)")
def image_failures(s, d):
    """A broken file: in memory its row leaves with a warning, in a store the others are kept and the failure is raised."""
    import warnings

    root = fixture(s)
    c = Session.find_files(s, root + "/mixed")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        m = c.process_images(None, toy_model, size=16)
    st, raised = ResultStore(s, root + "/store"), 0
    try:
        c.process_images(None, toy_model, st=st, size=16)
    except ImageFailures as e:
        raised = e.n
    rows = [("memory", m.catalog.count(), m.embeddings.count(), 0), ("stored", c.catalog.count(), st.read("embeddings").count(), raised)]
    return s.createDataFrame(rows, "mode string, images bigint, kept bigint, raised bigint")


@query(_EMB.format(x="m + pos", n=8))
def image_session_roundtrip(s, d):
    """Catalog, embeddings and properties saved and loaded again."""
    root = fixture(s)
    c = Session.find_files(s, root + "/in").process_images(None, toy_model, size=32).compute_properties(None, "intensity", channels=["r", "g", "b"])
    st = ResultStore(s, root + "/saved")
    c.save(st)
    back = Session.load(st)
    p = back.properties.where("intensity_max_r = intensity_mean_g AND intensity_std_b = 0").select("image_index")
    return _flat(back.embeddings.join(p, "image_index"))


@query("SELECT image_index, property, round(value, 6) AS value FROM (VALUES (0::BIGINT, 'r', 10.0::DOUBLE), (1, 'r', 80.0), (2, 'r', 200.0), (0, 'span', 0.0), (1, 'span', 0.0), (2, 'span', 0.0)) t(image_index, property, value)")
def image_own_property(s, d):
    """A property function of the caller beside a preset."""
    span = [("image", lambda image, mask: {"span": float(np.ptp(image))})]
    p = Session.find_files(s, fixture(s) + "/in").compute_properties(None, "intensity", extra=span, channels=["r", "g", "b"]).properties
    return p.select("image_index", F.explode(F.array(F.struct(F.lit("r").alias("property"), F.col("intensity_mean_r").alias("value")), F.struct(F.lit("span").alias("property"), F.col("span_g").alias("value")))).alias("x")).select("image_index", "x.*")
