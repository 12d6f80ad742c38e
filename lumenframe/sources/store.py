"""Results on disk: parquet tables with small numbered manifests; appends are atomic, since files count only on commit."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0"


class ConcurrentWriteError(RuntimeError):
    """Another writer has changed the store since this one read it; nothing of this write counts, and it may be repeated."""


class ResultStore:
    """Tables ``catalog``, ``embeddings``, ``properties`` and ``batch_stats`` below one folder of any Hadoop file system.

    A manifest names the folder versions that count. Manifests are numbered and never replaced: a write makes the next
    number, which fails if another writer has made it, and readers take the highest. So a writer that dies leaves the former
    state, a reader always finds a whole manifest, and of two writers the later one gets an error instead of undoing the
    earlier. Folders that no manifest names are ignored.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._Path(self.path).getFileSystem(conf)

    def _numbers(self) -> list[int]:
        at = self._Path(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"version": VERSION, "number": 0, "tables": {}, "params": {}, "log": []}
        text = self.spark.read.text(f"{self.path}/manifests/{numbers[-1]:012d}.json", wholetext=True).first()[0]
        m = json.loads(text)
        if m["version"] != VERSION:
            raise ValueError(f"stored version {m['version']}, expected {VERSION}")
        return m

    def _commit(self, m: dict) -> None:
        """Write manifest ``m`` as the one after that it was read from."""
        m = m | {"number": m["number"] + 1}
        name = f"{self.path}/manifests/{m['number']:012d}"
        tmp, claim, to = self._Path(f"{name}-{uuid.uuid4().hex}.tmp"), self._Path(f"{name}.claim"), self._Path(f"{name}.json")
        self._fs.mkdirs(to.getParent())
        if (self._numbers() or [0])[-1] >= m["number"]:
            raise ConcurrentWriteError(f"another writer has changed {self.path}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(m, default=str).encode()))
        out.close()
        mine = False
        try:
            # the claim is made by one writer only; it is the writer that may put the whole file in its place
            mine = self._fs.createNewFile(claim)
            if not mine or self._fs.exists(to) or not self._fs.rename(tmp, to):
                raise ConcurrentWriteError(f"another writer has changed {self.path}")
        finally:
            if mine:
                self._fs.delete(claim, False)
            self._fs.delete(tmp, False)

    def break_claim(self) -> None:
        """Take away the claim of a writer that died between claiming a manifest and writing it."""
        at = self._Path(f"{self.path}/manifests")
        for f in self._fs.listStatus(at) if self._fs.exists(at) else ():
            if f.getPath().getName().endswith(".claim"):
                self._fs.delete(f.getPath(), False)

    def _put(self, name: str, df: DataFrame, append: bool, note: str) -> None:
        m = self._manifest()
        part = f"{name}/v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        m["tables"][name] = [*(m["tables"].get(name, []) if append else []), part]
        m["log"].append({"at": datetime.now(timezone.utc).isoformat(), "step": note, "table": name})
        self._commit(m)

    def write(self, name: str, df: DataFrame) -> None:
        """Replace a table."""
        self._put(name, df, False, "write")

    def append(self, name: str, df: DataFrame) -> None:
        self._put(name, df, True, "append")

    def read(self, name: str) -> DataFrame:
        """The table; columns that only some appends have are null elsewhere."""
        parts = self._manifest()["tables"].get(name)
        if not parts:
            raise FileNotFoundError(f"no table {name!r} in {self.path}")
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{p}" for p in parts])

    def has(self, name: str) -> bool:
        return bool(self._manifest()["tables"].get(name))

    def embeddings_of(self, indices: list[int]) -> DataFrame:
        """Rows by index; the predicate reaches the parquet scan."""
        return self.read("embeddings").where(F.col("image_index").isin([int(i) for i in indices]))

    def update_embeddings(self, changed: DataFrame) -> None:
        from lumenframe.operators.joins import update_vectors

        self._put("embeddings", update_vectors(self.read("embeddings"), changed), False, "update")

    def table_lengths(self) -> dict[str, int]:
        """Rows of each table. Properties of images that the catalog lacks are an error."""
        n = {name: self.read(name).count() for name in self._manifest()["tables"]}
        if "catalog" in n and "properties" in n:
            lost = self.read("properties").join(self.read("catalog"), "image_index", "left_anti").limit(1)
            if not lost.isEmpty():
                raise ValueError("properties of images that the catalog lacks")
        return n

    def clear_properties(self) -> None:
        m = self._manifest()
        m["tables"].pop("properties", None)
        self._commit(m)

    def clone(self, path: str) -> ResultStore:
        to = ResultStore(self.spark, path)
        for name in self._manifest()["tables"]:
            to.write(name, self.read(name))
        to._commit(to._manifest() | {"params": self._manifest()["params"]})
        return to

    def set_params(self, params: dict) -> None:
        m = self._manifest()
        m["params"] = params
        self._commit(m)

    def params(self) -> dict:
        return self._manifest()["params"]

    def validate_params(self, params: dict) -> None:
        """A resumed run must use the stored settings."""
        have = self._manifest()["params"]
        wrong = {k: (have[k], v) for k, v in params.items() if k in have and have[k] != v}
        if wrong:
            raise ValueError(f"settings differ from the stored ones: {wrong}")

    def run_log(self) -> list[dict]:
        return self._manifest()["log"]

    def experiment_config(self) -> str:
        m = self._manifest()
        return json.dumps({"version": m["version"], "params": m["params"], "tables": sorted(m["tables"]), "steps": m["log"]}, indent=2)

    def methods_markdown(self) -> str:
        m = self._manifest()
        lines = ["# Methods", "", *[f"- {k}: {v}" for k, v in sorted(m["params"].items())], "", "## Steps", "", *[f"1. {s['step']} {s['table']} ({s['at']})" for s in m["log"]]]
        return "\n".join(lines)


def export_frame(images: DataFrame, distances: DataFrame | None = None, vec: str | None = None, dim: int | None = None, key: str = "image_index") -> DataFrame:
    """Catalog and properties, left-joined distances, and the vector as ``embedding_0..``."""
    out = images.drop(vec) if vec and vec in images.columns else images
    if distances is not None:
        out = out.join(distances.select(key, "distance"), key, "left")
    if vec and dim:
        v = images.select(key, *[F.get(vec, F.lit(i)).cast("double").alias(f"embedding_{i}") for i in range(dim)])
        out = out.join(v, key, "left")
    return out


EXCEL_ROWS = 1_048_575  # fixed value: the most rows an Excel sheet holds below its head


def export_embeddings(embeddings: DataFrame, path: str, key: str = "image_index", vec: str = "embedding") -> list[str]:
    """Vectors as .npy files beside a table, one a partition in the order of the keys, with their keys in ``*.keys.npy``.

    Tasks write them; ``path`` is a folder that all executors share. Null vectors are left out. Returns the files' names.
    """
    os.makedirs(path, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, rows = [], []
        for b in batches:
            ids += b.column(key).to_pylist()
            rows += [np.asarray(v, np.float32) for v in b.column(vec).to_pylist()]
        if not rows:
            return
        name = f"{path}/part-{TaskContext.get().partitionId():05d}"
        for at, x in ((f"{name}.keys.npy", np.asarray(ids)), (f"{name}.npy", np.stack(rows))):
            tmp = f"{at}.{uuid.uuid4().hex}"
            with open(tmp, "wb") as f:
                np.save(f, x)
            os.replace(tmp, at)
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.npy"])], names=["file"])

    e = embeddings.where(F.col(vec).isNotNull()).select(key, vec).repartitionByRange(key).sortWithinPartitions(key)
    return sorted(r[0] for r in e.mapInArrow(write, "file string").collect())


def export_table(df: DataFrame, path: str, fmt: str | None = None) -> str:
    """Write csv, parquet, json or excel; the extension of the path beats ``fmt``. Excel goes through the driver, needs an
    Excel writer and is refused beyond what a sheet holds; arrays become JSON text in csv. Returns the format used."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    kind = {"csv": "csv", "parquet": "parquet", "json": "json", "xlsx": "excel", "xls": "excel"}.get(ext, fmt or "csv")
    if kind == "excel":
        if df.limit(EXCEL_ROWS + 1).count() > EXCEL_ROWS:
            raise ValueError(f"an Excel sheet holds at most {EXCEL_ROWS} rows")
        try:
            df.toPandas().to_excel(path, index=False)
        except ImportError as e:
            raise RuntimeError("no Excel writer is installed") from e
    elif kind == "csv":
        nested = [f.name for f in df.schema if f.dataType.simpleString().startswith(("array", "map", "struct"))]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(path)
    else:
        getattr(df.write.mode("overwrite"), kind)(path)
    return kind


def selection_csv(df: DataFrame, path: str) -> None:
    """A selection as one CSV file with a byte-order mark, in the order of the selection."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        df.orderBy("ordinal").drop("ordinal").toPandas().to_csv(f, index=False)
