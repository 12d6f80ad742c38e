"""One entry point over catalog, embeddings and properties. Sessions are immutable: every step returns a new one."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce as fold
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import image_properties as ip
from lumenframe.functions.vectors import l2_normalize
from lumenframe.operators import batch, cluster, contract, correlation, distance, explain, joins, predicates, reduce, stats
from lumenframe.runtime import materialize
from lumenframe.sources import discovery, images, store


class ImageFailures(RuntimeError):
    """Some images could not be processed; the others are stored."""

    def __init__(self, n: int, some: list[tuple[int, str]]):
        super().__init__(f"{n} images could not be processed, such as {some}")
        self.n, self.some = n, some


def reduce_or(tests: list) -> Any:
    return fold(lambda a, b: a | b, tests)


@dataclass(frozen=True)
class Session:
    """``catalog`` (image_index, image_path, metadata), ``embeddings`` (image_index, embedding), ``properties``
    (image_index, doubles); the last two may be missing."""

    catalog: DataFrame
    embeddings: DataFrame | None = None
    properties: DataFrame | None = None
    dim: int | None = None
    batch_stats: DataFrame | None = None
    log: tuple = field(default_factory=tuple)

    # --- building -----------------------------------------------------------------------------------------------------

    @staticmethod
    def find_files(spark: SparkSession, path: str, **options) -> Session:
        return Session(discovery.discover(spark, path, **options))._did("find_files", path=path)

    @staticmethod
    def from_table(table: DataFrame) -> Session:
        return Session(discovery.catalog_from_table(table))._did("from_table")

    @staticmethod
    def load(st: store.ResultStore) -> Session:
        got = {n: st.read(n) if st.has(n) else None for n in ("embeddings", "properties", "batch_stats")}
        s = Session(st.read("catalog"), **got)
        return s._with_dim()._did("load", path=st.path)

    def save(self, st: store.ResultStore) -> None:
        for name in ("catalog", "embeddings", "properties", "batch_stats"):
            t = getattr(self, name)
            if t is not None:
                st.write(name, t)

    def _did(self, step: str, **what: Any) -> Session:
        return replace(self, log=(*self.log, {"at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "step": step, **what}))

    def _with_dim(self) -> Session:
        if self.embeddings is None:
            return self
        r = self.embeddings.where(F.col("embedding").isNotNull()).select(F.size("embedding")).limit(1).collect()
        return replace(self, dim=r[0][0] if r else None)

    # --- computing ----------------------------------------------------------------------------------------------------

    def process_images(self, root: str | None, make_model, filters: dict | None = None, exclude: dict | None = None, st: store.ResultStore | None = None, force: bool = False, **options) -> Session:
        """Embeddings of images that have none yet; with ``force`` of all that pass the filters, in place of older ones.

        With a store the settings must be those of earlier runs, and what could be computed is committed; if images failed,
        ImageFailures is raised after that. Without one failed images leave the catalog, with a warning.
        """
        todo = predicates.file_table_filter(self.catalog, filters, exclude)
        done = self.embeddings if st is None or not st.has("embeddings") else st.read("embeddings")
        if done is not None and not force:
            todo = joins.not_done(todo, done, "image_index")
        settings = {k: options[k] for k in ("size", "channel_mode") if k in options}
        if st is not None:
            st.validate_params(settings)
        got = materialize(images.extract_embeddings(todo, make_model, root=root, **options), "embeddings")
        new, lost = got.where("error IS NULL").drop("error"), got.where("error IS NOT NULL")
        if done is None:
            both = new
        else:
            both = (done.join(new, "image_index", "left_anti") if force else done).unionByName(new)
        if st is not None:
            if done is None or not force:
                st.append("embeddings", new)
            else:
                st.write("embeddings", both)
            st.set_params({**st.params(), **settings})
            both = st.read("embeddings")
        s = replace(self, embeddings=both)._with_dim()._did("process_images", filters=filters, exclude=exclude, force=force)
        n = lost.count()
        if not n:
            return s
        some = [(r["image_index"], r["error"]) for r in lost.orderBy("image_index").limit(3).collect()]
        if st is not None:
            raise ImageFailures(n, some)
        warnings.warn(f"{n} images could not be read and leave the catalog, such as {some}", stacklevel=2)
        return replace(s, catalog=self.catalog.join(lost.select("image_index"), "image_index", "left_anti"))

    def append(self, cohort: DataFrame) -> Session:
        """The catalog with the images of another one whose paths it lacks."""
        return replace(self, catalog=joins.append_new(self.catalog, cohort)[0])._did("append")

    def compute_properties(self, root: str | None, preset: str = "standard", extra: list | None = None, channels: list[str] | None = None) -> Session:
        """Properties by preset and own functions; an image that cannot be read has nulls, with a warning."""
        mask = "mask_path" if "mask_path" in self.catalog.columns else None
        got = materialize(images.compute_properties(self.catalog, ip.preset(preset) + (extra or []), channels, root, mask), "properties")
        n = got.where("error IS NOT NULL").count()
        if n:
            warnings.warn(f"{n} images could not be measured", stacklevel=2)
        got = got.drop("error")
        both = got if self.properties is None else joins.merge_properties(self.properties, got)
        return replace(self, properties=both)._did("compute_properties", preset=preset)

    def reset_properties(self) -> Session:
        return replace(self, properties=None)._did("reset_properties")

    def reset(self) -> Session:
        """The catalog alone."""
        return Session(self.catalog)._did("reset")

    # --- features -----------------------------------------------------------------------------------------------------

    def property_names(self) -> list[str]:
        return contract.property_keys(self.properties) if self.properties is not None else []

    def features(self, source: str = "embeddings", props: list[str] | None = None, normalize: bool = True) -> tuple[DataFrame, int]:
        """(``(image_index, features)``, length). Properties are scaled over all images before any filter."""
        if source == "embeddings":
            if self.embeddings is None:
                raise ValueError("there are no embeddings")
            v = l2_normalize(F.col("embedding")) if normalize else F.transform("embedding", lambda x: x.cast("double"))
            return self.embeddings.where(F.col("embedding").isNotNull()).select("image_index", v.alias("features")), self.dim
        names = contract.match_names(props or self.property_names(), self.property_names())
        if source == "properties":
            p = stats.zscore_columns(self.properties, names) if normalize else self.properties.withColumns({n: predicates.finite_or_null(F.col(n)) for n in names})
            return p.na.drop(subset=names).select("image_index", F.array(*[F.col(n) for n in names]).alias("features")), len(names)
        if source == "combined":
            j = self.embeddings.join(self.properties.select("image_index", *names), "image_index")
            return stats.combined_features(j, "embedding", names), self.dim + len(names)
        raise ValueError(f"unknown source {source!r}")

    def _chosen(self, feats: DataFrame, filters: dict | None, exclude: dict | None) -> DataFrame:
        return feats.join(predicates.metadata_filter(self.catalog, filters, exclude).select("image_index"), "image_index", "left_semi") if filters or exclude else feats

    # --- questions ----------------------------------------------------------------------------------------------------

    def reference_distances(self, reference: dict, filters: dict | None = None, exclude: dict | None = None, source: str = "embeddings", mode: str = "centroid", distance_type: str = "euclidean", props: list[str] | None = None) -> DataFrame:
        f, dim = self.features(source, props)
        ref = predicates.metadata_filter(self.catalog, reference).select("image_index", F.lit(True).alias("_is_ref"))
        keep = predicates.metadata_filter(self.catalog, filters, exclude).select("image_index", F.lit(True).alias("_kept"))
        c = self.catalog.join(ref, "image_index", "left").join(keep, "image_index", "left")
        return distance.reference_distances(c, f, F.coalesce("_is_ref", F.lit(False)), dim, F.col("_kept"), mode, distance_type).drop("_is_ref", "_kept")

    def detect_outliers(self, method: str = "z-score", threshold: float = 3.0, group_by: str | None = None, source: str = "embeddings", filters: dict | None = None, exclude: dict | None = None) -> DataFrame:
        f, dim = self.features(source)
        f = self._chosen(f, filters, exclude)
        if group_by:
            f = f.join(self.catalog.select("image_index", group_by), "image_index")
        return distance.outliers(f, group_by, dim, method, threshold)

    def drop_outliers(self, found: DataFrame) -> Session:
        cut = lambda t: None if t is None else distance.drop_outliers(t, found)
        return replace(self, catalog=cut(self.catalog), embeddings=cut(self.embeddings), properties=cut(self.properties))._did("drop_outliers")

    def find_prototypes(self, group_by: str = "cluster", n: int = 5, metric: str = "euclidean", source: str = "embeddings") -> DataFrame:
        f, dim = self.features(source)
        return distance.prototypes(f.join(self.catalog.select("image_index", group_by), "image_index"), group_by, dim, n, metric)

    def compute_clustering(self, method: str = "kmeans", k: int = 5, source: str = "embeddings", filters: dict | None = None, exclude: dict | None = None, **options) -> Session:
        f, dim = self.features(source)
        c = cluster.compute_clustering(self.catalog, self._chosen(f, filters, exclude), dim, method, k, **options)
        return replace(self, catalog=c)._did("compute_clustering", method=method, k=k)

    def reduce(self, method: str = "pca", k: int = 2, source: str = "embeddings", sample: int | None = None, filters: dict | None = None, exclude: dict | None = None, **options) -> DataFrame:
        f, dim = self.features(source)
        y = reduce.reduce_dimensions(self._chosen(f, filters, exclude), "image_index", "features", dim, method, k, sample, **options)
        return y.join(self.catalog, "image_index")

    def property_stats_by_group(self, group_by: list[str] | None = None, props: list[str] | None = None) -> DataFrame:
        if group_by is None:
            group_by = contract.metadata_keys(self.catalog)[:2]
        return stats.property_stats_by_group(self.catalog.select("image_index", *group_by).join(self.properties, "image_index"), props or self.property_names(), group_by)

    def top_properties_different(self, group_by: str, reference: str, k: int = 5, metric: str = "cohens_d") -> DataFrame:
        return stats.top_properties_different(self.catalog.select("image_index", group_by).join(self.properties, "image_index"), group_by, reference, self.property_names(), k, metric)

    def group_enrichment(self, group_by: str = "cluster", props: list[str] | None = None) -> DataFrame:
        return stats.sorted_enrichment(self._enrichment(group_by, props))

    def _enrichment(self, group_by: str, props: list[str] | None = None) -> DataFrame:
        return stats.group_enrichment(self.catalog.select("image_index", group_by).join(self.properties, "image_index"), group_by, props or self.property_names())

    def embedding_property_correlations(self, props: list[str] | None = None, method: str = "pearson", normalize: bool = True) -> DataFrame:
        j = self.embeddings.join(self.properties, "image_index")
        return correlation.embedding_property_correlations(j, "embedding", props or self.property_names(), self.dim, method, normalize)

    def component_correlation(self, method: str = "pca", k: int = 2, props: list[str] | None = None, correlation_method: str = "pearson") -> DataFrame:
        f, dim = self.features()
        y = reduce.reduce_dimensions(f, "image_index", "features", dim, method, k)
        return correlation.component_correlation(y, [f"component_{i + 1}" for i in range(k)], self.properties, props or self.property_names(), method=correlation_method)

    def embedding_frame(self, method: str = "pca", k: int = 2, max_points: int = 1_000_000, **options) -> DataFrame:
        """Components beside the catalog, for a map: at most ``max_points`` images, chosen by hash."""
        y = self.reduce(method, k, **options)
        return y if y.count() <= max_points else reduce.hash_sample(y, "image_index", max_points)

    def interpret_axis(self, axis: int = 1, model: str = "lasso", method: str = "pca", props: list[str] | None = None) -> tuple[DataFrame, float | None]:
        """Properties that explain a component; properties with missing values are left out."""
        f, dim = self.features()
        y = reduce.reduce_dimensions(f, "image_index", "features", dim, method, max(2, axis))
        names = props or self.property_names()
        p = stats.nan_policy(self.properties.select("image_index", *names), names, "drop_columns")
        names = [n for n in names if n in p.columns]
        run = {"lasso": explain.lasso_axis, "forest": explain.forest_axis}[model]
        return run(y.join(p, "image_index"), names, f"component_{axis}")

    def correct_batches(self, batch_key: str, controls: dict | None = None, method: str = "sphering", source: str = "embeddings", props: list[str] | None = None, **options) -> tuple[Session, DataFrame]:
        """Corrected embeddings (or properties), and the statistics, which the session keeps; a second correction must be
        asked for with ``force=True``. A property that is not finite in some row is an error."""
        if any(x["step"] == "correct_batches" and x["source"] == source for x in self.log) and not options.pop("force", False):
            raise ValueError(f"the {source} are corrected already")
        options.pop("force", None)
        ctl = predicates.metadata_filter(self.catalog, controls).select("image_index", F.lit(True).alias("_ctl"))
        if source == "embeddings":
            rows, dim = self.embeddings.select("image_index", "embedding"), self.dim
        elif source == "properties":
            names = contract.match_names(props or self.property_names(), self.property_names())
            if self.properties.where(reduce_or([predicates.finite_or_null(F.col(n)).isNull() for n in names])).limit(1).count():
                raise ValueError("properties to correct must be finite in every row")
            rows, dim = self.properties.select("image_index", F.array(*[F.col(n).cast("double") for n in names]).alias("embedding")), len(names)
        else:
            raise ValueError(f"unknown source {source!r}")
        j = rows.join(self.catalog.select("image_index", batch_key), "image_index").join(ctl, "image_index", "left")
        out, st = batch.correct_batches(j, batch_key, "embedding", dim, F.coalesce("_ctl", F.lit(False)), method, **options)
        done = self._did("correct_batches", key=batch_key, method=method, source=source)
        if source == "embeddings":
            return replace(done, embeddings=out.select("image_index", F.col("corrected").alias("embedding")), batch_stats=st), st
        new = out.select("image_index", *[F.col("corrected")[i].alias(n) for i, n in enumerate(names)])
        return replace(done, properties=self.properties.drop(*names).join(new, "image_index", "left"), batch_stats=st), st

    def process_temporal(self, new: DataFrame) -> Session:
        """Session rows with embeddings; cleared by :meth:`clear_temporal`."""
        meta = [m for m in contract.metadata_keys(self.catalog) if m not in ("source", "id")]
        c = joins.append_temporal(self.catalog.join(self.embeddings, "image_index", "left"), new, meta)
        return replace(self, catalog=c.drop("embedding"), embeddings=c.where(F.col("embedding").isNotNull()).select("image_index", "embedding"))._did("process_temporal")

    def clear_temporal(self) -> Session:
        c = predicates.drop_temporal(self.catalog)
        return replace(self, catalog=c, embeddings=self.embeddings.join(c, "image_index", "left_semi"))._did("clear_temporal")

    def image_info(self, index: int) -> DataFrame:
        t = self.catalog if self.properties is None else contract.append_properties(self.catalog, self.properties)
        return contract.image_info(t, index)

    def table(self, distances: DataFrame | None = None, include_embeddings: bool = False) -> DataFrame:
        t = self.catalog if self.properties is None else contract.append_properties(self.catalog, self.properties)
        if include_embeddings:
            t = t.join(self.embeddings, "image_index", "left")
        return store.export_frame(contract.tier_a(t), distances, "embedding" if include_embeddings else None, self.dim)

    def export(self, path: str, distances: DataFrame | None = None, include_embeddings: bool | str = False, fmt: str | None = None) -> str:
        """With ``include_embeddings="separate"`` vectors go as .npy files into a folder beside the table."""
        if include_embeddings == "separate":
            store.export_embeddings(self.embeddings, f"{path.rsplit('.', 1)[0]}_embeddings")
            include_embeddings = False
        return store.export_table(self.table(distances, include_embeddings), path, fmt)
