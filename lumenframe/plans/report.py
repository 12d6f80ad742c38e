"""An HTML report from aggregated tables; only small results reach the driver."""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from lumenframe.operators import contract, stats
from lumenframe.plans.session import Session

MAX_ROWS = 200  # most rows of a table shown in the report; longer ones say so
MAX_POINTS = 2_000  # most images on the map, chosen by hash


@dataclass
class ReportConfig:
    title: str = "Image analysis report"
    group_by: list[str] = field(default_factory=list)
    reference: dict | None = None
    preview_rows: int = 10
    sections: list[str] = field(default_factory=lambda: ["overview", "property_stats", "clustering", "distance", "outliers", "correlation", "interpretability", "visualization", "gallery", "settings", "preview"])


_SECTIONS: dict[str, Callable[[Session, ReportConfig], list[tuple[str, DataFrame | str]]]] = {}


def section(name: str):
    """Register a section: a function of (session, config) that returns titled tables or pieces of HTML."""

    def add(f):
        _SECTIONS[name] = f
        return f

    return add


@section("overview")
def _overview(s: Session, c: ReportConfig) -> list[tuple[str, DataFrame]]:
    return [(f"Values of {k}", stats.value_distribution(s.catalog, k)) for k in contract.metadata_keys(s.catalog)]


@section("property_stats")
def _stats(s: Session, c: ReportConfig) -> list[tuple[str, DataFrame]]:
    if s.properties is None:
        return []
    names = s.property_names()
    return [("Properties", stats.property_stats_by_group(s.properties, names)), ("Missing values", stats.nan_profile(s.properties, names))]


@section("clustering")
def _clusters(s: Session, c: ReportConfig) -> list[tuple[str, DataFrame]]:
    if "cluster" not in s.catalog.columns:
        return []
    out = [("Cluster sizes", stats.counts_with_share(s.catalog, ["cluster"]))]
    if s.embeddings is not None:
        out.append(("Typical images", s.find_prototypes()))
    if s.properties is not None:
        out.append(("Enriched properties", stats.top_enriched(s.group_enrichment()).orderBy("group", "rank")))
    return out


@section("distance")
def _distance(s: Session, c: ReportConfig) -> list[tuple[str, DataFrame]]:
    if not c.reference or s.embeddings is None:
        return []
    from lumenframe.operators import distance

    d = s.reference_distances(c.reference)
    return ([("Distances by group", distance.distance_summary(d, c.group_by))] if c.group_by else []) + [("Closest and farthest", distance.extremes(d, 5))]


@section("outliers")
def _outliers(s: Session, c: ReportConfig) -> list[tuple[str, DataFrame]]:
    if s.embeddings is None:
        return []
    from pyspark.sql import functions as F

    return [("Outliers", s.detect_outliers().orderBy(F.desc("distance_to_centroid")).limit(10))]


@section("correlation")
def _correlation(s: Session, c: ReportConfig) -> list[tuple[str, DataFrame]]:
    if s.embeddings is None or s.properties is None:
        return []
    from lumenframe.operators import correlation

    return [("Properties that follow a component", correlation.top_correlations(s.component_correlation(), ["component_1", "component_2"]).orderBy("component", "rank"))]


@section("interpretability")
def _interpretability(s: Session, c: ReportConfig) -> list[tuple[str, DataFrame]]:
    if s.embeddings is None or s.properties is None:
        return []
    weights, r2 = s.interpret_axis()
    return [("Properties that explain component 1" + ("" if r2 is None else f" (R2 {r2:.3f} out of fold)"), weights)]


@section("visualization")
def _map(s: Session, c: ReportConfig) -> list[tuple[str, DataFrame | str]]:
    """A map by the first two components, coloured by the first grouping column."""
    if s.embeddings is None:
        return []
    y = s.embedding_frame(max_points=MAX_POINTS)
    by = next((g for g in [*c.group_by, "cluster"] if g in y.columns), None)
    p = y.select("component_1", "component_2", *([by] if by else [])).toPandas()
    return [(f"Map of {len(p)} images" + (f" by {by}" if by else ""), _scatter(p, by))]


def _scatter(p: pd.DataFrame, by: str | None, width: int = 640, height: int = 420) -> str:
    if not len(p):
        return "<p>no images</p>"
    lo, hi = p[["component_1", "component_2"]].min(), p[["component_1", "component_2"]].max()
    at = (p[["component_1", "component_2"]] - lo) / (hi - lo).replace(0, 1)
    keys = p[by].astype(str) if by else pd.Series(["all"] * len(p), index=p.index)
    hue = {k: int(360 * i / max(1, keys.nunique())) for i, k in enumerate(sorted(keys.unique()))}
    dots = "".join(f'<circle cx="{8 + x * (width - 16):.1f}" cy="{height - 8 - y * (height - 16):.1f}" r="3" fill="hsl({hue[k]} 70% 45%)" fill-opacity=".6"><title>{html.escape(k)}</title></circle>' for x, y, k in zip(at["component_1"], at["component_2"], keys))
    return f'<svg width="{width}" height="{height}" role="img">{dots}</svg>'


@section("gallery")
def _gallery(s: Session, c: ReportConfig) -> list[tuple[str, DataFrame | str]]:
    """The images most typical of each group, by their paths."""
    by = next((g for g in ["cluster", *c.group_by] if g in s.catalog.columns), None)
    if s.embeddings is None or by is None:
        return []
    p = s.find_prototypes(by, 3).join(s.catalog.select("image_index", "image_path"), "image_index").orderBy(by, "rank_in_group").limit(MAX_ROWS).toPandas()
    cell = lambda r: f'<figure style="display:inline-block;margin:4px"><img src="{html.escape(str(r.image_path), True)}" width="96" alt=""><figcaption>{html.escape(str(getattr(r, by)))}</figcaption></figure>'
    return [(f"Typical images by {by}", "".join(cell(r) for r in p.itertuples(index=False)))]


@section("settings")
def _settings(s: Session, c: ReportConfig) -> list[tuple[str, DataFrame]]:
    rows = [(x["at"], x["step"], json.dumps({k: v for k, v in x.items() if k not in ("at", "step")}, default=str)) for x in s.log]
    return [("Steps", s.catalog.sparkSession.createDataFrame(rows, "at string, step string, settings string"))]


@section("preview")
def _preview(s: Session, c: ReportConfig) -> list[tuple[str, DataFrame]]:
    return [("Export preview", s.table().limit(c.preview_rows))]


def _table(p: pd.DataFrame) -> str:
    head = "".join(f"<th>{html.escape(str(c))}</th>" for c in p.columns)
    cell = lambda v: "" if v is None or v is pd.NA or isinstance(v, float) and v != v else f"{v:.6g}" if isinstance(v, float) else html.escape(str(v))
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in p.itertuples(index=False)) + "</table>"


def generate_report(s: Session, path: str, config: ReportConfig | None = None) -> str:
    """Write the report and return its path. Unknown section names are an error."""
    c = config or ReportConfig()
    wrong = [n for n in c.sections if n not in _SECTIONS]
    if wrong:
        raise ValueError(f"unknown sections {wrong}")
    body = []
    for name in c.sections:
        for title, df in _SECTIONS[name](s, c):
            if isinstance(df, str):
                body.append(f"<h2>{html.escape(title)}</h2>{df}")
                continue
            p = df.limit(MAX_ROWS + 1).toPandas()
            more = f"<p>The first {MAX_ROWS} rows.</p>" if len(p) > MAX_ROWS else ""
            body.append(f"<h2>{html.escape(title)}</h2>{_table(p.head(MAX_ROWS))}{more}")
    page = f"<!doctype html><meta charset=utf-8><title>{html.escape(c.title)}</title><style>body{{font:14px sans-serif;margin:2em}}td,th{{padding:2px 8px;border-bottom:1px solid #ccc;text-align:left}}</style><h1>{html.escape(c.title)}</h1>{''.join(body)}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
    return path
