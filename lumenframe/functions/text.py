"""Path, identifier and metadata-text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: image and table extensions that are stripped from names
EXTENSIONS = ("nii.gz", "tif", "tiff", "png", "jpg", "jpeg", "bmp", "npy", "npz", "nii", "gif", "webp", "csv")
_EXT = r"(?i)\.(nii\.gz|" + "|".join(e for e in EXTENSIONS if e != "nii.gz") + ")$"


def posix(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def basename(c: Column) -> Column:
    return F.substring_index(posix(c), "/", -1)


def strip_known_extension(c: Column) -> Column:
    """Only a known extension goes, so ``a.ome.tif`` gives ``a.ome`` and ``my.image`` stays; of ``x.nii.gz`` one part goes."""
    return F.regexp_replace(c, r"(?i)\.(" + "|".join(sorted({*EXTENSIONS, "gz"} - {"nii.gz"})) + ")$", "")


def strip_full_extension(c: Column) -> Column:
    """Like :func:`strip_known_extension`, but ``.nii.gz`` is one extension."""
    return F.regexp_replace(c, _EXT, "")


def path_to_id(c: Column, root: str | None = None) -> Column:
    """Relative path without extension; separators, colons and blanks become one underscore; null if nothing is left."""
    p = posix(c)
    if root:
        p = F.regexp_replace(p, "^" + re.escape(root.rstrip("/")) + "/", "")
    p = F.regexp_replace(strip_full_extension(p), r"[/:\s]+", "_")
    return F.nullif(F.regexp_replace(F.regexp_replace(p, "_+", "_"), "^_+|_+$", ""), F.lit(""))


def paths_to_id(paths: Column) -> Column:
    """Id of a record with several files: the sorted ids of the files, joined by a bar."""
    return F.array_join(F.array_sort(F.transform(paths, lambda p: path_to_id(p))), "|")


def identifier_keys(c: Column) -> Column:
    """Ways to name a file: path, basename, each with and without extension, lower-cased; most specific first."""
    p = F.lower(posix(c))
    return F.array_distinct(F.array(p, strip_full_extension(p), basename(p), strip_full_extension(basename(p))))


def missing_to_null(c: Column) -> Column:
    """None, blank text and NaN are one thing: null."""
    return F.nullif(F.trim(c), F.lit(""))


def stable_batch_id(c: Column, kind: str) -> Column:
    """Batch key as text: missing ``__missing__``, booleans ``True``/``False``, whole floats without the point."""
    if kind == "boolean":
        t = F.when(c, "True").otherwise("False")
        return F.when(c.isNull(), "__missing__").otherwise(t)
    if kind in ("double", "float"):
        t = F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))
        return F.when(c.isNull() | F.isnan(c), "__missing__").otherwise(t)
    return F.coalesce(missing_to_null(c.cast("string")), F.lit("__missing__"))


def restore_meta_type(c: Column) -> Column:
    """Imported text as ``struct(as_int, as_double, as_text)``: a whole number only if it is written canonically, else a
    double if it parses, else text. So ``01`` is 1.0 and ``1e5`` is 100000.0."""
    i = c.try_cast("bigint")
    whole = F.when(i.cast("string") == c, i)
    d = F.when(whole.isNull(), c.try_cast("double"))
    return F.struct(whole.alias("as_int"), d.alias("as_double"), F.when(whole.isNull() & d.isNull(), c).alias("as_text"))


def compile_template(template: str) -> tuple[str, list[str]]:
    """Regular expression and group names of a path template such as ``.../(drug)/(time)/(name).*``.

    ``(g)`` captures one path part, ``*`` is any text within one, a trailing ``.*`` any extension; a leading ``.../`` or
    ``./`` allows any prefix. The end is anchored.
    """
    t = template.replace("\\", "/")
    lead = re.match(r"^\.{1,3}/", t)
    t = t[lead.end() :] if lead else t
    tail = t.endswith(".*")
    t = t[:-2] if tail else t
    names, out = [], []
    for part in re.split(r"(\([A-Za-z_]\w*\)|\*)", t):
        if part == "*":
            out.append("[^/]*")
        elif part.startswith("(") and part.endswith(")") and part[1:-1].isidentifier():
            if part[1:-1] in names:
                raise ValueError(f"group {part[1:-1]!r} twice in {template!r}")
            names.append(part[1:-1])
            out.append("([^/]+?)" if tail else "([^/]+)")
        else:
            out.append(re.escape(part))
    if not names:
        raise ValueError(f"no (group) in {template!r}")
    return ("(?:^|/)" if lead else "^") + "".join(out) + (r"\.[^/.]+(?:\.gz)?$" if tail else "$"), names


def template_columns(path: Column, template: str) -> dict[str, Column]:
    """One column per group; null where the path does not match."""
    pattern, names = compile_template(template)
    p = posix(path)
    return {n.lower(): F.when(p.rlike(pattern), F.regexp_extract(p, pattern, i + 1)) for i, n in enumerate(names)}


def group_key(names: list[str]) -> str:
    """The last captured name that is not the channel index."""
    return [n for n in names if n.lower() != "channel_index"][-1]


def stable_key(id_col: Column | None, metadata: dict[str, Column], path_like: Column | None = None) -> Column:
    """The id if it isn't path-like, else sorted-key JSON of the metadata; null when both are empty."""
    body = F.to_json(F.struct(*[metadata[k].alias(k.lower()) for k in sorted(metadata, key=str.lower)]))
    body = F.when(F.coalesce(*[c.cast("string") for c in metadata.values()]).isNotNull(), body)
    if id_col is None:
        return body
    t = missing_to_null(id_col)
    like = t.rlike(r"[/\\]") if path_like is None else path_like
    return F.coalesce(F.when(~like, t), body)


def capitalize_preserve(name: str) -> str:
    return name[:1].upper() + name[1:]
