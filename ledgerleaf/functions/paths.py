"""Paths, globs and destinations as Column expressions."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), r"(?<=[^/])/+$", "")


def stem(path: Column) -> Column:
    """The name without its extension; leading dots are part of the name."""
    name = basename(path)
    ext = F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)
    return F.substr(name, F.lit(1), F.length(name) - F.length(ext))


def ext_of(path: Column) -> Column:
    """Lower-case extension with its dot, ``?`` without one; leading dots start no extension."""
    ext = F.lower(F.regexp_extract(basename(path), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))
    return F.when(ext == "", F.lit("?")).otherwise(ext)


def inside(path: Column, folder: Column) -> Column:
    """Whether a path is a folder or lies in it, by whole segments, whatever the case."""
    p, f = (F.transform(segments(c), F.lower) for c in (path, folder))
    return (F.size(f) == 0) | (F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(f), F.lit(1))), "/") == F.array_join(f, "/"))


def rel_key(path: Column, root: str, home: str) -> Column:
    """Root-relative, else home-relative with ~/, else absolute."""
    root, home = root.rstrip("/"), home.rstrip("/")
    under = lambda top: path.startswith(top + "/")
    return F.when(under(root), F.substr(path, F.lit(len(root) + 2))).when(under(home), F.concat(F.lit("~/"), F.substr(path, F.lit(len(home) + 2)))).otherwise(path)


def ancestors(path: Column) -> Column:
    """Every folder above a path, nearest last."""
    parts = segments(path)
    depth = F.size(parts) - 1
    return F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def walk_key(path: Column) -> Column:
    """Sorts as a walk visits: a folder's files by name, then its folders by name."""
    parts = segments(path)
    n = F.size(parts)
    return F.transform(parts, lambda s, i: F.when(i == n - 1, F.concat(F.lit("0"), s)).otherwise(F.concat(F.lit("1"), s)))


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression of the whole string; ``*`` crosses slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 + glob.startswith("!", i + 1)) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close]
            body = ("^" + body[1:] if body.startswith("!") else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{body}]")
            i = close
        else:
            out.append(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def excluded(rel: Column, globs: list[str]) -> Column:
    """Whether /rel matches any pattern; one without a leading slash or star matches at any depth. Case counts."""
    path = F.concat(F.lit("/"), rel)
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g if g.startswith(("/", "*")) else "*/" + g))
    return out


FIELDS = ("doc_year", "ext", "name", "stem", "entity")


def render_destination(template: str, values: dict[str, Column]) -> tuple[Column, Column]:
    """(folder ending in a slash or null, name of the first variable without a value or null)."""
    parts: list[Column] = []
    missing: list[Column] = []
    for text, var, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if var is None:
            continue
        value = values[var].cast("string") if var in values else F.lit(None).cast("string")
        missing.append(F.when(F.coalesce(value, F.lit("")) == "", F.lit(var or "positional")))
        parts.append(value)
    stopped = F.coalesce(*missing) if missing else F.lit(None).cast("string")
    folder = F.concat(F.regexp_replace(F.concat(*parts, F.lit("")), "/+$", ""), F.lit("/"))
    return F.when(stopped.isNull(), folder), stopped


def destination_values(path: Column, ext: Column, doc_year: Column, entity: Column) -> dict[str, Column]:
    return {"doc_year": doc_year, "ext": F.regexp_replace(ext, r"^\.+", ""), "name": basename(path), "stem": stem(path), "entity": entity}
