"""The condition language, compiled to Columns.

A condition is a dict whose keys must all hold; ``all``, ``any`` and ``not`` nest. An empty condition, one that is not
a dict, and one with an unknown key are false. Every leaf is false where its column is null, so three-valued logic
never reaches a ``not``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import identifiers, needles, paths, text

# What a path alone shows, and what a validated identifier shows. All else grades as words.
WEAK = ("name_matches", "path_under", "ext", "ext_in", "size_gt", "size_lt")
IDENTIFIERS = ("ids_any", "id_kind_present")
PATH, WORDS, IDENTIFIER = 1, 2, 3


@dataclass(frozen=True)
class Match:
    """match: whether the condition holds. strength: 0 where not, else 1 to 3. cheap: what path and size alone allow."""

    match: Column
    strength: Column
    cheap: Column


def _list(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _under(value) -> Column:
    globs = [text.norm_python((p if p.startswith(("/", "*")) else "*/" + p).rstrip("/") + "*") for p in _list(value)]
    return _any([F.col("rel_norm").rlike(paths.glob_regex(g)) for g in globs])


def _extension(value) -> Column:
    return F.col("ext").isin([str(x).lower() for x in _list(value)])


def _pattern(regex: str) -> str:
    """A pattern as the texts' language reads it: Unicode classes, case ignored."""
    return "(?iU)" + regex.replace("(?P<", "(?<")


def _said(phrase) -> Column:
    known = needles.used()
    found = known.says(phrase) if known else None
    return text.says(F.col("text_norm"), F.col("text_glued"), phrase) if found is None else found


def _said_any(value) -> Column:
    known = needles.used()
    found = known.says_any(_list(value)) if known else None
    return _any([_said(x) for x in _list(value)]) if found is None else found


#: Leaf name -> Column over the columns that ``prepared`` gives. More may be added.
LEAVES: dict[str, Callable] = {
    "text_contains_any": _said_any,
    "text_contains_all": lambda v: _all([_said(x) for x in _list(v)]),
    "text_matches": lambda v: F.col("text_norm").rlike(_pattern(v)),
    "ids_any": lambda v: F.arrays_overlap(identifiers.id_values(F.col("ids")), F.array(*(F.lit(str(x).replace(" ", "").replace(".", "")) for x in _list(v)))),
    "id_kind_present": lambda v: _any([F.map_contains_key("ids", F.lit(k)) for k in _list(v)]),
    "has_text": lambda v: (F.length(F.coalesce("text", F.lit(""))) > 0) == F.lit(bool(v)),
    "doc_year_in": lambda v: F.col("doc_year").isin([int(x) for x in _list(v)]),
    "ext": _extension,
    "ext_in": _extension,
    "name_matches": lambda v: F.col("name_norm").rlike(_pattern(v)),
    "path_under": _under,
    "size_gt": lambda v: F.coalesce("size", F.lit(0)) > int(v),
    "size_lt": lambda v: F.coalesce("size", F.lit(0)) < int(v),
}


def prepared(entries: DataFrame) -> DataFrame:
    """``entries`` with the normal forms that leaves read, each computed once; within ``needles.looked_up`` also with
    what the texts say of its phrases. Absent columns count as null."""
    have = entries.columns
    kinds = {"text": "string", "ids": "map<string,array<string>>", "doc_year": "int", "ext": "string", "size": "bigint"}
    for name, kind in kinds.items():
        if name not in have:
            value = paths.ext_of(F.col("rel")) if name == "ext" else F.lit(None).cast(kind)
            entries = entries.withColumn(name, value)
    entries = entries.withColumn("text_norm", text.norm(F.coalesce("text", F.lit(""))))
    if needles.used():
        entries = entries.withColumn(needles.FOUND, needles.used().found(F.col("text_norm")))
    return entries.withColumns({"text_glued": text.glued(F.col("text_norm")), "name_norm": text.norm(paths.basename(F.col("rel"))), "rel_norm": text.norm(F.concat(F.lit("/"), F.col("rel")))})


UNPREPARED = ("text_norm", "text_glued", "name_norm", "rel_norm", needles.FOUND)


def leaf(name: str, value) -> Column:
    return F.coalesce(LEAVES[name](value), F.lit(False))


def grade(name: str) -> int:
    return PATH if name in WEAK else IDENTIFIER if name in IDENTIFIERS else WORDS


def compiled(condition) -> Match:
    """Columns over a ``prepared`` frame."""
    no = Match(F.lit(False), F.lit(0), F.lit(False))
    if not isinstance(condition, dict) or not condition:
        return no
    match, cheap, grades = [], [], [F.lit(PATH)]  # an unknown key is false, but the path alone cannot show it
    for key, value in condition.items():
        if key in ("all", "any"):
            parts = [compiled(c) for c in value]
            join = _all if key == "all" else _any
            match.append(join([p.match for p in parts]))
            cheap.append(join([p.cheap for p in parts]))
            grades += [p.strength for p in parts]
        elif key == "not":
            match.append(~compiled(value).match)  # says nothing about the path alone and proves nothing
        elif key in LEAVES:
            match.append(leaf(key, value))
            grades.append(F.lit(grade(key)))
            if key in WEAK:
                cheap.append(leaf(key, value))
        else:
            match.append(F.lit(False))
    holds = _all(match)
    strongest = reduce(lambda a, b: F.greatest(a, b), grades)
    return Match(holds, F.when(holds, strongest).otherwise(0), _all(cheap))


# The order in which a guard's keys are tried.
GUARD_KEYS = ("text_contains_any", "name_matches", "path_under", "ext", "ext_in", "id_kind_present")


def sensitive_hit(guard: dict | None) -> Column:
    """The first key that holds, with the first of its items that does; then the first rule's id; else null."""
    guard = guard or {}
    tries: list[Column] = []
    for key in GUARD_KEYS:
        value = guard.get(key)
        if value is None:
            continue
        if isinstance(value, (list, tuple)):
            tries += [F.when(leaf(key, [x]), F.lit(f"{key}: {x}")) for x in value]
        else:
            tries.append(F.when(leaf(key, value), F.lit(f"{key}: {value}")))
    for rule in guard.get("rules") or []:
        tree = {k: v for k, v in rule.items() if k != "id"}
        tries.append(F.when(compiled(tree).match, F.lit(rule.get("id", "sensitive-rule"))))
    return F.coalesce(*tries) if tries else F.lit(None).cast("string")


def interpreted(condition, facts: dict[str, Callable]) -> bool:
    """The grammar over one row, for tests: ``facts`` maps a leaf name to a function of its value."""
    if not isinstance(condition, dict) or not condition:
        return False
    for key, value in condition.items():
        if key == "all":
            ok = all(interpreted(c, facts) for c in value)
        elif key == "any":
            ok = any(interpreted(c, facts) for c in value)
        elif key == "not":
            ok = not interpreted(value, facts)
        else:
            ok = key in facts and facts[key](value)
        if not ok:
            return False
    return True
