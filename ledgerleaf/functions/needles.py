"""Many phrases looked for at once: one Aho-Corasick automaton over a text's normal form and one over that without spaces.

A phrase costs a native ``contains`` two passes over a text; an automaton passes over it twice for all of them. It is
built once on the driver, from the configuration alone, and sent to the workers, which give for each text the places of
the phrases that it has. Conditions then ask that list.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_python

#: Phrases from which an automaton is used; below, native passes are quicker.
MANY = 40
#: The column that holds the places of what a text says.
FOUND = "text_found"


class Needles:
    """Phrases in normal form, each at its place."""

    def __init__(self, phrases: Iterable):
        self.place = {n: k for k, n in enumerate(dict.fromkeys(norm_python(str(p)) for p in phrases))}

    def __len__(self) -> int:
        return len(self.place)

    def automata(self) -> tuple:
        """Over the normal form and over that without spaces; each end carries the places of the phrases it means."""
        import ahocorasick

        spaced, glued = ahocorasick.Automaton(), ahocorasick.Automaton()
        close: dict[str, list[int]] = {}
        for n, k in self.place.items():
            if n:
                spaced.add_word(n, k)
                close.setdefault(n.replace(" ", ""), []).append(k)
        for n, ks in close.items():
            glued.add_word(n, tuple(ks))
        for a in (spaced, glued):
            if len(a):
                a.make_automaton()
        return spaced, glued

    def found(self, normal: Column) -> Column:
        """Sorted places of the phrases in a normal form, as ``text.says`` finds them; null has none. Phrases that are
        empty in normal form, which every text has, are not listed."""
        spaced, glued = self.automata()

        @F.pandas_udf("array<int>")
        def run(texts: pd.Series) -> pd.Series:
            def places(t: str | None) -> list[int]:
                if not t or not len(spaced):
                    return []
                hits = {k for _, k in spaced.iter(t)}
                for _, ks in glued.iter(t.replace(" ", "")):
                    hits.update(ks)
                return sorted(hits)

            return texts.map(places)

        return run(normal)

    def says(self, phrase: str) -> Column | None:
        """Whether ``FOUND`` has a phrase; null if the phrase is not one of these."""
        n = norm_python(str(phrase))
        if not n:
            return F.lit(True)
        return F.array_contains(FOUND, self.place[n]) if n in self.place else None

    def says_any(self, phrases: list) -> Column | None:
        normal = [norm_python(str(p)) for p in phrases]
        if "" in normal:
            return F.lit(True)
        if any(n not in self.place for n in normal):
            return None
        return F.arrays_overlap(FOUND, F.array(*(F.lit(self.place[n]) for n in normal))) if normal else F.lit(False)


_USED: ContextVar[Needles | None] = ContextVar("needles", default=None)


def used() -> Needles | None:
    """The phrases that conditions look up in ``FOUND`` while they are compiled, if any."""
    return _USED.get()


def phrases_of(tree) -> Iterator[str]:
    """Every phrase that a configuration, or a part of one, asks texts for."""
    if isinstance(tree, dict):
        for key, value in tree.items():
            if key in ("text_contains_any", "text_contains_all"):
                yield from (str(v) for v in (value if isinstance(value, (list, tuple, set)) else [value]))
            else:
                yield from phrases_of(value)
    elif isinstance(tree, (list, tuple)):
        for part in tree:
            yield from phrases_of(part)


@contextmanager
def looked_up(tree, least: int = MANY) -> Iterator[Needles | None]:
    """Within it, conditions of ``tree`` are compiled to look-ups, if it has ``least`` phrases or more and the library
    of automata is installed."""
    made = Needles(phrases_of(tree))
    token = _USED.set(made if len(made) >= least and find_spec("ahocorasick") else None)
    try:
        yield used()
    finally:
        _USED.reset(token)
