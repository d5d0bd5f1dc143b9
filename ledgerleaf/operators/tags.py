"""Tags and descriptions: sets that compare without case and keep their spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A description shorter than this says nothing; one that starts generically says nothing below the second.
SHORT, SHORT_GENERIC = 25, 60
GENERIC = ("image ", "photo ", "video ", "vidéo ", "fichier ", "document ", "capture ", "screenshot ")


def contained(some: Column, all_: Column) -> Column:
    return F.size(F.array_except(some, all_)) == 0


def merged(existing: Column, added: Column) -> Column:
    """Existing tags, then the new ones that differ from all of them and from each other by more than case."""
    fold = lambda a: F.transform(a, F.lower)
    fresh = F.filter(added, lambda t, i: ~F.array_contains(fold(existing), F.lower(t)) & (F.array_position(fold(added), F.lower(t)) == i + 1))
    return F.concat(existing, fresh)


def coloured(tag: Column, colour: Column) -> Column:
    """A tag with its colour on a second line, where it has one."""
    return F.when(colour.isNull(), tag).otherwise(F.concat(tag, F.lit("\n"), colour.cast("string")))


def generic(desc: Column) -> Column:
    d = F.trim(F.coalesce(desc, F.lit("")))
    return (F.length(d) < SHORT) | (F.lower(d).rlike("^(" + "|".join(GENERIC) + ")") & (F.length(d) < SHORT_GENERIC))


def off_taxonomy(tags: Column, taxonomy: list[str]) -> Column:
    return F.array_except(tags, F.array(*(F.lit(t) for t in taxonomy)))
