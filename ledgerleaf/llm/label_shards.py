"""Shards by balanced label propagation (native DataFrame operations only).

Documents that share a value (a text, say) are linked. A shard number is a label that moves along links: in each round a
document looks at how many of its linked documents each shard holds, by one join with a histogram per group (so a group
never becomes pairs), and wishes to be where most of them are. Wishes are granted under quotas that keep every shard at
or below its share of all rows:

* what one shard gives another and gets back is an exchange, which no quota holds up;
* beyond that a shard takes as many as it has room for, of each other shard in proportion to what it wishes to send.

Within a quota documents go in the order of buckets of their groups, so a quota parts few groups. Quotas are a table of
pairs of shards, of a size that shards and buckets bound. Documents without links have no edge that could be cut: they
leave room to the linked ones, and fill every shard to its share at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .block_naming import numbered
from .common import removed, stored, table

SHARDS = 24
#: Rounds at most; propagation ends sooner when two rounds have moved less than this share of the linked documents.
ROUNDS, SETTLED = 24, 0.001
#: Buckets of groups, and of rows within them, in whose order wishes are granted.
GROUP_BUCKETS, ROW_BUCKETS = 64, 4
#: What one linked document weighs beside the order of shards that breaks ties.
UNIT = 1 << 16
#: Bytes of a document besides its text.
OVERHEAD = 8


def shares(n: int, shards: int) -> list[int]:
    """Rows of each shard: counts at most one apart."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def memberships(rows: DataFrame, links: Sequence[str]) -> DataFrame:
    """row, gid: the groups of two or more rows that share a value of one of the columns ``links``; nulls link nothing.

    ``gid`` is the group's least row times the number of links, plus the link's place among them.
    """
    made = None
    for k, link in enumerate(links):
        some = rows.select("row", F.col(link).alias("value")).where("value is not null")
        groups = some.groupBy("value").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        # Written, so that the join deals its rows itself and can split those of a value that very many have.
        groups = stored(groups.select("value", (F.col("least") * len(links) + k).alias("gid")), "shard-groups")
        found = some.join(groups, "value").select("row", "gid")
        made = found if made is None else made.unionByName(found)
    return stored(made, "shard-members")


def _held(labels: DataFrame, shards: int) -> list[int]:
    """Rows of each shard."""
    found = {r.shard: r.n for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
    return [found.get(s, 0) for s in range(shards)]


def _each(values: Sequence, kind: str = "long") -> Column:
    return F.array(*(F.lit(v).cast(kind) for v in values))


def wishes(placed: DataFrame, room: list[int], turn: int, single: bool) -> DataFrame:
    """row, gid, shard, to: where each linked document wishes to be, its own shard if it wishes to stay. ``placed``:
    row, gid, shard, a row for each group of a document (``single``: it has one); ``gid`` is then its least.

    In the order of how many of its linked documents they hold, itself among them, its own shard and those with room
    are taken until they hold all of them with what they have room for. Inside those it stays, into those it wishes to
    go, more into one that has more room. If the first is its own, it wishes an exchange with a shard that holds more
    of them, another one each turn. Which of equal shards comes first changes with the turn, and is the same for all
    members of a group.
    """
    shards = len(room)
    # What each shard holds of a group; the place of shards in the group's own order breaks ties.
    held = (F.sum((F.col("shard") == s).cast("long")) * UNIT + F.pmod(F.col("gid") + (s + turn), F.lit(shards)) for s in range(shards))
    groups = placed.groupBy("gid").agg(F.array(*held).alias("held"))
    near = placed.join(groups, "gid")
    if not single:
        sums = F.array(*(F.sum(F.col("held")[s]) for s in range(shards))).alias("held")
        near = near.groupBy("row", "shard").agg(F.min("gid").alias("gid"), sums)
    every, rooms = F.sequence(F.lit(0), F.lit(shards - 1)), _each(room)
    own, all_ = F.get("held", F.col("shard")), F.aggregate("held", F.lit(0).cast("long"), lambda n, h: n + F.floor(h / UNIT))
    more = F.filter(every, lambda s: F.get("held", s) > own)
    open_ = F.filter(every, lambda s: (F.get(rooms, s) > 0) | (s == F.col("shard")))
    ranked = F.array_sort(F.transform(open_, lambda s: F.struct((-F.get("held", s)).alias("less"), s.alias("s"), F.get(rooms, s).alias("room"))))
    near = near.select("row", "gid", "shard", all_.alias("all"), more.alias("more"), ranked.alias("ranked"))
    # What the shards before each in that order hold and could hold.
    holds = lambda x: F.floor(-x["less"] / UNIT) + x["room"]
    before = lambda i: F.aggregate(F.slice("ranked", F.lit(1), i), F.lit(0).cast("long"), lambda n, x: n + holds(x))
    near = near.withColumn("taken", F.filter("ranked", lambda x, i: before(i) < F.col("all")))
    total = F.aggregate("taken", F.lit(0).cast("long"), lambda n, x: n + x["room"])
    near = near.withColumn("at", F.pmod(F.col("row") + turn, F.greatest(total, F.lit(1))))
    upto = lambda i: F.aggregate(F.slice("taken", F.lit(1), i + 1), F.lit(0).cast("long"), lambda n, x: n + x["room"])
    into = F.get(F.filter("taken", lambda x, i: upto(i) > F.col("at")), F.lit(0))["s"]
    other = F.get("more", F.pmod(F.col("row") + turn, F.size("more")).cast("int"))
    inside = F.exists("taken", lambda x: x["s"] == F.col("shard"))
    first = F.get("taken", F.lit(0))["s"] == F.col("shard")
    to = F.when(first & (F.size("more") > 0), other).when(inside, F.col("shard")).otherwise(into)
    return stored(near.select("row", "gid", "shard", F.coalesce(to, F.col("shard")).cast("int").alias("to")), "shard-wishes")


def quotas(wished: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Of the wishes for each pair (shard, to), how many are granted: exchanges, and shares of the room of ``to``,
    rounded so that they add up to it."""
    swapped = {(a, b): min(n, wished.get((b, a), 0)) for (a, b), n in wished.items()}
    granted = dict(swapped)
    for b, left in enumerate(room):
        over = {a: wished[a, b] - swapped[a, b] for a in range(len(room)) if (a, b) in wished}
        asked, upto = sum(over.values()), 0
        for a, n in over.items():
            granted[a, b] += min(left, asked) * (upto + n) // max(asked, 1) - min(left, asked) * upto // max(asked, 1)
            upto += n
    return granted


def propagated(members: DataFrame, share: list[int], rounds: int = ROUNDS, single: bool = False) -> tuple[DataFrame, list[int]]:
    """(row, shard of every row of ``members``; rows of each shard, none above its ``share``). ``single``: a row has
    one group."""
    shards = len(share)
    dealt = numbered(members.select("row").distinct()).select("row", (F.col("name") % shards).cast("int").alias("shard"))
    placed = stored(members.join(dealt, "row"), "shard-placed")
    labels = placed.select("row", "shard").distinct() if not single else placed.select("row", "shard")
    held, idle = _held(labels, shards), 0
    bucket = (F.pmod("gid", F.lit(GROUP_BUCKETS)) * ROW_BUCKETS + F.pmod("row", F.lit(ROW_BUCKETS))).cast("int")
    for turn in range(rounds):
        room = [t - c for t, c in zip(share, held, strict=True)]
        wished = wishes(placed, room, turn, single).withColumn("bucket", bucket)
        # At most a row for each pair of shards and bucket.
        counts: dict[tuple[int, int], dict[int, int]] = {}
        for r in wished.where("to <> shard").groupBy("shard", "to", "bucket").agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault((r.shard, r.to), {})[r.bucket] = r.n
        granted = quotas({pair: sum(n.values()) for pair, n in counts.items()}, room)
        # Of each pair the bucket in which the quota ends, and how many of it are within.
        last, rest = [-1] * shards**2, [0] * shards**2
        for (a, b), n in counts.items():
            left, at = granted[a, b], -1
            for at in sorted(n):
                if left < n[at]:
                    break
                left -= n[at]
            else:
                at, left = GROUP_BUCKETS * ROW_BUCKETS, 0
            last[a * shards + b], rest[a * shards + b] = at, left
            held[a], held[b] = held[a] - granted[a, b], held[b] + granted[a, b]
        moved = sum(granted.values())
        idle = idle + 1 if moved <= SETTLED * sum(held) else 0
        if moved == 0 and (idle == 2 or not counts):
            break
        pair = F.col("shard") * shards + F.col("to")
        told = wished.select("*", F.get(_each(last, "int"), pair).alias("last"), F.get(_each(rest), pair).alias("rest"))
        ends = told.where("bucket = last and rest > 0 and to <> shard")
        ends = ends.withColumn("place", F.row_number().over(W.partitionBy("shard", "to").orderBy("gid", "row")))
        others = told.where("not (bucket = last and rest > 0 and to <> shard)").withColumn("place", F.lit(None).cast("int"))
        goes = F.when(F.col("place").isNotNull(), F.col("place") <= F.col("rest")).otherwise(F.col("bucket") < F.col("last"))
        now = ends.unionByName(others).select("row", "gid", F.when((F.col("to") != F.col("shard")) & goes, F.col("to")).otherwise(F.col("shard")).alias("shard"))
        old, placed = placed, stored(now if single else members.join(now.drop("gid"), "row"), "shard-placed")
        removed(old, wished)
        if idle == 2:
            break
    return (placed.select("row", "shard") if single else placed.select("row", "shard").distinct()), held


def sharded(docs: DataFrame, shards: int = SHARDS, links: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``docs``.

    Law ``rows``: counts of shards are at most one apart, whatever the sizes of texts and groups; a group larger than
    a shard fills several. ``links`` are columns whose equal values link documents; by default the text (null and
    empty texts are equal). Rows that repeat, and null ids, are documents of their own. ``slot`` counts from 0 within
    a shard, linked documents first. Reruns agree for the same files. Empty table: no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    links = links or {"text": F.sha2(text, 256)}
    values = [v.alias(f"link_{k}") for k, v in enumerate(links.values())]
    size = (F.octet_length(text) + OVERHEAD).cast("long").alias("size")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), size, F.crc32(text).alias("text_crc32"), *values), "shard-rows")
    share = shares(rows.count(), shards)
    members = memberships(rows, [f"link_{k}" for k in range(len(values))])
    labels, held = propagated(members, share, rounds, single=len(values) == 1)
    labels = stored(labels, "shard-labels")

    # Linked documents take the first slots of a shard, the others fill it up; both are numbered without gaps.
    starts = [sum(held[:s]) for s in range(shards)]
    linked = numbered(labels.select("shard", "row"))
    linked = linked.select("row", "shard", (F.col("name") - F.get(_each(starts), F.col("shard"))).alias("slot"))
    free = numbered(rows.select("row").join(labels.select("row"), "row", "left_anti"))
    ends = [sum(share[: s + 1]) - sum(held[: s + 1]) for s in range(shards)]
    shard = sum(((F.col("name") >= e).cast("int") for e in ends), F.lit(0))
    offset = _each([h - sum(share[:s]) + sum(held[:s]) for s, h in enumerate(held)])
    free = free.withColumn("shard", shard).select("row", "shard", (F.col("name") + F.get(offset, F.col("shard"))).alias("slot"))
    return rows.join(linked.unionByName(free), "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_label_shards(spark, sf_dir):
    return sharded(table(spark, sf_dir, "documents"))
