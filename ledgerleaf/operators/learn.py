"""What a pass teaches: scores of shadow rules, new rules from moves, audits of a rule."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerleaf.functions import identifiers, maps, paths, runs, text
from ledgerleaf.plans.conditions import compiled, prepared
from ledgerleaf.plans.config import LEARNING
from ledgerleaf.sources.scratch import kept, scratch

from . import ledger as log
from . import tags as tag

# Moves that make a pattern, letters of a common name, candidates a full audit reads, examples shown.
LEAST_MOVES, LEAST_PREFIX, AUDITED, EXAMPLES = 3, 6, 500, 3
#: Bits of a map of hashes.
MAP_BITS = maps.BITS


def judged_shadows(entries: DataFrame) -> DataFrame:
    """rule, final, wanted, agrees (null: not settled, or nothing to check): a row per prediction.

    Judged on where the file ended, not on whether it moved.
    """
    # Not explode, for which the optimizer asks beforehand whether there are any, and so reads the texts twice.
    each = entries.select("rel", "result", "final", "tags", F.explode_outer("shadow").alias("s")).where("s is not null")
    p = each.withColumn("at", F.coalesce("final", "rel"))
    open_ = ~(F.coalesce("result", F.lit("")) != "") | (F.col("result") == "failed")
    there = text.norm(F.col("at")).startswith(text.norm(F.col("s.destination")))
    agrees = F.when(open_, None).when(F.coalesce("s.destination", F.lit("")) != "", there).when(F.coalesce(F.size("s.tags"), F.lit(0)) > 0, tag.contained(F.col("s.tags"), F.coalesce("tags", F.array().cast("array<string>"))))
    return p.select(F.col("s.rule").alias("rule"), F.col("at").alias("final"), F.coalesce("s.destination", F.array_join("s.tags", ",")).alias("wanted"), agrees.alias("agrees"))


def scores(entries: DataFrame) -> DataFrame:
    """rule, hits, agreed, disagreed: hits count also where nothing is settled."""
    j = judged_shadows(entries)
    return j.groupBy("rule").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("agrees")).alias("agreed"), F.count_if(~F.col("agrees")).alias("disagreed"))


def diverging(entries: DataFrame) -> DataFrame:
    """rule, n, examples: the first three, by path; most divergent first. Rules are tried once; what diverged is written
    down and read for both."""
    path = scratch(entries.sparkSession, "diverging")
    judged_shadows(entries).where(~F.col("agrees")).select("rule", "final", "wanted").write.parquet(path)
    j = entries.sparkSession.read.parquet(path)
    place = F.row_number().over(W.partitionBy("rule").orderBy("final", "wanted"))
    said = F.concat(F.col("final"), F.lit(" (rule wanted "), F.col("wanted"), F.lit(")"))
    few = j.withColumn("place", place).where(F.col("place") <= EXAMPLES)
    shown = few.groupBy("rule").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", said.alias("said")))), lambda x: x["said"]).alias("examples"))
    return j.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).join(shown, "rule").orderBy(F.desc("n"), "rule")


def report(rules: DataFrame, deltas: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """id, passes, hits, agreed, disagreed, ripe, retire of every shadow rule, this pass included.

    ``rules``: id, status, cycle, passes, hits, agreed, disagreed. A rule counts a pass only when it had hits. Ripe
    asks for passes, hits and no divergence; what agreed does not count. Retire: beyond the last cycle, or long
    without a hit.
    """
    t = {**LEARNING, **(thresholds or {})}
    d = deltas.select(F.col("rule").alias("id"), F.col("hits").alias("h"), F.col("agreed").alias("a"), F.col("disagreed").alias("b"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    r = rules.where(F.coalesce("status", F.lit("shadow")) == "shadow").join(d, "id", "left")
    r = r.select("id", F.coalesce("cycle", F.lit(1)).alias("cycle"), (n("passes") + F.col("h").isNotNull().cast("long")).alias("passes"), (n("hits") + n("h")).alias("hits"), (n("agreed") + n("a")).alias("agreed"), (n("disagreed") + n("b")).alias("disagreed"))
    ripe = (F.col("passes") >= t["min_passes"]) & (F.col("hits") >= t["min_hits"]) & (F.col("disagreed") == 0)
    retire = (F.col("cycle") > t["max_cycles"]) | ((F.col("passes") >= t["dead_after_passes"]) & (F.col("hits") == 0))
    return r.withColumns({"ripe": ripe, "retire": retire})


def _moved(entries: DataFrame) -> DataFrame:
    """Entries that moved into a folder, with dest."""
    return entries.where("result = 'moved' and coalesce(final, '') <> ''").withColumn("dest", paths.dirname(F.col("final"))).where("dest <> ''")


def moves(entries: DataFrame) -> DataFrame:
    """Entries that moved, with dest and n; only folders that took at least three."""
    m = _moved(entries)
    big = m.groupBy("dest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_MOVES)
    return m.join(big, "dest")


def _members(m: DataFrame) -> DataFrame:
    return m.select("dest", "rel")


def by_folder_and_kind(entries: DataFrame, m: DataFrame) -> DataFrame:
    """dest, ext, src: all of one kind out of one folder, and nothing else of that kind in it."""
    one = m.groupBy("dest").agg(F.min("ext").alias("ext"), F.max("ext").alias("x"), F.min(paths.dirname(F.col("rel"))).alias("src"), F.max(paths.dirname(F.col("rel"))).alias("y"), F.max("n").alias("n"))
    one = one.where("ext = x and src = y and src <> ''").select("dest", "ext", "src", "n")
    all_ = entries.groupBy("ext", paths.dirname(F.col("rel")).alias("src")).agg(F.count(F.lit(1)).alias("total"))
    return one.join(all_, ["ext", "src"]).where("total = n").select("dest", "ext", "src")


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common beginning of two strings."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(n == 0, "").otherwise(F.substr(a, F.lit(1), F.coalesce(F.array_min(differ) - 1, n)))


def by_prefix(entries: DataFrame, m: DataFrame) -> DataFrame:
    """dest, prefix: a beginning of six letters or more that all names share and no other file's has."""
    name = text.norm(paths.basename(F.col("rel")))
    ends = m.groupBy("dest").agg(F.min(name).alias("lo"), F.max(name).alias("hi"), F.max("n").alias("n"))
    p = ends.select("dest", "n", common_prefix(F.col("lo"), F.col("hi")).alias("prefix")).where(F.length("prefix") >= LEAST_PREFIX)
    # Names meet prefixes on the first letters, an equality.
    key = lambda c: F.substr(c, F.lit(1), F.lit(LEAST_PREFIX))
    names = entries.select("rel", name.alias("name")).withColumn("key", key(F.col("name")))
    hits = p.withColumn("key", key(F.col("prefix"))).join(names, "key").where(F.col("name").startswith(F.col("prefix")))
    return hits.groupBy("dest", "prefix").agg(F.count(F.lit(1)).alias("total"), F.max("n").alias("n")).where("total = n").select("dest", "prefix")


_FILLED = "coalesce(text, '') <> ''"


def _grams(rows: DataFrame, *columns: str, salt: Column | None = None, bits: Broadcast | None = None) -> DataFrame:
    """The columns and gram: the distinct phrases of each text; with a map (``runs``) those that it may hold."""
    said = text.norm(F.col("text"))
    grams = text.ngrams(said) if bits is None else runs.in_map(said, salt, bits)
    # Not explode, for which the optimizer asks beforehand whether there are any, and so makes them twice.
    return rows.where(_FILLED).select(*columns, grams.alias("grams")).select(*columns, F.explode_outer("grams").alias("gram")).where("gram is not null")


def _common(entries: DataFrame) -> DataFrame:
    """dest, kind (null: several), gram, have: the phrases that all texts of a folder's moves share.

    They are in any one text of the folder, so a short one's phrases, as a map of bits, are what is looked for in the
    others; texts stay where they are read, and only rows of phrases that pass are dealt out.
    """
    drawn = F.octet_length("text") * F.lit(1 << 31) + F.pmod(F.xxhash64("rel"), F.lit(1 << 31))
    m = _moved(entries).withColumn("drawn", F.xxhash64("dest", drawn))
    # By kind first, as sums of numbers alone: an aggregate with strings would sort the rows, texts and all.
    kinds = m.groupBy("dest", "ext").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(_FILLED)).alias("texts"), F.min(drawn).alias("least"))
    folders = kinds.groupBy("dest").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"), F.min("ext").alias("k"), F.max("ext").alias("k2"), F.min("least").alias("least"))
    folders = folders.where((F.col("n") >= LEAST_MOVES) & (F.col("texts") == F.col("n")))
    short = maps.in_map(m, F.col("drawn"), folders.select(F.xxhash64("dest", "least").alias("key")), MAP_BITS)
    asked = runs.map_of(_grams(short, "dest"), F.col("dest"), F.col("gram"), MAP_BITS)
    have = _grams(m, "dest", salt=F.col("dest"), bits=asked).groupBy("dest", "gram").agg(F.count(F.lit(1)).alias("have"))
    return have.join(folders, "dest").where("have = n").select("dest", F.when(F.col("k") == F.col("k2"), F.col("k")).alias("kind"), "gram", "have")


def phrases(entries: DataFrame) -> DataFrame:
    """dest, ext, phrase, kind_phrase: the shortest, then least phrase of all texts of a folder's moves and of no other
    entry's; kind_phrase: of no other entry's of ext, the moves' one kind. Null where there is none."""
    spark, path = entries.sparkSession, scratch(entries.sparkSession, "phrases")
    _common(entries).write.parquet(path)
    common = spark.read.parquet(path)
    anyone = F.lit("")
    others = _grams(entries, "ext", salt=anyone, bits=runs.map_of(common, anyone, F.col("gram"), MAP_BITS))
    seen = others.groupBy("gram", "ext").agg(F.count(F.lit(1)).alias("total"))
    kinds = F.map_from_entries(F.collect_list(F.when(F.col("ext").isNotNull(), F.struct("ext", "total"))))
    both = common.join(seen.groupBy("gram").agg(F.sum("total").alias("total"), kinds.alias("kinds")), "gram")
    least = lambda alone: F.min(F.when(alone, F.struct(F.length("gram").alias("n"), F.col("gram"))))["gram"]
    of_kind = F.try_element_at("kinds", F.col("kind")) == F.col("have")
    return both.groupBy("dest", F.col("kind").alias("ext")).agg(least(F.col("total") == F.col("have")).alias("phrase"), least(of_kind).alias("kind_phrase"))


def by_phrase(entries: DataFrame) -> DataFrame:
    """dest, phrase: the shortest, then least phrase of all its texts and of no other entry's."""
    return phrases(entries).where("phrase is not null").select("dest", "phrase")


def by_identifier(entries: DataFrame, m: DataFrame, ledger: DataFrame) -> DataFrame:
    """dest, value: the least identifier of all its files, of no other entry, and of no ledger path elsewhere."""
    values = lambda df: df.withColumn("value", F.explode(F.array_distinct(identifiers.id_values(F.col("ids")))))
    common = values(m).groupBy("dest", "value").agg(F.count(F.lit(1)).alias("have"), F.max("n").alias("n")).where("have = n")
    total = values(entries).groupBy("value").agg(F.count(F.lit(1)).alias("total"))
    unique = common.join(total, "value").where("total = have").select("dest", "value")
    # Of a ledger's lines no more than this goes to their last one.
    lines = log.latest(log.files(ledger).select("path", "ids", "seq"))
    past = values(lines).select("value", text.norm(F.col("path")).alias("at")).distinct()
    elsewhere = unique.join(past, "value").where(~F.col("at").startswith(text.norm(F.concat("dest", F.lit("/"))))).select("dest", "value").distinct()
    return unique.join(elsewhere, ["dest", "value"], "left_anti").groupBy("dest").agg(F.min("value").alias("value"))


def rule_ids(dests: DataFrame, existing: list[str]) -> DataFrame:
    """dest, id: a slug of the last folder; a taken one gets -2, -3 and so on, in the order of dest."""
    last = F.element_at(F.split("dest", "/"), -1)
    slug = F.regexp_replace(F.regexp_replace(text.norm(F.regexp_replace(last, r"\{[^}]*\}", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    based = dests.select("dest", F.when(slug == "", "rule").otherwise(slug).alias("base"))
    if not existing:
        place = F.row_number().over(W.partitionBy("base").orderBy("dest"))
        return based.select("dest", F.when(place == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), place.cast("string"))).alias("id"))
    taken = F.array(*(F.lit(x) for x in existing))
    place = F.row_number().over(W.partitionBy("base").orderBy("dest"))
    # The place-th name of base, base-2, base-3 ... that is not taken.
    span = F.sequence(F.lit(1), F.col("place") + len(existing))
    names = F.transform(span, lambda i: F.when(i == 1, F.col("base")).otherwise(F.concat(F.col("base"), F.lit("-"), i.cast("string"))))
    return based.withColumn("place", place).select("dest", F.get(F.filter(names, lambda x: ~F.array_contains(taken, x)), F.col("place") - 1).alias("id"))


def template(dest: Column, year: Column) -> Column:
    """``dest`` with a year of its last folder, once, as a variable; a null year changes nothing."""
    name = F.element_at(F.split(dest, "/"), -1)
    head = F.substr(dest, F.lit(1), F.length(dest) - F.length(name))
    y = year.cast("string")
    at = F.position(y, name)
    swapped = F.concat(head, F.substr(name, F.lit(1), at - 1), F.lit("{doc_year}"), F.substr(name, at + F.length(y), F.length(name)))
    return F.when(F.coalesce(at, F.lit(0)) > 0, swapped).otherwise(dest)


def mined_rules(entries: DataFrame, ledger: DataFrame, pass_id: str, existing: list[str]) -> DataFrame:
    """id, form, condition (JSON), destination, learned_from: one rule per folder, the simplest form that no other
    entry contradicts: kind and folder, name, phrase, identifier, kind and phrase."""
    m = moves(entries)
    f1 = by_folder_and_kind(entries, m).select("dest", F.to_json(F.struct(F.array("ext").alias("ext"), F.array("src").alias("path_under"))).alias("c1"))
    escaped = F.regexp_replace("prefix", r"([^A-Za-z0-9_])", r"\\$1")
    f2 = by_prefix(entries, m).select("dest", F.to_json(F.struct(F.concat(F.lit("^"), escaped).alias("name_matches"))).alias("c2"))
    said = lambda c: F.array(c).alias("text_contains_any")
    c3 = F.when(F.col("phrase").isNotNull(), F.to_json(F.struct(said("phrase"))))
    c5 = F.when(F.col("kind_phrase").isNotNull(), F.to_json(F.struct(F.array("ext").alias("ext"), said("kind_phrase"))))
    # Written and read again, as what is found is: one plan of all forms, twice, would fill the driver.
    f35 = kept(phrases(entries).select("dest", c3.alias("c3"), c5.alias("c5")), "rules")
    f4 = by_identifier(entries, m, ledger).select("dest", F.to_json(F.struct(F.array("value").alias("ids_any"))).alias("c4"))
    g = m.groupBy("dest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_year").alias("y"), F.max("doc_year").alias("y2"), F.count("doc_year").alias("with_year"))
    for f in (f1, f2, f35, f4):
        g = g.join(f, "dest", "left")
    cs = [F.col(f"c{i}") for i in range(1, 6)]
    form = F.coalesce(*(F.when(c.isNotNull(), i) for i, c in enumerate(cs, 1)))
    found = kept(g.withColumns({"form": form, "condition": F.coalesce(*cs)}).where("condition is not null"), "rules")
    year = F.when((F.col("y") == F.col("y2")) & (F.col("with_year") == F.col("n")), F.col("y"))
    named = found.join(rule_ids(found.select("dest"), existing), "dest")
    return named.select("id", "form", "condition", template(F.col("dest"), year).alias("destination"), F.concat(F.lit(f"{pass_id}: "), F.col("n").cast("string"), F.lit(" moves to "), F.col("dest")).alias("learned_from"))


def unanswered(entries: DataFrame) -> DataFrame:
    """rel, reason of the entries that a pass leaves open."""
    settled = (F.coalesce("result", F.lit("")) != "") & (F.coalesce("decision", F.lit("")) != "unanswered")
    open_ = (F.coalesce("triage", F.lit("")) != "skip") & ~settled
    first = lambda *cs: F.coalesce(*(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)) for c in cs))
    row = F.struct("rel", F.coalesce(first("reason", "why"), F.lit("reached the end of the pass without a decision")).alias("reason"))
    # Not a filter on triage, which would be moved below triage and read the texts a second time.
    return entries.select(F.explode_outer(F.when(open_, F.array(row))).alias("row")).where("row is not null").select("row.rel", "row.reason")


def learn_report(entries: DataFrame) -> DataFrame:
    """kind, n: entries, unanswered, refused, answered_withdrawals."""
    has = F.coalesce("result", F.lit("")) != ""
    counted = entries.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if((F.coalesce("triage", F.lit("")) != "skip") & ~(has & (F.coalesce("decision", F.lit("")) != "unanswered"))).alias("unanswered"),
        F.count_if(F.coalesce(F.col("result") == "refused", F.lit(False))).alias("refused"),
        F.count_if(F.col("triage").isNull() & has).alias("answered_withdrawals"),
    )
    return counted.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in counted.columns)), F.array(*counted.columns))).alias("kind", "n"))


def _ready(rows: DataFrame, rule: dict) -> tuple[DataFrame, Column, Column]:
    e = prepared(rows)
    if not rule.get("destination"):
        return e, F.lit(None).cast("string"), F.lit(None).cast("string")
    # No entity is known in an audit.
    values = paths.destination_values(F.col("rel"), F.col("ext"), F.col("doc_year"), F.lit(None).cast("string"))
    return e, *paths.render_destination(rule["destination"], values)


def audited(ledger: DataFrame, rule: dict) -> DataFrame:
    """rel, agrees (null: cannot be judged) of the latest ledger rows a rule matches; descriptions stand for texts."""
    rows = log.latest(ledger).where(~F.coalesce(F.col("decision").isin("unanswered", "refused"), F.lit(False)))
    year = F.substr("date_doc", F.lit(1), F.lit(4))
    rows = rows.select(F.col("path").alias("rel"), "size", F.col("desc").alias("text"), "ids", F.when(year.rlike(r"^\d+$"), year.cast("int")).alias("doc_year"), F.col("tags").alias("_tags"))
    e, folder, missing = _ready(rows.withColumn("ext", F.regexp_replace(paths.ext_of(F.col("rel")), r"^\?$", "")), rule)
    there = text.norm(F.col("rel")).startswith(text.norm(folder))
    agrees = F.when(missing.isNull(), there) if rule.get("destination") else F.lit(None).cast("boolean")
    if not rule.get("destination") and rule.get("tags"):
        agrees = tag.contained(F.array(*(F.lit(t) for t in rule["tags"])), F.coalesce("_tags", F.array().cast("array<string>")))
    return e.where(compiled(rule.get("when") or {}).match).select("rel", agrees.alias("agrees"))


def audit(ledger: DataFrame, rule: dict) -> DataFrame:
    """matched, agreed, disagreed, unjudged."""
    a = F.col("agrees")
    return audited(ledger, rule).agg(F.count(F.lit(1)).alias("matched"), F.count_if(a).alias("agreed"), F.count_if(~a).alias("disagreed"), F.count_if(a.isNull()).alias("unjudged"))


def cheap_candidates(files: DataFrame, rule: dict) -> DataFrame:
    """Files that a rule could match as far as path and size show; no text is read for it."""
    return prepared(files).where(compiled(rule.get("when") or {}).cheap).select(*files.columns)


def _audited(files: DataFrame, rule: dict, limit: int, as_of_year: int, kinds: dict | None) -> DataFrame:
    """The first candidates by path with what their texts say; a null text could not be read."""
    few = cheap_candidates(files, rule).orderBy("rel").limit(limit).drop("ids", "doc_year")
    dates = identifiers.extract_dates(F.col("text"))
    return few.withColumns({"ids": identifiers.extract_ids(F.col("text"), kinds), "doc_year": identifiers.doc_year(dates, as_of_year)})


def full_audit(files: DataFrame, rule: dict, as_of_year: int, limit: int = AUDITED, kinds: dict | None = None) -> DataFrame:
    """rel, strength, destination of what a rule touches among the first candidates by path, whose texts are read:
    identifiers (``kinds`` as configured) and year come from them. No destination in the rule: null."""
    e, folder, missing = _ready(_audited(files, rule, limit, as_of_year, kinds), rule)
    strength = compiled(rule.get("when") or {}).strength
    return e.where(strength > 0).select("rel", strength.alias("strength"), F.coalesce(folder, F.concat(F.lit("unresolved: "), missing)).alias("destination"))


def full_audit_counts(files: DataFrame, rule: dict, limit: int = AUDITED) -> DataFrame:
    """candidates, audited, unreadable of a full audit."""
    found = cheap_candidates(files, rule)
    read = found.orderBy("rel").limit(limit).agg(F.count(F.lit(1)).alias("audited"), F.count_if(F.col("text").isNull()).alias("unreadable"))
    return found.agg(F.count(F.lit(1)).alias("candidates")).join(F.broadcast(read))  # one row each


def dead_anchors(anchors: DataFrame, known: DataFrame, workspace: str) -> DataFrame:
    """anchor, pointer: paths in back-ticks of instruction files that name nothing. ``anchors``: anchor, body;
    ``known``: rel of every file and folder."""
    found = anchors.select("anchor", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"`([^`\n]+)`"), F.lit(1)))).alias("pointer"))
    looks = (F.col("pointer").rlike("^[~/]") | F.contains("pointer", F.lit("/"))) & ~F.col("pointer").rlike(r"[\s*?{$]") & ~F.col("pointer").rlike(r"^/[\w-]+$")
    found = found.where(looks)
    clean = F.regexp_replace("pointer", "/+$", "")
    tried = found.withColumn("rel", F.explode(F.array(clean, F.concat(F.lit(workspace.rstrip("/") + "/"), clean))))
    alive = tried.join(known.select("rel").distinct(), "rel", "left_semi").select("anchor", "pointer").distinct()
    return found.join(alive, ["anchor", "pointer"], "left_anti")
