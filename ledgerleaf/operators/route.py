"""Triage: guards, entities, shadow rules and active rules give every entry one lane with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import identifiers, needles, paths
from ledgerleaf.plans.conditions import IDENTIFIER, UNPREPARED, compiled, prepared, sensitive_hit
from ledgerleaf.plans.config import LANES

from . import ledger as log

# Decisions by hand that settle where a file is; characters of a reason that are repeated.
SETTLING, REASON_KEPT = ("none", "move", "rename"), 400


#: Columns that triage adds; older ones of these names give way.
ADDED = ("triage", "why", "guards", "rule", "entity", "strength", "destination", "shadow")


def inbox_of(path: Column, inboxes: list[dict], root: str) -> Column:
    """The first configured inbox that holds the path, as configured."""
    tries = []
    for box in inboxes:
        p = box["path"]
        at = p if p.startswith("/") else f"{root.rstrip('/')}/{p}"
        tries.append(F.when(paths.inside(path, F.lit(at)), F.lit(p)))
    return F.coalesce(*tries) if tries else F.lit(None).cast("string")


def entity_grades(entities: list[dict]) -> Column:
    """array of (strength, name, bucket) of the entities with any evidence, in configured order."""
    graded = []
    for e in entities:
        by_id = F.lit(False)
        if e.get("ids"):
            wanted = F.array(*(F.lit(str(x).replace(" ", "").replace(".", "")) for x in e["ids"]))
            by_id = F.coalesce(F.arrays_overlap(identifiers.id_values(F.col("ids")), wanted), F.lit(False))
        strength = F.when(by_id, F.lit(IDENTIFIER)).otherwise(compiled(e.get("match") or {}).strength)
        graded.append(F.struct(strength.alias("strength"), F.lit(e["name"]).alias("name"), F.lit(e.get("bucket") or e["name"]).alias("bucket")))
    if not graded:
        return F.array().cast("array<struct<strength:int,name:string,bucket:string>>")
    return F.filter(F.array(*graded), lambda x: x["strength"] > 0)


def with_entity(entries: DataFrame, entities: list[dict]) -> DataFrame:
    """Adds entity (the bucket of the only one with the strongest evidence) and rivals (names, where several tie)."""
    e = entries.withColumn("_grades", entity_grades(entities))
    top = F.array_max(F.transform("_grades", lambda x: x["strength"]))
    e = e.withColumn("_best", F.filter("_grades", lambda x: x["strength"] == top))
    one = F.size("_best") == 1
    names = F.when(F.size("_best") > 1, F.transform("_best", lambda x: x["name"])).otherwise(F.array().cast("array<string>"))
    return e.withColumns({"entity": F.when(one, F.get("_best", 0)["bucket"]), "rivals": names}).drop("_grades", "_best")


def _destination(rule: dict) -> tuple[Column, Column]:
    none = F.lit(None).cast("string")
    if not rule.get("destination"):
        return none, none
    values = paths.destination_values(F.col("rel"), F.col("ext"), F.col("doc_year"), F.col("entity"))
    return paths.render_destination(rule["destination"], values)


def shadow_predictions(rules: list[dict]) -> Column:
    """array of (rule, strength, destination, unresolved, tags): what each matching shadow rule would have done."""
    made = []
    for r in rules:
        if r.get("status", "shadow") != "shadow":
            continue
        folder, missing = _destination(r)
        tags = F.array(*(F.lit(t) for t in r["tags"])) if r.get("tags") else F.lit(None).cast("array<string>")
        made.append(F.struct(F.lit(r["id"]).alias("rule"), compiled(r.get("when") or {}).strength.alias("strength"), folder.alias("destination"), missing.alias("unresolved"), tags.cast("array<string>").alias("tags")))
    if not made:
        return F.array().cast("array<struct<rule:string,strength:int,destination:string,unresolved:string,tags:array<string>>>")
    return F.filter(F.array(*made), lambda x: x["strength"] > 0)


def settled(ledger: DataFrame) -> DataFrame:
    """rel, settled: why a file stays where a decision by hand last left it."""
    last = log.latest(ledger).where((F.col("provenance") == "human-decision") & F.col("decision").isin(*SETTLING))
    why = F.regexp_replace(F.trim(F.coalesce("reason", F.lit(""))), "\n", " ")
    said = F.concat(F.lit("already settled by hand in pass "), F.coalesce("pass", F.lit("None")), F.when(why != "", F.concat(F.lit(": "), F.substring(why, 1, REASON_KEPT))).otherwise(""))
    return last.select(F.col("path").alias("rel"), said.alias("settled"))


def _first_rule(rules: list[dict]) -> Column:
    """(rule, strength, destination, unresolved) of the first active rule that matches; one without a value for a
    variable of its destination still ends the search."""
    tries = []
    for r in rules:
        if r.get("status", "shadow") != "active":
            continue
        m = compiled(r.get("when") or {})
        folder, missing = _destination(r)
        found = F.struct(F.lit(r["id"]).alias("rule"), m.strength.alias("strength"), folder.alias("destination"), missing.alias("unresolved"))
        tries.append(F.when(m.match, found))
    return F.coalesce(*tries) if tries else F.lit(None).cast("struct<rule:string,strength:int,destination:string,unresolved:string>")


def triage(entries: DataFrame, config: dict, ledger: DataFrame | None = None) -> DataFrame:
    """Adds triage, why, guards, rule, entity, strength, destination, shadow.

    ``entries``: rel, path, ext, size, text, ids, doc_year, and known_as, duplicate_of, md5, error, opaque, link_to
    where there are any. All guards are named; the first of skip, settled, sensitive, duplicate, inbox, entity-tie
    decides. Else the first active rule does, capped at a proposal where only the path speaks. A configuration with
    many phrases is matched by one automaton (``needles``), with the same result.
    """
    with needles.looked_up({k: config.get(k) for k in ("rules", "entities", "sensitive")}):
        return _triaged(entries, config, ledger)


def _triaged(entries: DataFrame, config: dict, ledger: DataFrame | None) -> DataFrame:
    optional = {"known_as": "string", "duplicate_of": "array<string>", "md5": "string", "error": "string", "opaque": "string", "link_to": "string", "path": "string", "ids": "map<string,array<string>>", "doc_year": "int"}
    for name, kind in optional.items():
        if name not in entries.columns:
            entries = entries.withColumn(name, F.lit(None).cast(kind))
    if ledger is not None:
        entries = entries.join(settled(ledger), "rel", "left")
    elif "settled" not in entries.columns:
        entries = entries.withColumn("settled", F.lit(None).cast("string"))
    columns = [c for c in entries.columns if c not in ("settled", *ADDED)]
    e = with_entity(prepared(entries), config.get("entities") or [])
    e = e.withColumn("shadow", shadow_predictions(config.get("rules") or []))
    box = inbox_of(F.coalesce("path", F.concat(F.lit(config["root"].rstrip("/") + "/"), F.col("rel"))), config.get("inboxes") or [], config["root"])
    e = e.withColumns({"_hit": sensitive_hit(config.get("sensitive")), "_inbox": box, "_rule": _first_rule(config.get("rules") or [])})
    twin = F.get("duplicate_of", 0)
    guard = lambda name, lane, when, why: F.when(when, F.struct(F.lit(name).alias("guard"), F.lit(lane).alias("lane"), why.alias("why")))
    md5 = F.when(F.coalesce("md5", F.lit("")) != "", F.concat(F.lit(" (md5 "), F.col("md5"), F.lit(")"))).otherwise("")
    guards = [
        guard("skip", "skip", F.coalesce("known_as", F.lit("")) != "", F.concat(F.lit("same content already recorded as "), F.col("known_as"))),
        guard("settled", "propose", F.col("settled").isNotNull(), F.col("settled")),
        guard("sensitive", "propose", F.col("_hit").isNotNull(), F.concat(F.lit("sensitive ("), F.col("_hit"), F.lit(")"))),
        guard("duplicate", "propose", F.coalesce(F.size("duplicate_of"), F.lit(0)) > 0, F.concat(F.lit("byte-identical to "), twin, md5)),
        guard("inbox", "propose", F.col("_inbox").isNotNull(), F.concat(F.lit("sitting in inbox "), F.col("_inbox"), F.lit(" — never a silent route"))),
        guard("entity-tie", "propose", F.size("rivals") > 0, F.concat(F.lit("claimed by "), F.array_join("rivals", " and "), F.lit(" on evidence of equal strength — reading decides"))),
    ]
    e = e.withColumn("_guards", F.filter(F.array(*guards), lambda g: g.isNotNull()))
    first, r = F.get("_guards", 0), F.col("_rule")
    free = F.size("_guards") == 0
    rule_lane = F.when(r["unresolved"].isNotNull(), "propose").when(r["strength"] <= 1, "propose").otherwise("route")
    rule_why = (
        F.when(r["unresolved"].isNotNull(), F.concat(F.lit("destination variable unresolved: "), r["unresolved"]))
        .when(r["strength"] <= 1, F.concat(F.lit("rule "), r["rule"], F.lit(" matched on the path or filename alone")))
        .otherwise(F.concat(F.lit("rule "), r["rule"], F.lit(" (evidence strength "), r["strength"].cast("string"), F.lit(")")))
    )
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    rest = F.when(F.col("link_to").isNotNull(), F.concat(F.lit("symlink -> "), F.col("link_to"), F.lit(" — a pointer, not a document"))).when(blank, F.coalesce(filled("error"), filled("opaque"), F.lit("no text to reason on"))).otherwise("no rule matched")
    chosen = free & r.isNotNull()
    return e.select(
        *columns,
        F.when(~free, first["lane"]).when(chosen, rule_lane).otherwise("residual").alias("triage"),
        F.when(~free, first["why"]).when(chosen, rule_why).otherwise(rest).alias("why"),
        F.transform("_guards", lambda g: g["guard"]).alias("guards"),
        F.when(chosen, r["rule"]).alias("rule"),
        "entity",
        F.when(chosen, r["strength"]).alias("strength"),
        F.when(chosen, r["destination"]).alias("destination"),
        "shadow",
    )


def unread(entries: DataFrame) -> DataFrame:
    """Rows that only a look can read and nobody has decided: while there are any, a pass must not go on."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return entries.where(F.coalesce("needs_vision", F.lit(False)) & blank & none("decision") & none("known_as"))


def checked(entries: DataFrame) -> DataFrame:
    """``entries``, or an error that names the first unread ones."""
    left = unread(entries).select("rel").limit(20).collect()  # at most 20 names, for the message
    if left:
        raise ValueError("unread: " + ", ".join(r.rel for r in left))
    return entries


def routed(entries: DataFrame, config: dict, ledger: DataFrame | None = None) -> DataFrame:
    """``triage`` with decided rows respected: withdrawn ones have no lane, those decided by hand unread are proposals."""
    made = triage(entries, config, ledger)
    if "decision" not in entries.columns:
        return made
    withdrawn = F.coalesce(F.col("decision") == "unanswered", F.lit(False))
    by_hand = F.coalesce("needs_vision", F.lit(False)) & (F.coalesce("decision", F.lit("")) != "") if "needs_vision" in entries.columns else F.lit(False)
    return made.withColumn("triage", F.when(~withdrawn, F.when(by_hand, "propose").otherwise(F.col("triage"))))


def acting_rules_are_active(made: DataFrame, config: dict) -> DataFrame:
    """``made``; evaluating it fails where a rule that is not active decided."""
    active = [r["id"] for r in config.get("rules") or [] if r.get("status") == "active"]
    ok = F.col("rule").isNull() | F.col("rule").isin(*active)
    return made.where(F.assert_true(ok, "a rule that is not active decided").isNull())


def lane_counts(made: DataFrame) -> DataFrame:
    """triage, n: all four lanes, and withdrawn for rows without one."""
    lanes = made.sparkSession.createDataFrame([(x,) for x in (*LANES, "withdrawn")], "triage string")
    n = made.groupBy(F.coalesce("triage", F.lit("withdrawn")).alias("triage")).agg(F.count(F.lit(1)).alias("n"))
    return lanes.join(n, "triage", "left").select("triage", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rule_counts(made: DataFrame) -> DataFrame:
    """kind (rule or shadow), rule, n."""
    acted = made.where("rule is not null").groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select(F.lit("rule").alias("kind"), "rule", "n")
    would = made.select(F.explode("shadow.rule").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select(F.lit("shadow").alias("kind"), "rule", "n")
    return acted.unionByName(would)


def unprepared(df: DataFrame) -> DataFrame:
    return df.drop(*UNPREPARED)
