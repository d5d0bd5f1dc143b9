"""The plan of a pass: what each decision would do, what is refused, what fails. Nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerleaf.functions import maps, paths, text
from ledgerleaf.plans.conditions import compiled, prepared, sensitive_hit
from ledgerleaf.sources.scratch import kept

from . import collect
from . import ledger as log

# Gestures and the results they are stamped with.
RESULT = {"move": "moved", "rename": "renamed", "trash": "trashed", "tag": "tagged", "none": "kept"}
GESTURES = tuple(RESULT)
# The reasons that a ledger or a report shows.
OUTSIDE = "path outside root and every inbox"
OWN = "inside the workspace — the tool does not ingest itself"
NO_GUARD = "config declares no `sensitive:` — nothing is binned until it does"
UNREADABLE = "no readable text re-extracted from a non-trivial file (empty or extractor debris) — kept until reviewed with vision"
TAKEN = "a file is already there, and so is its (2)"
IN_ITSELF = "destination sits inside the source"


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def destination(dst: Column, rel: Column, folder: Column | None = None) -> Column:
    """Where a file would lie: a destination that ends in a slash, or is a folder (``folder``), is one to file into."""
    into = F.when(dst.endswith("/"), F.concat(dst, paths.basename(rel)))
    return into.otherwise(dst) if folder is None else into.when(folder, F.concat(dst, F.lit("/"), paths.basename(rel))).otherwise(dst)


def second_name(path: Column) -> Column:
    """``stem (2).ext`` in the same folder."""
    name, base = paths.basename(path), paths.stem(path)
    folder = F.substr(path, F.lit(1), F.length(path) - F.length(name))
    return F.concat(folder, base, F.lit(" (2)"), F.substr(name, F.length(base) + 1, F.length(name)))


def _kept(rows: DataFrame) -> DataFrame:
    """``rows``, written and read again: each round of a resolution starts from a table."""
    return kept(rows, "moves")


def _settled(moves: DataFrame, there: DataFrame, folders: DataFrame, before: DataFrame | None) -> DataFrame:
    """rel, dst, ord, final, why of ``moves``, if those of ``before`` are where the earlier ones of them end."""
    m = moves.join(folders.select(F.col("folder").alias("dst"), F.lit(True).alias("is_folder")), "dst", "left")
    folder = F.coalesce("is_folder", F.lit(False))
    done = None if before is None else before.where("final is not null and final <> rel")
    if done is not None:
        made = done.select(F.explode(paths.ancestors(F.col("final"))).alias("folder"), "ord").groupBy("folder").agg(F.min("ord").alias("since"))
        made = _kept(made)
        m = m.join(made.select(F.col("folder").alias("dst"), "since"), "dst", "left")
        folder = folder | F.coalesce(F.col("since") < F.col("ord"), F.lit(False))
    m = m.withColumn("want", destination(F.col("dst"), F.col("rel"), folder)).select("rel", "dst", "ord", "want")
    m = _kept(m.withColumn("second", second_name(F.col("want"))))

    # What comes to a name and leaves it, in the order of moves; a question sees what lies before it.
    event = lambda df, name, kind, change: df.select(F.col(name).alias("name"), "ord", "rel", F.lit(kind).alias("kind"), F.lit(change).alias("change"))
    asked = event(m, "want", 1, 0).unionByName(event(m, "second", 2, 0))
    events = asked
    if done is not None:
        leaving = done.join(there.select(F.col("name").alias("rel")), "rel", "left_semi")
        events = asked.unionByName(event(done, "final", 3, 1)).unionByName(event(leaving, "rel", 3, -1))
    else:
        # Nothing leaves; each name goes to the first that wants it, its second to the next one.
        events = asked.unionByName(event(m.where("want <> rel"), "want", 3, 1))
    so_far = F.coalesce(F.sum("change").over(W.partitionBy("name").orderBy("ord", "rel", "kind").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    told = events.withColumn("so_far", so_far).where("kind < 3").join(there.withColumn("n", F.lit(1)), "name", "left")
    told = told.join(folders.select(F.col("folder").alias("name"), F.lit(True).alias("is_folder")), "name", "left")
    there_now = (F.coalesce("n", F.lit(0)) + F.col("so_far") > 0) | F.coalesce("is_folder", F.lit(False))
    if done is not None:
        told = told.join(made.select(F.col("folder").alias("name"), "since"), "name", "left")
        there_now = there_now | F.coalesce(F.col("since") < F.col("ord"), F.lit(False))
    state = told.groupBy("rel", "ord").agg(F.max(F.when(F.col("kind") == 1, there_now)).alias("one"), F.max(F.when(F.col("kind") == 2, there_now)).alias("two"), F.max(F.when(F.col("kind") == 1, F.col("so_far") + F.coalesce("n", F.lit(0)))).alias("ahead"))
    m = m.join(state, ["rel", "ord"])
    inside_itself, stays = F.col("want").startswith(F.concat(F.col("rel"), F.lit("/"))), F.col("want") == F.col("rel")
    second = ~F.col("two") & (F.col("ahead") <= 1) if done is None else ~F.col("two")
    final = F.when(inside_itself, None).when(stays, F.col("rel")).when(~F.col("one"), F.col("want")).when(second, F.col("second"))
    return m.select("rel", "dst", "ord", "want", "second", final.alias("final"), F.when(inside_itself, F.lit(IN_ITSELF)).when(final.isNull(), F.lit(TAKEN)).alias("why"))


def _crossed(now: DataFrame) -> bool:
    """Whether an end of the first guess may change: some move asks for a name that another leaves, for one that is
    the first choice of one and the second of another, or files into a folder that a move makes."""
    asked = now.select("rel", F.explode(F.array(F.struct(F.col("want").alias("name"), F.lit(1).alias("kind")), F.struct(F.col("second").alias("name"), F.lit(2).alias("kind")))).alias("a")).select("rel", "a.*")
    left = now.select(F.col("rel").alias("name"), F.lit(0).alias("kind"))
    made = now.where("final <> rel").select(F.explode(paths.ancestors(F.col("final"))).alias("name"), F.lit(3).alias("kind"))
    into = now.where("want <> rel").select(F.explode(F.array("dst", "want", "second")).alias("name"), F.lit(4).alias("kind"))
    kinds = asked.where("name <> rel").drop("rel").unionByName(left).unionByName(made).unionByName(into).groupBy("name").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("kinds"))
    # Asked for and left; first and second choice; made and filed into.
    return bool(kinds.where("(kinds & 1 = 1 and kinds & 6 > 0) or (kinds & 6 = 6) or (kinds & 24 = 24)").take(1))


def placed(moves: DataFrame, files: DataFrame) -> DataFrame:
    """Adds final, why: the free name of each move, or why there is none.

    ``moves``: rel, dst, ord. Moves are made one after the other, in the order of ``ord``: a name that a file or an
    earlier move has is taken, unless an earlier move took that file away; then ``(2)`` is tried, once. A destination
    that ends in a slash, or is a folder by then, is one to file into.

    All moves are settled side by side, from where the moves before them end; the first guess is that none leaves a
    name free. Where that changes an end, all are settled again from the new ones, until none changes: what a move
    finds depends on earlier ones only, so the first moves of a chain are right after one round, those after them in
    the next, and what does not change any more is what making them in order gives.
    """
    there = files.select(F.col("rel").alias("name")).distinct()
    folders = files.select(F.explode(paths.ancestors(F.col("rel"))).alias("folder")).distinct()
    asked = moves.select("rel", "dst", "ord")
    now = _kept(_settled(asked, there, folders, None))
    open_ = _crossed(now)
    while open_:
        then = _kept(_settled(asked, there, folders, now))
        changed = then.alias("a").join(now.alias("b"), ["rel", "ord"]).where(~F.col("a.final").eqNullSafe(F.col("b.final")))
        now, open_ = then, bool(changed.take(1))
    return moves.join(now.select("rel", "ord", "final", "why"), ["rel", "ord"]).select(*moves.columns, "final", "why")


def keepers(decided: DataFrame, files: DataFrame) -> DataFrame:
    """rel, keeper, same: for each row whose named keeper is another existing file that is not being binned itself;
    same: its bytes are the row's."""
    binned = decided.where("decision = 'trash'").select(F.col("rel").alias("keeper"))
    named = decided.where(_filled("keeper") & (F.col("keeper") != F.col("rel"))).select("rel", "keeper", "md5")
    alive = named.join(files.select(F.col("rel").alias("keeper"), F.col("md5").alias("keeper_md5")), "keeper").join(binned, "keeper", "left_anti")
    return alive.select("rel", "keeper", F.coalesce(F.col("md5") == F.col("keeper_md5"), F.lit(False)).alias("same"))


def _families(families: list[dict]) -> Column:
    """Over a ``prepared`` frame: the declared families that a file belongs to, each with its place."""
    member = [F.when(compiled({k: v for k, v in f.items() if k != "id"}).match, F.lit(f"{i:06d} {f.get('id', 'supersedable')}")) for i, f in enumerate(families)]
    return F.filter(F.array(*member), lambda x: x.isNotNull()) if member else F.array().cast("array<string>")


def _superseded(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """rel, keeper, family of the ``pairs`` that share one. ``of``: rel, families."""
    of = of.select("rel", "families").where(F.size("families") > 0)
    both = pairs.join(of, "rel").join(of.select(F.col("rel").alias("keeper"), F.col("families").alias("theirs")), "keeper")
    first = F.array_min(F.array_intersect("families", "theirs"))
    return both.where(F.arrays_overlap("families", "theirs")).select("rel", "keeper", F.substr(first, F.lit(8), F.length(first)).alias("family"))


def superseded(decided: DataFrame, files: DataFrame, families: list[dict]) -> DataFrame:
    """rel, keeper, family: the first declared family that both the row and its keeper belong to. What texts say of
    the families is written down and read for both."""
    if not families:
        return decided.sparkSession.createDataFrame([], "rel string, keeper string, family string")
    of = kept(prepared(files).select("rel", _families(families).alias("families")), "families")
    return _superseded(keepers(decided, files), of)


def _told(decided: DataFrame, files: DataFrame, guard: dict | None) -> DataFrame:
    """rel, md5, size, prose, hit, families (and doc_year where ``decided`` has it and the guard asks for it) of the files
    that are to be binned or named as keepers: all that a guard asks of texts, told where they are read. A few other
    files may be among them."""
    rows = decided.where("decision = 'trash'")
    keys = rows.select(F.xxhash64("rel").alias("key")).unionByName(decided.where(_filled("keeper")).select(F.xxhash64("keeper").alias("key")))
    few = maps.in_map(files, F.xxhash64("rel"), keys)
    # Trivial files are binned whatever they say.
    e = few.withColumn("prose", text.is_prose(F.when(F.col("size") > collect.TRIVIAL_BYTES, F.col("text"))))
    e = prepared(e).withColumn("families", _families((guard or {}).get("supersedable") or []))
    # The year that a guard sees is the decided row's.
    year = ["doc_year"] if "doc_year" in decided.columns and "doc_year_in" in str(guard) else []
    e = e.drop("doc_year").join(rows.select("rel", "doc_year").distinct(), "rel", "left") if year else e.withColumn("doc_year", F.lit(None).cast("int"))
    return e.select("rel", "md5", "size", "prose", sensitive_hit(guard).alias("hit"), "families", *year)


def trash_guard(decided: DataFrame, files: DataFrame, config: dict) -> DataFrame:
    """rel, status (applied or refused), why, reason: whether a file may be binned.

    Nothing is binned while no guard is configured; nor what cannot be read, unless it is small, was looked at, or a
    copy of its bytes stays; nor what the guard protects, unless such a copy or a later edition stays.

    What texts say is written down once and joined without them.
    """
    guard = config.get("sensitive")
    told = kept(_told(decided, files, guard), "told")
    rows = decided.where("decision = 'trash'").drop("text", "ext", "ids", "md5", "size", "prose", "hit", "families")
    e = rows.join(told.drop("md5", "families", "doc_year"), "rel")
    known = told
    if "doc_year" in told.columns:
        of_row = rows["rel"] == told["rel"]
        e = rows.join(told.drop("md5", "families"), of_row & rows["doc_year"].eqNullSafe(told["doc_year"])).drop(told["rel"], told["doc_year"])
        known = told.dropDuplicates(["rel"])
    pairs = keepers(decided, known)
    twin = pairs.where("same").select("rel", F.col("keeper").alias("twin"))
    older = _superseded(pairs, known).select("rel", F.col("keeper").alias("newer"), "family")
    e = e.join(twin, "rel", "left").join(older, "rel", "left")
    kept_by_bytes = F.col("twin").isNotNull()
    unreadable = ~F.coalesce("prose", F.lit(False)) & (F.col("size") > collect.TRIVIAL_BYTES) & ~kept_by_bytes & ~F.coalesce(F.col("reviewed") == "vision", F.lit(False))
    protected = F.col("hit").isNotNull() & ~kept_by_bytes & F.col("newer").isNull()
    why = F.when(F.lit(not guard), F.lit(NO_GUARD))
    why = why.when(unreadable, F.lit(UNREADABLE))
    why = why.when(protected, F.concat(F.lit("sensitive ("), F.col("hit"), F.lit(") — kept")))
    reason = F.coalesce("why", F.lit(""))
    reason = F.when(kept_by_bytes, F.concat(reason, F.lit(" — binned only because "), F.col("twin"), F.lit(" keeps the same bytes"))).when(
        F.col("hit").isNotNull() & F.col("newer").isNotNull(), F.concat(reason, F.lit(" — superseded edition ("), F.col("family"), F.lit("), replaced by "), F.col("newer"))
    ).otherwise(reason)
    return e.select("rel", F.when(why.isNull(), "applied").otherwise("refused").alias("status"), why.alias("refusal"), reason.alias("reason"))


def plan(decided: DataFrame, files: DataFrame, config: dict, pass_id: str, ledger: DataFrame | None = None, resume: bool = False) -> DataFrame:
    """rel, decision, status (applied, refused, failed, undecided, done), kind, why, final: a row per decided entry.

    ``decided``: rel, decision, dst, keeper, reviewed, why, desc, md5, ord, and result where a pass is resumed.
    ``files``: rel, size, md5, text, ext, ids. Order of the tests: known decision, inside the root or an inbox, outside
    the workspace, exists; then the guard; then what the decision itself needs. With ``resume`` rows that have a
    result are done, and gestures that an interrupted run did (``reconcile``, with ``ledger``) are not done again.
    """
    root_rel = lambda c: ~c.startswith("/") & ~c.startswith("~")
    moves = placed(decided.where(F.col("decision").isin("move", "rename") & _filled("dst")).select("rel", "dst", "ord"), files).select("rel", "final", F.col("why").alias("no_place"))
    guard = trash_guard(decided, files, config).select("rel", F.col("refusal"))
    e = decided.join(files.select("rel", F.lit(True).alias("exists")), "rel", "left").join(moves, "rel", "left").join(guard, "rel", "left")
    before = F.lit(None).cast("string")
    if resume and ledger is not None:
        e = e.join(reconcile(decided, files, ledger, pass_id).select("rel", F.col("final").alias("before")), "rel", "left")
        before = F.col("before")
    moving = F.col("decision").isin("move", "rename")
    inside = root_rel(F.col("rel")) & (F.coalesce("rel", F.lit("")) != "")
    for inbox in config.get("inboxes") or []:
        inside = inside | paths.inside(F.col("rel"), F.lit(inbox["path"] if isinstance(inbox, dict) else inbox))
    undecided = ~_filled("decision") | (F.col("decision") == "unanswered")
    done = _filled("result") if resume and "result" in decided.columns else F.lit(False)
    general = (
        F.when(~F.col("decision").isin(*GESTURES), F.concat(F.lit("unknown decision '"), F.col("decision"), F.lit("'")))
        .when(~F.coalesce(inside, F.lit(False)), F.lit(OUTSIDE))
        .when(paths.inside(F.col("rel"), F.lit(config.get("workspace_rel", ".triage"))), F.lit(OWN))
        .when(F.col("exists").isNull() & before.isNull(), F.lit("not found"))
    )
    own = (
        F.when(moving & ~_filled("dst"), F.lit("no destination"))
        .when(moving & ~root_rel(F.col("dst")), F.lit("destination outside root"))
        .when(moving & F.col("final").isNull(), F.col("no_place"))
        .when(log.paraphrases_name(F.col("desc"), F.when(moving, F.col("final")).otherwise(F.col("rel"))), F.lit("the description repeats the file name"))
    )
    status = (
        F.when(done, "done")
        .when(undecided, "undecided")
        .when(general.isNotNull(), "failed")
        .when(before.isNotNull(), "applied")
        .when(F.col("refusal").isNotNull(), "refused")
        .when(own.isNotNull(), "failed")
        .otherwise("applied")
    )
    applied = status == "applied"
    ends = F.coalesce(before, F.when(moving, F.col("final")).when(F.col("decision") == "trash", "bin").otherwise(F.col("rel")))
    return e.select(
        "rel",
        "decision",
        status.alias("status"),
        F.when(applied, F.when(before.isNotNull(), "reconcile").otherwise(F.col("decision"))).alias("kind"),
        F.when(status == "failed", F.coalesce(general, own)).when(status == "refused", F.col("refusal")).otherwise(F.coalesce("why", F.lit(""))).alias("why"),
        F.when(applied, ends).alias("final"),
        F.lit(pass_id).alias("pass"),
    )


def refused_rows(planned: DataFrame) -> DataFrame:
    """Ledger lines of refusals: the decision and the reason it was refused, without content."""
    rows = planned.where("status = 'refused'")
    return rows.select(F.col("rel").alias("path"), "pass", F.lit("refused").alias("decision"), F.concat(F.col("decision"), F.lit(" refused: "), F.col("why")).alias("reason"), F.lit(None).cast("string").alias("md5"))


def summary(planned: DataFrame) -> DataFrame:
    """kind, n: applied by kind; failed, refused, undecided, done; memory_lines, the lines that the ledger gets (of
    what is applied and of what is refused)."""
    kinds = planned.groupBy(F.when(F.col("status") == "applied", F.concat(F.lit("applied:"), F.col("kind"))).otherwise(F.col("status")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    lines = planned.agg(F.lit("memory_lines").alias("kind"), F.count_if(F.col("status").isin("applied", "refused")).alias("n"))
    return kinds.unionByName(lines)


def reconcile(decided: DataFrame, files: DataFrame, ledger: DataFrame, pass_id: str) -> DataFrame:
    """rel, final, recorded: gestures that an interrupted run of this pass did already.

    Proof is a line of this pass for the same content, with the file where it says, or the same bytes at the
    destination; without a known content there is none.
    """
    gone = decided.where("md5 is not null").join(files.select("rel"), "rel", "left_anti").where(F.col("decision").isin("move", "rename", "trash"))
    lines = log.paths_by_content(ledger).where(F.col("pass") == pass_id).select("md5", F.col("path").alias("at"), F.col("decision"), F.col("seq"))
    bytes_at = files.select(F.col("rel").alias("at"), F.col("md5").alias("at_md5"))
    by_line = gone.join(lines, ["md5", "decision"]).join(bytes_at, "at", "left")
    ok = (F.col("decision") == "trash") | F.coalesce(F.col("at_md5") == F.col("md5"), F.lit(False))
    by_line = by_line.where(ok).groupBy("rel").agg(F.min_by(F.when(F.col("decision") == "trash", "bin").otherwise(F.col("at")), "seq").alias("line"))
    there = gone.where(F.col("decision").isin("move", "rename") & _filled("dst")).withColumn("at", destination(F.col("dst"), F.col("rel"))).join(bytes_at, "at").where("at_md5 = md5").select("rel", "at")
    both = gone.join(by_line, "rel", "left").join(there, "rel", "left").where("line is not null or at is not null")
    return both.select("rel", F.coalesce("line", "at").alias("final"), F.col("line").isNotNull().alias("recorded"))
