"""Trees and ledgers on disk: damaged files, lazy scans, streams, snapshots."""

import hashlib
import io
import json
import os
import random
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import collect
from ledgerleaf.operators import compact
from ledgerleaf.operators import ledger as log
from ledgerleaf.sources import doctree, ledger_file, readers
from ledgerleaf.streaming import passes


def archive(name, body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, body)
    return out.getvalue()


def damaged(data, rng):
    """Truncated, and with bits flipped."""
    yield data[: len(data) // 2]
    for _ in range(12):
        b = bytearray(data)
        for _ in range(rng.randint(1, 8)):
            b[rng.randrange(len(b))] ^= 1 << rng.randrange(8)
        yield bytes(b)


# ---------------------------------------------------------------- damaged files


def test_damaged_files_of_every_kind(spark, tmp_path):
    rng = random.Random(1)
    body = "<w>" + " ".join("mot%d" % rng.randint(0, 10**6) for _ in range(2000)) + "</w>"
    kinds = {".docx": archive("word/document.xml", body), ".odt": archive("content.xml", body), ".xlsx": archive("xl/sharedStrings.xml", body), ".pdf": b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\ntrailer<</Root 1 0 R>>", ".rtf": rb"{\rtf1 caf\'e9 {\b x}}"}
    n = 0
    for ext, data in kinds.items():
        for k, bad in enumerate([b"", *damaged(data, rng)]):
            (tmp_path / f"{k}{ext}").write_bytes(bad)
            n += 1
    (tmp_path / "fine.docx").write_bytes(kinds[".docx"])
    (tmp_path / "none.docx").write_bytes(archive("other.xml", "x"))
    rows = {r.rel: r for r in doctree.scan(spark, [str(tmp_path)]).collect()}
    assert len(rows) == n + 2 and {r.kind for r in rows.values()} == {"file"}
    assert rows["fine.docx"].text.startswith("mot") and rows["fine.docx"].why is None
    assert rows["none.docx"].why == "no part that holds text"
    assert all((r.text is None) == (r.why is not None) for r in rows.values())
    assert all(rows[f"{k}.docx"].text is None for k in (0, 1))
    assert any("rror" in (r.why or "") for r in rows.values())  # what a parser raised is named
    assert all(r.md5 == hashlib.md5((tmp_path / r.rel).read_bytes()).hexdigest() for r in rows.values())


def test_rich_text_is_read_as_utf8_and_to_its_limit(monkeypatch):
    seen = []
    import sys
    import types

    fake = types.ModuleType("striprtf.striprtf")
    fake.rtf_to_text = lambda s: seen.append(s) or s
    monkeypatch.setitem(sys.modules, "striprtf", types.ModuleType("striprtf"))
    monkeypatch.setitem(sys.modules, "striprtf.striprtf", fake)
    assert readers.read("déjà  vu".encode() + b"\xff", ".rtf") == "déjà vu�"
    readers.read(b"x" * 300_000, ".rtf")
    assert len(seen[-1]) == 200_000
    fake.rtf_to_text = lambda s: 1 / 0
    assert readers.probe(b"x", ".rtf") == (None, "ZeroDivisionError: division by zero")


def test_archive_members_are_bounded(monkeypatch):
    monkeypatch.setattr(readers, "MEMBER_BYTES", 1000)
    assert readers.probe(archive("word/document.xml", "<a>" + "b " * 499), ".docx") == (None, "word/document.xml has more than 1000 bytes")
    assert readers.read(archive("word/document.xml", "<a>" + "b " * 400), ".docx") == "b " * 399 + "b"


# ---------------------------------------------------------------- audit walk


def audit_by_hand(root, patterns):
    """rel, size as an audit walks: links to files followed, hidden names out, patterns compared in normal form."""
    from fnmatch import fnmatchcase

    def norm(s):
        s = unicodedata.normalize("NFD", unicodedata.normalize("NFC", s).casefold())
        return " ".join("".join(c for c in s if not unicodedata.combining(c)).split())

    out = lambda rel: any(fnmatchcase(norm(x), norm(p)) for x in (rel, os.path.basename(rel)) for p in patterns)
    found = {}
    for at, folders, names in os.walk(root):
        folders[:] = [d for d in folders if not d.startswith(".") and not out(os.path.relpath(os.path.join(at, d), root))]
        for name in names:
            path = os.path.join(at, name)
            rel = os.path.relpath(path, root)
            if not name.startswith(".") and not out(rel) and os.path.exists(path):
                found[unicodedata.normalize("NFC", rel)] = os.stat(path).st_size
    return found


@pytest.mark.parametrize("patterns", [["ete/*"], ["Été"], ["*.ZIP", "perso"], []])
def test_audit_walk_by_hand(spark, tmp_path, patterns):
    for rel in ("Été/a.txt", "Été/deep/b.txt", "ete.txt", "Perso/rib.txt", "x/archive.zip", "x/.hidden", ".dot/y.txt", unicodedata.normalize("NFD", "x/août.txt")):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("texte " * len(rel))
    os.symlink(tmp_path / "ete.txt", tmp_path / "x/live.txt")
    os.symlink(tmp_path / "gone", tmp_path / "x/dead.txt")
    os.symlink(tmp_path / "Perso", tmp_path / "x/folder-link")
    found = doctree.scan(spark, [str(tmp_path)], audit=True, exclude="|".join(patterns)).where("kind = 'file'").collect()
    assert {r.rel: r.size for r in found} == audit_by_hand(str(tmp_path), patterns)
    for r in found:
        if r.rel == "x/live.txt":  # a candidate, with the text it leads to
            assert r.text.startswith("texte") and r.link_to.endswith("ete.txt")


# ---------------------------------------------------------------- lazy scan


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    for k in range(40):
        p = root / f"d{k % 4}" / f"{k}.txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"text {k % 30}")
        os.utime(p, (1000 + k, 1000 + k))
    os.symlink(root / "d0/0.txt", root / "d1/link.txt")
    return root


def in_process(root, only, monkeypatch, **options):
    """(rows, opened files, listed folders) of the reader under some filters, without Spark."""
    reader = doctree.TreeReader(doctree._options([str(root)], only, options))
    opened, listed = [], []
    real_open, real_list = open, os.listdir
    monkeypatch.setattr("builtins.open", lambda p, *a, **k: opened.append(str(p)) or real_open(p, *a, **k))
    monkeypatch.setattr(os, "listdir", lambda p: listed.append(str(p)) or real_list(p))
    rows = [dict(zip((c.split()[0] for c in doctree.SCHEMA.split(", ")), r)) for part in reader.partitions() for r in reader.read(part)]
    monkeypatch.undo()
    return rows, {p for p in opened if p.endswith(".txt")}, set(listed)


def test_filters_keep_files_closed_and_folders_unlisted(spark, tree, monkeypatch):
    from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

    rows, opened, listed = in_process(tree, [StringStartsWith(("rel",), "d2/"), GreaterThan(("mtime",), 1020)], monkeypatch)
    assert {r["rel"] for r in rows} == {f"d2/{k}.txt" for k in range(40) if k % 4 == 2 and 1000 + k > 1020}
    assert len(opened) == len(rows) and listed == {str(tree), str(tree / "d2")}
    rows, opened, listed = in_process(tree, [In(("rel",), ("d1/1.txt", "d3/3.txt", None))], monkeypatch)
    assert {r["rel"] for r in rows} == {"d1/1.txt", "d3/3.txt"} and len(opened) == 2 and len(listed) == 3
    rows, opened, _ = in_process(tree, [Not(EqualTo(("ext",), ".txt"))], monkeypatch)
    assert rows == [] and not opened
    rows, opened, _ = in_process(tree, [], monkeypatch, content="false", md5="false")
    assert len(rows) == 41 and not opened
    with pytest.raises(ValueError):
        doctree.scan(spark, [str(tree)], [EqualTo(("text",), "x")])
    plain = doctree.scan(spark, [str(tree)]).collect()
    whole = spark.createDataFrame(plain, doctree.SCHEMA)
    cases = {
        "rel like 'd2/%' and size > 6": [StringStartsWith(("rel",), "d2/"), GreaterThan(("size",), 6)],
        "ext in ('.txt', '.md') and mtime <= 1010": [In(("ext",), (".txt", ".md")), LessThanOrEqual(("mtime",), 1010)],
        "link_to is not null": [IsNotNull(("link_to",))],
        "kind <=> 'file' and not rel = 'd0/0.txt'": [EqualNullSafe(("kind",), "file"), Not(EqualTo(("rel",), "d0/0.txt"))],
        "rel like '%9.txt' and path like '%d1%'": [StringEndsWith(("rel",), "9.txt"), StringContains(("path",), "d1")],
        "not link_to like '%a'": [Not(StringEndsWith(("link_to",), "a"))],
    }
    for cond, only in cases.items():
        want = {tuple(r) for r in whole.where(cond).collect()}
        found = doctree.scan(spark, [str(tree)], only)
        assert {tuple(r) for r in found.collect()} == want and want, cond
        # Used again under other filters, a scan still has all of its rows.
        assert found.where("size < 7").count() + found.where("size >= 7").count() == len(want) == found.count()


def test_only_drifted_files_are_opened(spark, tree):
    recorded, ledger = [], []
    for k in range(36):  # the last four are new
        body = f"text {k % 30}"
        md5, size, mtime, decision = hashlib.md5(body.encode()).hexdigest(), len(body), 1000 + k, "none"
        if k in (3, 5):
            mtime += 1  # touched: same bytes
        if k in (7, 9, 11):
            md5, mtime = "other", mtime - 1  # changed
        if k in (13, 15):
            decision = "unanswered"
        ledger.append((f"d{k % 4}/{k}.txt", decision, size, mtime, md5, k))
    ledger = spark.createDataFrame(ledger, "path string, decision string, size long, mtime long, md5 string, seq long")
    listed = doctree.listing(spark, [str(tree)]).where("kind = 'file'").withColumn("inbox", F.when(F.col("rel").startswith("d2/"), "d2"))
    count = spark.sparkContext.accumulator(0)
    lazy = collect.lazy_bands(listed, ledger, lambda df: doctree.digested(df, count))
    got = {r.rel: r.band for r in lazy.collect()}
    assert count.value == 5  # touched and changed ones
    eager = collect.bands(doctree.scan(spark, [str(tree)]).where("kind = 'file'").withColumn("inbox", F.when(F.col("rel").startswith("d2/"), "d2")), ledger)
    assert got == {r.rel: r.band for r in eager.collect()}
    chosen = collect.batch(lazy.where("band is not null"), 3)
    assert [r.rel for r in chosen.collect()] == ["d1/13.txt", "d3/15.txt", "d2/38.txt"]
    count = spark.sparkContext.accumulator(0)
    texts = {r.rel: r.text for r in doctree.opened(chosen, counter=count).collect()}
    assert texts["d2/38.txt"] == "text 8" and count.value == 3
    one = listed.where("rel = 'd2/38.txt'")
    count = spark.sparkContext.accumulator(0)
    twins = collect.first_twin(collect.lazy_twins(one, listed, lambda df: doctree.digested(df, count)))
    assert {r.rel: r.twin for r in twins.collect()}["d2/38.txt"] == "d0/8.txt"
    assert count.value == 20  # files of six bytes: 0 to 9 and 30 to 39


# ---------------------------------------------------------------- stream


def test_stream_of_a_folder(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "ledger")
    (root / "a").mkdir(parents=True)
    (root / "a/one.txt").write_text("une facture")
    cfg = {"root": str(root), "rules": [{"id": "f", "status": "active", "when": {"text_contains_any": ["facture"]}, "destination": "F"}]}

    def run():
        q = passes.from_folder(spark, [str(root)], cfg, out, str(tmp_path / "cp"), "2025-01-01", 2025, settled=0)
        q.awaitTermination()

    run()
    first = ledger_file.load(spark, out).collect()
    assert [(r.path, r.triage) for r in first] == [("a/one.txt", "route")] and first[0].mtime == int(os.stat(root / "a/one.txt").st_mtime)
    run()  # restarted, nothing has changed
    assert ledger_file.load(spark, out).count() == 1
    (root / "two.txt").write_text("rien")
    os.utime(root / "two.txt", (5, 5))  # an old date does not hide a new file
    run()
    ledger_file.snapshot(spark, out)
    (root / "a/one.txt").write_text("une autre facture")
    run()
    run()
    assert sorted(r.path for r in ledger_file.load(spark, out).collect()) == ["a/one.txt", "a/one.txt", "two.txt"]
    assert {r.path: r.size for r in log.latest(ledger_file.current(spark, out)).collect()} == {"a/one.txt": 17, "two.txt": 4}


def test_changes_lie_in_one_batch_each(tmp_path):
    stream = doctree.TreeStream({"paths": str(tmp_path), "content": "false", "settled": "0"})
    offsets, seen = [stream.initialOffset()], []
    for k in range(4):
        for j in range(3):
            (tmp_path / f"{k}-{j}.txt").write_text("x")
        offsets.append({"time": max(os.lstat(p).st_ctime_ns for p in tmp_path.iterdir())})
    for start, end in [*zip(offsets, offsets[1:]), *zip(offsets, offsets[1:])]:  # and again
        seen.append({r[3] for part in stream.partitions(start, end) for r in stream.read(part)})
    assert sum(map(len, seen[:4])) == 12 and set().union(*seen[:4]) == {f"{k}-{j}.txt" for k in range(4) for j in range(3)}
    assert seen[:4] == seen[4:]
    assert not [r for part in doctree.TreeStream({"paths": str(tmp_path / "away")}).partitions({"time": 0}, {"time": 1}) for r in stream.read(part)]


# ---------------------------------------------------------------- snapshot


def lines(spark, rng, n, at):
    rows = [(rng.choice(("file", "file", None, "dir")), "p%d" % rng.randint(0, 30), rng.choice((None, "m%d" % rng.randint(0, 12))), rng.choice(("none", "move", "unanswered")), at * 1000 + k) for k in range(n)]
    return spark.createDataFrame(rows, "type string, path string, md5 string, decision string, seq long")


VIEWS = {"latest": log.latest, "by_content": log.by_content, "paths_by_content": log.paths_by_content, "folders": lambda df: log._last(df.where("type = 'dir'"), ["path"])}


def views(df):
    return {k: sorted((str((r.type, r.path, r.md5, r.decision, r.seq)) for r in v(df).collect())) for k, v in VIEWS.items()}


def test_snapshot_and_later_batches(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "ledger")
    for k in range(3):
        ledger_file.append(lines(spark, rng, 150, k).repartition(3), path)
    assert ledger_file.snapshot(spark, path) == 3
    for k in range(3, 5):
        ledger_file.append(lines(spark, rng, 20, k), path)
    whole, merged = ledger_file.load(spark, path), ledger_file.current(spark, path)
    assert views(whole) == views(merged)
    read = [f for f in merged.inputFiles() if "/batch-" in f]
    assert read and all("batch-000000000004" in f or "batch-000000000005" in f for f in read)  # 40 lines of 490
    kept = spark.read.parquet(str(tmp_path / "ledger/_snapshots/live-000000000003")).count()
    assert kept < 450 and merged.count() == kept + 40
    assert ledger_file.snapshot(spark, path) == 5 and views(ledger_file.current(spark, path)) == views(whole)
    assert not [f for f in ledger_file.current(spark, path).inputFiles() if "/batch-" in f]
    # A foreign file, older than all batches, that came after the snapshot, is seen.
    (tmp_path / "ledger/old.jsonl").write_text(json.dumps({"path": "foreign", "md5": "f", "decision": "none"}) + "\n" + json.dumps({"path": "p1", "md5": "m1", "decision": "older"}) + "\n")
    whole = ledger_file.load(spark, path)
    assert "foreign" in {r.path for r in log.latest(ledger_file.current(spark, path)).collect()}
    assert views(ledger_file.current(spark, path)) == views(whole)
    ledger_file.snapshot(spark, path)
    assert views(ledger_file.current(spark, path)) == views(whole) and not [f for f in ledger_file.current(spark, path).inputFiles() if "jsonl" in f]
    assert ledger_file.current(spark, str(tmp_path / "ledger")).where("path = 'foreign'").count() == 1


def test_compaction_replaces_the_ledger(spark, tmp_path):
    path, schema = str(tmp_path / "ledger"), "path string, decision string, md5 string, size long, mtime long, seq long"
    ledger_file.append(spark.createDataFrame([("d/a", "none", "1", 1, 1, 0), ("d/b", "none", "2", 1, 1, 1), ("e/c", "move", "3", 1, 1, 2)], schema), path)
    ledger_file.snapshot(spark, path)
    files = spark.createDataFrame([("d/a", 1, 1, "1"), ("d/b", 1, 1, "2"), ("e/c", 1, 1, "3")], "rel string, size long, mtime long, md5 string")
    ledger_file.replace(compact.compacted(files, ledger_file.load(spark, path), "d", "2025-01-01-compact", "done"), path)
    for read in (ledger_file.load, ledger_file.current):
        assert sorted((r.path, r.type or "file") for r in read(spark, path).collect()) == [("d", "dir"), ("e/c", "file")]
    ledger_file.append(spark.createDataFrame([("e/c", "none", "4", 1, 1, 0)], schema), path)
    ledger_file.snapshot(spark, path)
    for read in (ledger_file.load, ledger_file.current):
        assert {r.path: r.decision for r in log.latest(read(spark, path)).collect()} == {"e/c": "none"}
        assert log._last(read(spark, path).where("type = 'dir'"), ["path"]).count() == 1
