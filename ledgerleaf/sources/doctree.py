"""A Spark data source over folder trees, dealt by parts of about equal numbers of entries.

Unlike Spark's binary file reader it keeps dot files, empty files and links (as links, never followed), and reports
what it was refused: rows of kind ``ignored`` carry the path and the reason; a file that could not be read is a row
with a null text and the reason.

Filters on what a listing knows (path, extension, size, time) belong to a scan (``only``): a file that they leave out is
not opened, a folder that no wanted path lies in is not listed. They are the filters of ``pyspark.sql.datasource``, but
not pushed down by Spark, which keeps what it pushed into such a source with the loaded table: a DataFrame of a scan
that is used twice then has the other use's filters (seen with 4.1.2). A pass that only wants what changed lists the
tree without content, joins the ledger and hands the rest to ``digested`` and ``opened``; or it reads the tree as a
stream.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import operator
import os
import stat as st
import time
import unicodedata
import uuid
from collections import deque
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from ledgerleaf.functions.text import norm_python

from . import readers

SCHEMA = "kind string, root string, path string, rel string, size long, mtime long, ext string, md5 string, text string, link_to string, why string"
#: Columns that are known before a file is opened.
LISTED = ("kind", "root", "path", "rel", "size", "mtime", "ext", "link_to")
# Bytes past which no digest is made, the block it is made in.
HASHED, BLOCK = 1 << 30, 1 << 20


#: Parts that a tree is dealt into, when it has as many entries; folders are opened for it on the driver, names only.
PARTS = 256
#: Seconds a file must have been left alone before the stream takes it, for clocks that differ and writes in progress.
SETTLED = 2.0


class Part(InputPartition):
    """Paths below a root, each visited with what lies below it; in a stream, what changed after ``since`` up to
    ``until`` (nanoseconds)."""

    def __init__(self, entries: list[tuple[str, str]], since: int | None = None, until: int | None = None):
        self.entries, self.since, self.until = entries, since, until


def digest(path: str, size: int) -> str | None:
    if size > HASHED:
        return None
    h = hashlib.md5()
    try:
        with open(path, "rb") as f:
            while block := f.read(BLOCK):
                h.update(block)
    except OSError:
        return None
    return h.hexdigest()


def content(path: str, ext: str, mode: str, pdf: bool = True) -> tuple[str | None, str | None]:
    """(text, None) or (None, why it could not be read)."""
    try:
        with open(path, "rb") as f:
            return readers.probe(f, ext, mode, pdf)
    except OSError as e:
        return None, e.strerror or str(e)


def extension(name: str) -> str:
    return os.path.splitext(name)[1].lower() or "?"


_COMPARED: dict[type, Callable] = {
    GreaterThan: operator.gt,
    GreaterThanOrEqual: operator.ge,
    LessThan: operator.lt,
    LessThanOrEqual: operator.le,
    EqualTo: operator.eq,
    StringStartsWith: str.startswith,
    StringEndsWith: str.endswith,
    StringContains: operator.contains,
    In: lambda have, wanted: have in wanted,
}


def _supported(f: Filter) -> bool:
    if isinstance(f, Not):
        return _supported(f.child)
    return isinstance(f, (*_COMPARED, EqualNullSafe, IsNull, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in LISTED


def _written(f: Filter) -> dict:
    if not _supported(f):
        raise ValueError(f"not a filter on what a listing knows: {f}")
    if isinstance(f, Not):
        return {"type": "Not", "child": _written(f.child)}
    return {"type": type(f).__name__, "at": f.attribute[0], **({"value": f.value} if hasattr(f, "value") else {})}


def _read(said: dict) -> Filter:
    kinds = {k.__name__: k for k in (*_COMPARED, EqualNullSafe)}
    if said["type"] == "Not":
        return Not(_read(said["child"]))
    if said["type"] in kinds:
        return kinds[said["type"]]((said["at"],), said["value"])
    return {"IsNull": IsNull, "IsNotNull": IsNotNull}[said["type"]]((said["at"],))


def _holds(f: Filter, row: dict) -> bool | None:
    """A filter's value for what is known of a file; null as in SQL."""
    if isinstance(f, Not):
        found = _holds(f.child, row)
        return None if found is None else not found
    have = row[f.attribute[0]]
    if isinstance(f, (IsNull, IsNotNull)):
        return (have is None) == isinstance(f, IsNull)
    if isinstance(f, EqualNullSafe):
        return have == f.value
    if have is None or f.value is None:
        return None
    return _COMPARED[type(f)](have, f.value)


class Tree:
    """What a walk takes, by its options."""

    def __init__(self, options: dict):
        self.roots = [r for r in (options.get("paths") or options.get("path") or "").split(os.pathsep) if r]
        self.guarded = [unicodedata.normalize("NFC", g).rstrip("/") for g in (options.get("guarded") or "").split(os.pathsep) if g]
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.content, self.md5, self.audit = flag("content", "true"), flag("md5", "true"), flag("audit", "false")
        self.pdf = flag("pdf", "true")
        self.exclude = [norm_python(g) if self.audit else g for g in (options.get("exclude") or "").split("|") if g]
        self.filters = [_read(x) for x in json.loads(options.get("only") or "[]")]

    def parts(self, since: int | None = None, until: int | None = None) -> list[Part]:
        """Folders are opened, those nearest to a root first, until there are enough entries to deal."""
        open_, entries = deque((root, root) for root in self.roots), []
        while open_ and len(open_) + len(entries) < PARTS:
            root, path = open_.popleft()
            below = self.listed(root, path)
            if below is None:
                entries.append((root, path))
            else:
                open_ += [(root, os.path.join(path, n)) for n in below]
        entries += open_
        return [Part(entries[i::PARTS], since, until) for i in range(min(PARTS, len(entries)))] or [Part([], since, until)]

    def listed(self, root: str, path: str) -> list[str] | None:
        """Names in a folder that is walked through; null where a visit has something to say of the path itself."""
        name, rel = os.path.basename(path), self.relative(root, path)
        if os.path.islink(path) and path != root or not os.path.isdir(path) or self.is_guarded(path) or path != root and (self.skipped(rel, name, True) or self.barren(root, path, rel)):
            return None
        try:
            return sorted(os.listdir(path))
        except OSError:
            return None

    @staticmethod
    def relative(root: str, path: str) -> str:
        return unicodedata.normalize("NFC", os.path.relpath(path, root))

    def is_guarded(self, path: str) -> bool:
        full = unicodedata.normalize("NFC", path)
        return any(full == g or full.startswith(g + "/") for g in self.guarded)

    def skipped(self, rel: str, name: str, folder: bool) -> bool:
        if self.audit:
            tried = (norm_python(rel), norm_python(name))
            return name.startswith(".") or any(fnmatch.fnmatchcase(x, g) for x in tried for g in self.exclude)
        if name == ".DS_Store" and not folder:
            return True
        return any(fnmatch.fnmatchcase("/" + rel, g if g.startswith(("/", "*")) else "*/" + g) for g in self.exclude)

    def barren(self, root: str, path: str, rel: str) -> bool:
        """Whether filters on ``rel`` or ``path`` rule out everything below a folder."""
        here = {"rel": ("" if rel == "." else rel) + "/", "path": path.rstrip("/") + "/"}
        for f in self.filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute[0] in here:
                at = here[f.attribute[0]].removeprefix("/")
                wanted = [w.removeprefix("/") for w in (f.value if isinstance(f, In) else [f.value]) if w is not None]
                if not any(w.startswith(at) or isinstance(f, StringStartsWith) and at.startswith(w) for w in wanted):
                    return True
        return False

    def visit(self, root: str, path: str, wanted: Callable[[os.stat_result], bool] = lambda info: True) -> Iterator[tuple]:
        rel = self.relative(root, path)
        blank = dict.fromkeys(("size", "mtime", "ext", "md5", "text", "link_to", "why"))

        def rows(kind: str, **known) -> Iterator[tuple]:
            made = {"kind": kind, "root": root, "path": path, "rel": rel, **blank, **known}
            if not all(_holds(f, made) for f in self.filters):
                return
            if kind == "file" and (self.audit or not made["link_to"]):
                if self.content:
                    made["text"], made["why"] = content(path, made["ext"], "audit" if self.audit else "collect", self.pdf)
                if self.md5:
                    made["md5"] = digest(path, made["size"])
            yield tuple(made.values())

        if self.is_guarded(path):
            return
        try:
            info = os.lstat(path)
        except OSError as e:
            yield from rows("ignored", why=e.strerror or str(e))
            return
        name, folder = os.path.basename(path), st.S_ISDIR(info.st_mode)
        if path != root and self.skipped(rel, name, folder):
            return
        if folder:
            if path != root and self.barren(root, path, rel):
                return
            try:
                names = sorted(os.listdir(path))
            except OSError as e:
                if wanted(info):
                    yield from rows("ignored", why=e.strerror or str(e))
                return
            for n in names:
                yield from self.visit(root, os.path.join(path, n), wanted)
            return
        if not wanted(info):
            return
        link = st.S_ISLNK(info.st_mode)
        if link:
            # A link stands for the file it leads to, whose size and time it has.
            try:
                info = os.stat(path)
            except OSError:
                yield from rows("ignored", why="dangling symlink")
                return
        if st.S_ISREG(info.st_mode) or link and not self.audit:
            known = {"size": info.st_size, "mtime": int(info.st_mtime), "ext": extension(name)}
            yield from rows("file", **known, link_to=os.path.realpath(path) if link else None)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.tree = Tree(options)

    def partitions(self):
        return self.tree.parts()

    def read(self, part: Part) -> Iterator[tuple]:
        for root, path in part.entries:
            yield from self.tree.visit(root, path)


class TreeStream(DataSourceStreamReader):
    """The tree as a stream: a batch is what changed between two points of time.

    An offset is a time, so no file is looked at to find it; a file's change is that of its inode (a copy that keeps
    its old date counts as new), and each change lies in exactly one batch, however often the query is restarted.
    Files of a folder that was renamed have not changed themselves: a scan finds them, a stream does not.
    """

    def __init__(self, options: dict):
        self.tree = Tree(options)
        self.settled = int(float(options.get("settled", SETTLED)) * 1e9)
        self.first = int(float(options.get("since", 0)) * 1e9)

    def initialOffset(self) -> dict:
        return {"time": self.first}

    def latestOffset(self) -> dict:
        return {"time": max(self.first, time.time_ns() - self.settled)}

    def partitions(self, start: dict, end: dict):
        return self.tree.parts(start["time"], end["time"])

    def read(self, part: Part) -> Iterator[tuple]:
        changed = lambda info: part.since < info.st_ctime_ns <= part.until
        for root, path in part.entries:
            if path != root or os.path.lexists(path):  # a root that is away may come back
                yield from self.tree.visit(root, path, changed)

    def commit(self, end: dict) -> None:
        """Nothing to let go: the tree itself is the source."""


class DocTree(DataSource):
    """Options: path or paths, exclude (patterns by |), guarded, content, md5, pdf, audit, only (filters as JSON); of a
    stream also settled (seconds) and since (seconds since 1970)."""

    @classmethod
    def name(cls) -> str:
        return "doctree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocTree)


def _options(roots: list[str], only: Sequence[Filter], options: dict) -> dict[str, str]:
    return {"paths": os.pathsep.join(roots), "only": json.dumps([_written(f) for f in only]), **{k: str(v) for k, v in options.items()}}


def scan(spark: SparkSession, roots: list[str], only: Sequence[Filter] = (), **options) -> DataFrame:
    """The files below ``roots`` for which all of ``only`` hold; roots that lie in others should be folded first
    (plans.config.walk_roots)."""
    register(spark)
    return spark.read.format("doctree").options(**_options(roots, only, options)).load()


def listing(spark: SparkSession, roots: list[str], only: Sequence[Filter] = (), **options) -> DataFrame:
    """Names, sizes and times below ``roots``: no file is opened."""
    return scan(spark, roots, only, **{**options, "content": False, "md5": False})


def stream(spark: SparkSession, roots: list[str], only: Sequence[Filter] = (), **options) -> DataFrame:
    """The files below ``roots`` as they change."""
    register(spark)
    return spark.readStream.format("doctree").options(**_options(roots, only, options)).load()


def _with_files(files: DataFrame, names: tuple[str, ...], make: Callable, counter) -> DataFrame:
    """``files`` (path, size, ext) with the columns ``names``, which ``make`` gets from each file; null for links.
    ``counter`` is an accumulator of opened files."""
    kept = files.drop(*names)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("path", "size", "ext")]
            links = b.column(b.schema.get_field_index("link_to")).to_pylist() if "link_to" in b.schema.names else [None] * b.num_rows
            made = []
            for link, *row in zip(links, *columns, strict=True):
                if counter is not None and link is None:
                    counter.add(1)
                made.append(make(*row) if link is None else (None,) * len(names))
            added = [pa.array([m[k] for m in made], pa.string()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *names])

    return kept.mapInArrow(run, T.StructType([*kept.schema, *(T.StructField(c, T.StringType()) for c in names)]))


def digested(files: DataFrame, counter=None) -> DataFrame:
    """``files`` (path, size, ext, link_to) with md5, by reading each; links have none."""
    return _with_files(files, ("md5",), lambda path, size, ext: (digest(path, size),), counter)


def opened(files: DataFrame, mode: str = "collect", pdf: bool = True, counter=None) -> DataFrame:
    """``files`` (path, size, ext, link_to) with text and why, by reading each; links have none."""
    return _with_files(files, ("text", "why"), lambda path, size, ext: content(path, ext, mode, pdf), counter)


def local_folder(path: str) -> str:
    """The path of a folder that the driver and all executors have mounted; only such a folder has files to open."""
    scheme, mark, rest = path.partition(":")
    if mark and scheme != "file":
        raise ValueError(f"{path} is not a mounted folder")
    return os.path.normpath(rest) if mark else path


def written(files: DataFrame, root: str) -> int:
    """Write ``files`` (rel, body, mtime) below a mounted folder, each whole or not at all; how many there were. A task
    that runs again writes the same files again."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for rel, body, mtime in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                path = os.path.join(root, rel)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                pending = f"{path}.{uuid.uuid4().hex}"
                with open(pending, "wb") as f:
                    f.write(body)
                os.utime(pending, (mtime, mtime))
                os.replace(pending, path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    made = files.select("rel", "body", "mtime").mapInArrow(run, "n long")
    return made.selectExpr("coalesce(sum(n), 0)").first()[0]
