"""``repo_tree``: a Python Data Source listing folder trees of projects.

Spark's file sources skip names starting with ``_`` or ``.`` (``__init__.py``,
``.hidden.py``), which a code inventory must see, so the tree is listed by
the reader itself.

    spark.dataSource.register(RepoTreeDataSource)
    files = (spark.read.format("repo_tree").option("path", base)
             .option("content", "true").load())

Rows: ``project, path, name, size_bytes, modified_at, content, error``;
``path`` is relative to the project folder.  Partitioning: the driver lists
only the base folder and each project's top level; a partition is a chunk
of top-level entries of one project (``entries_per_partition``), so a huge
project spreads over many tasks.  Executors walk their entries and read
files; nothing file-level passes through the driver.

Excluded folders (P1) are pruned below depth 1 when ``prune`` is true (the
default): their direct files are still listed because the project test
(P2) looks at depth-2 sources anywhere.  Unreadable files yield a row with
``error`` set instead of failing the task.  Modification times are UTC
wall-clock (naive).
"""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMA = ("project string, path string, name string, size_bytes long, modified_at timestamp_ntz, "
          "content string, error string")


BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


class _Chunk(InputPartition):
    def __init__(self, project: str, entries: list[str]):
        super().__init__((project, entries))
        self.project = project
        self.entries = entries


class RepoTreeDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return RepoTreeReader(self.options)


def _excluded(name: str, patterns: list[str]) -> bool:
    from fnmatch import fnmatchcase

    return any(fnmatchcase(name, p) for p in patterns) or name.startswith(".")


def file_row(project: str, root: str, rel: str, content: bool) -> tuple:
    """The row of one file; one that can't be read has an error instead."""
    full, name = os.path.join(root, rel), os.path.basename(rel)
    try:
        st = os.stat(full)
        mtime = datetime.fromtimestamp(st.st_mtime, timezone.utc).replace(tzinfo=None)
        text = None
        if content:
            with open(full, "rb") as fh:
                text = fh.read().decode("utf-8", errors="ignore")
        return (project, rel, name, int(st.st_size), mtime, text, None)
    except OSError as e:
        return (project, rel, name, None, None, None, f"{type(e).__name__}: {e}")


def _batches(rows):
    import pyarrow as pa

    schema = pa.schema([("project", pa.string()), ("path", pa.string()), ("name", pa.string()), ("size_bytes", pa.int64()),
                        ("modified_at", pa.timestamp("us")), ("content", pa.string()), ("error", pa.string())])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[5] or "")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


class RepoTreeReader(DataSourceReader):
    def __init__(self, options):
        from treeline.functions import fixed

        self.base = options["path"]
        self.content = str(options.get("content", "false")).lower() == "true"
        self.prune = str(options.get("prune", "true")).lower() == "true"
        self.per_part = int(options.get("entries_per_partition", "64"))
        pats = options.get("exclude")
        self.patterns = pats.split(",") if pats else list(fixed.EXCLUDE_DIRS)
        self.projects = json.loads(options["projects"]) if options.get("projects") else None

    def pushFilters(self, filters):
        """``project = x`` and ``project IN (...)`` choose the folders that are listed at all."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("project",):
                wanted = [f.value]
            elif isinstance(f, In) and f.attribute == ("project",):
                wanted = list(f.value)
            else:
                yield f
                continue
            wanted = {x for x in wanted if x is not None}
            self.projects = sorted(wanted if self.projects is None else wanted & set(self.projects))

    def partitions(self):
        parts = []
        try:
            names = os.listdir(self.base) if self.projects is None else self.projects
            projects = sorted(e for e in names if os.path.isdir(os.path.join(self.base, e)))
        except OSError:
            return [_Chunk("", [])]
        for p in projects:
            try:
                entries = sorted(os.listdir(os.path.join(self.base, p)))
            except OSError:
                entries = []
            if not entries:
                continue
            for i in range(0, len(entries), self.per_part):
                parts.append(_Chunk(p, entries[i:i + self.per_part]))
        return parts or [_Chunk("", [])]

    def _row(self, project: str, root: str, rel: str):
        return file_row(project, root, rel, self.content)

    def read(self, partition):
        """Arrow batches of at most BATCH_ROWS rows or about BATCH_BYTES of text."""
        yield from _batches(self._rows(partition))

    def _rows(self, partition):
        project, entries = partition.project, partition.entries
        if not project:
            return
        root = os.path.join(self.base, project)
        for entry in entries:
            full = os.path.join(root, entry)
            if not os.path.isdir(full) or os.path.islink(full):
                if os.path.isfile(full):
                    yield self._row(project, root, entry)
                continue
            top_excluded = self.prune and _excluded(entry, self.patterns)
            for cur, dirs, files in os.walk(full):
                rel_dir = os.path.relpath(cur, root)
                if top_excluded:
                    dirs[:] = []
                elif self.prune:
                    dirs[:] = [d for d in dirs if not _excluded(d, self.patterns)]
                dirs.sort()
                for f in sorted(files):
                    yield self._row(project, root, os.path.join(rel_dir, f).replace(os.sep, "/"))


def register(spark) -> None:
    spark.dataSource.register(RepoTreeDataSource)


def _list_folders(base: str, prune: bool, patterns: list[str]):
    """mapInArrow body: what lies in each folder (project, path).  Files are
    rows as the reader's, subfolders to go on with have ``folder`` true."""
    import pyarrow as pa

    def rows(project: str, path: str):
        root = os.path.join(base, project)
        full = os.path.join(root, path) if path else root
        try:
            entries = sorted(os.scandir(full), key=lambda e: e.name)
        except OSError as e:
            yield (project, path, os.path.basename(path), None, None, None, f"{type(e).__name__}: {e}", False)
            return
        closed = prune and "/" not in path and path and _excluded(path, patterns)  # of a pruned top folder, its own files
        for e in entries:
            rel = f"{path}/{e.name}" if path else e.name
            if not project:
                if e.is_dir():
                    yield (e.name, "", "", None, None, None, None, True)
            elif e.is_dir(follow_symlinks=False):
                if not closed and not (prune and path and _excluded(e.name, patterns)):
                    yield (project, rel, e.name, None, None, None, None, True)
            elif not e.is_dir() and (path or e.is_file()):
                yield (*file_row(project, root, rel, False), False)

    def run(batches):
        for b in batches:
            for project, path in zip(b["project"].to_pylist(), b["path"].to_pylist()):
                held = list(rows(project, path))
                for k in range(0, len(held), BATCH_ROWS):
                    part = held[k:k + BATCH_ROWS]
                    base_batch = next(iter(_batches(r[:7] for r in part)))
                    yield base_batch.append_column("folder", pa.array([r[7] for r in part]))
    return run


#: Folders that one task lists, bytes of files that one task reads.
FOLDERS_PER_TASK, BYTES_PER_TASK = 32, 128 << 20


def list_tree(spark: SparkSession, base: str, prune: bool = True) -> DataFrame:
    """The reader's rows without content, as jobs: one for each level of the
    tree, in which the folders found by the level above are dealt out by
    their names.  Nothing that grows with the tree passes the driver, and a
    project's folders lie in as many tasks as they need."""
    from treeline.functions import fixed
    from treeline.session import materialize

    schema = SCHEMA + ", folder boolean"
    body, out = _list_folders(base, prune, list(fixed.EXCLUDE_DIRS)), None
    folders = spark.createDataFrame([("", "")], "project string, path string")
    while True:
        level = materialize(folders.mapInArrow(body, schema), "stage")
        files = level.where("not folder").drop("folder", "content")
        out = files if out is None else out.unionByName(files)
        folders = level.where("folder").select("project", "path")
        n = folders.count()
        if not n:
            return out
        folders = folders.repartition(n // FOLDERS_PER_TASK + 1, "project", "path")


def read_contents(listing: DataFrame, base: str, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """The listed files (project, path, size_bytes) with their content, and no
    others: rows as the reader's.  As many tasks as the files' bytes ask for."""
    files = listing.where("error is null").select("project", "path", "size_bytes")
    total = files.agg(F.sum("size_bytes")).first()[0] or 0

    def run(batches):
        yield from _batches(file_row(p, os.path.join(base, p), rel, True) for b in batches for p, rel in zip(b["project"].to_pylist(), b["path"].to_pylist()))
    return files.repartition(int(total // bytes_per_task) + 1, "project", "path").mapInArrow(run, SCHEMA)


def read_tree(spark, base: str, content: bool = True, prune: bool = True, projects: list[str] | None = None):
    """Convenience: register the source and read ``base``, or only the named projects below it.
    Filters on ``project`` reach the source too."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = (spark.read.format("repo_tree").option("path", base).option("content", str(content).lower())
         .option("prune", str(prune).lower()))
    if projects is not None:
        r = r.option("projects", json.dumps(list(projects)))
    return r.load()
