"""Source trees as a Spark data source: paths are tested before any text is read.

`spark.read.format("source_tree").load(root)` reads the files below a mounted folder whose direct
children are repositories: `repo`, `path`, `abs_path`, `content`. Tests of `path` and `repo` in a
`where` go to the source and decide on names; a schema without `content` opens no file. Options:

* `selector`: only files that this pack's selector takes;
* `skip`: names of folders that are not entered at any depth (comma list). Version control and
  vendored folders at the top of a repository are never entered, as no selector looks there;
* `bytes_per_task`, `files_per_task`: how much a task reads.

The folders are listed once, in order, and cut where a task has enough bytes or files; a task is
told the first and the last path of its part, not a list, so the plan is small however many files
there are, and a repository of many files is read by many tasks. Small repositories are read
several to a task, so tasks grow with what is read, not with the repositories. A task enters only folders that
reach into its part. With `plan=repos` nothing is listed beforehand and a repository is a task.

Spark's own file readers leave out names that begin with a dot or an underscore, which would lose
`.env`, `.github` or `__init__.py`. Unreadable files are skipped.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, In, InputPartition, Not,
                                    StringContains, StringEndsWith, StringStartsWith)

from ..functions.globs import any_glob
from ..operators.select import ROUTE_SKIP, SELECTORS

SCHEMA = "repo string, path string, abs_path string, content string"
NEVER = (".git", "node_modules")  # at the top of a repository
_BATCH_BYTES = 16 << 20
#: How much whole repositories that are read by one task hold together.
_TOGETHER_BYTES, _TOGETHER_FILES = 4 << 20, 4_000
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def path_test(selector: str):
    """The selector as a test of a path."""
    entries = [(re.compile(any_glob(globs)), re.compile(any_glob(out, dot=True)) if out else None)
               for globs, out in SELECTORS[selector]]

    def takes(path: str) -> bool:
        if selector == "routes" and any(text in path for text in ROUTE_SKIP):
            return False
        if selector == "env" and path.startswith(".env"):
            return False
        return any(globs.search(path) and not (out and out.search(path)) for globs, out in entries)
    return takes


@dataclass
class Part(InputPartition):
    """Files of a repository behind `after`, up to `upto` (paths cut at folders; None: no end),
    or of several whole repositories."""

    repo: str
    after: tuple[str, ...] | None = None
    upto: tuple[str, ...] | None = None
    more: tuple[str, ...] = ()


def _shown(name: str) -> str:
    """A file name as valid text."""
    return name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


class TreeReader(DataSourceReader):
    def __init__(self, schema, options):
        self.root = os.path.abspath(re.sub("^file:(//)?", "", options["path"]))
        self.columns = [f.name for f in schema.fields]
        self.selector = options.get("selector")
        self.skip = {s.strip() for s in options.get("skip", "").split(",")} - {""}
        self.plan = options.get("plan", "bytes")
        self.task_bytes = int(options.get("bytes_per_task", 64 << 20))
        self.task_files = int(options.get("files_per_task", 10_000))
        self.tests: list[tuple] = []  # (column, kind, value, whether it must hold)

    def pushFilters(self, filters):
        """Keep the tests of names; all others are Spark's."""
        kinds = {EqualTo: "=", In: "in", StringStartsWith: "start", StringEndsWith: "end",
                 StringContains: "has"}
        for f in filters:
            inner, holds = (f.child, False) if isinstance(f, Not) else (f, True)
            kind, column = kinds.get(type(inner)), getattr(inner, "attribute", ("",))
            if kind and column in (("path",), ("repo",)):
                self.tests.append((column[0], kind, inner.value, holds))
            else:
                yield f

    def _passes(self, column: str, value: str) -> bool:
        does = {"=": lambda v: value == v, "in": lambda v: value in v, "start": value.startswith,
                "end": value.endswith, "has": lambda v: v in value}
        return all(does[kind](v) == holds for c, kind, v, holds in self.tests if c == column)

    def _repos(self) -> list[str]:
        with os.scandir(self.root) as entries:
            return sorted(e.name for e in entries if e.is_dir(follow_symlinks=False)
                          and self._passes("repo", _shown(e.name)))

    def _files(self, part: Part) -> Iterator[tuple[tuple[str, ...], os.DirEntry]]:
        """The files of a part that pass, in the order of their names; folders that do not reach
        into the part are not listed."""
        takes = path_test(self.selector) if self.selector else lambda path: True

        def walk(folder, above):
            try:
                with os.scandir(folder) as entries:
                    found = sorted(entries, key=lambda e: e.name)
            except OSError:
                return
            for e in found:
                at = (*above, e.name)
                if part.after and at < part.after[:len(at)] or part.upto \
                        and at > part.upto[:len(at)]:
                    continue
                if e.is_dir(follow_symlinks=False):
                    if e.name not in self.skip and not (not above and e.name in NEVER):
                        yield from walk(e.path, at)
                elif not (part.after and at <= part.after):
                    path = _shown("/".join(at))
                    if takes(path) and self._passes("path", path):
                        yield at, e
        for repo in (part.repo, *part.more):
            yield from walk(os.path.join(self.root, repo), ())

    def partitions(self) -> list[Part]:
        most_bytes = min(self.task_bytes, _TOGETHER_BYTES)
        most_files = min(self.task_files, _TOGETHER_FILES)
        out, together, held, held_n = [], [], 0, 0
        for repo in self._repos():
            after, last, size, n = None, None, 0, 0
            if self.plan != "repos":
                for last, entry in self._files(Part(repo)):
                    try:
                        size += entry.stat().st_size if "content" in self.columns else 0
                    except OSError:
                        continue
                    n += 1
                    if size >= self.task_bytes or n >= self.task_files:
                        out.append(Part(repo, after, last))
                        after, size, n = last, 0, 0
            if self.plan == "repos" or n and (after or size > most_bytes or n > most_files):
                out.append(Part(repo, after))
            elif n:
                if together and (held + size > most_bytes or held_n + n > most_files):
                    out.append(Part(together[0], more=tuple(together[1:])))
                    together, held, held_n = [], 0, 0
                together.append(repo)
                held, held_n = held + size, held_n + n
        if together:
            out.append(Part(together[0], more=tuple(together[1:])))
        return out or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in self.columns])
        rows, size = [], 0
        repos = (part.repo, *part.more) if part.repo else ()
        for repo, at, entry in ((r, *f) for r in repos
                                for f in self._files(Part(r, part.after, part.upto))):
            row = {"repo": _shown(repo), "path": _shown("/".join(at)),
                   "abs_path": _shown(entry.path)}
            if "content" in self.columns:
                try:
                    with open(entry.path, encoding="utf-8", errors="replace", newline="") as f:
                        row["content"] = f.read()
                except OSError:
                    continue
                size += len(row["content"])
            rows.append(row)
            if size > _BATCH_BYTES or len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(schema, self.options)


def tree(spark: SparkSession, root: str, content: bool = True, **options) -> DataFrame:
    """Files below `root`; with `content=False` their names only."""
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(TreeSource)
    schema = SCHEMA if content else SCHEMA.rpartition(",")[0]
    return spark.read.format(TreeSource.name()).schema(schema).options(**options).load(root)


def write_tree(files: DataFrame, root: str) -> int:
    """Write files (`repo`, `path`, `content`) below a mounted folder; how many there were.

    A task that is repeated writes the same files again.
    """
    root = re.sub("^file:(//)?", "", root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, path, content in zip(*[batch.column(c) for c in ("repo", "path", "content")]):
                target = os.path.join(root, repo.as_py(), path.as_py())
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "w", encoding="utf-8", newline="") as f:
                    f.write(content.as_py() or "")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    done = files.select("repo", "path", "content").mapInArrow(write, "n long")
    return done.agg(F.sum("n")).first()[0] or 0
