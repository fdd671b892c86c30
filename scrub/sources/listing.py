"""Files looked at by tasks: listing of folders, hashes of whole files, header records.

Paths are rows like any other: a folder's entries, a file's hash and its header come out of tasks that open the path
themselves, so neither the list of files nor a file's content passes through the driver.  Files are read in pieces, so
memory doesn't depend on their length.
"""

from __future__ import annotations

import csv
import hashlib
import io
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrub.session import ensure_checkpoint_dir

#: Bytes that a hash reads at a time, as one buffer.
PIECE = 1 << 20

#: Entries or files of one Arrow batch that a task hands on.
BATCH = 4096

#: Longest header record, in characters; a file with a longer one counts as without a header.
HEADER_CHARS = 1 << 24


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as the session's settings name it; local ones without "file:"."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return re.sub("^file:/*", "/", full)


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path inside it, and what comes before that path in its full form (nothing for local paths).

    Whatever has a scheme is opened as pyarrow does (hdfs, s3, gs, abfss).
    """
    if path.startswith("/") or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path), ""
    system, inside = fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))
    bare = path.rstrip("/")
    return system, inside, bare[: len(bare) - len(inside.rstrip("/"))]


def hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _local_entries(path: str) -> Iterator[tuple[str, int, bool]]:
    if os.path.isfile(path):
        yield path, os.path.getsize(path), False
        return
    here = os.path.realpath(path) + "/"
    with os.scandir(path) as entries:
        for e in entries:
            if hidden(e.name) or not os.path.exists(e.path):
                continue
            if e.is_dir():
                # A link to a folder above would be walked for ever.
                if not (e.is_symlink() and here.startswith(os.path.realpath(e.path) + "/")):
                    yield e.path, 0, True
            else:
                yield e.path, e.stat().st_size, False


def _entries(path: str) -> Iterator[tuple[str, int, bool]]:
    """(path, length, folder) of what a folder holds; of a file, itself."""
    system, inside, before = opened(path)
    if not before:
        yield from _local_entries(inside)
        return
    info = system.get_file_info(inside)
    if info.type == fs.FileType.File:
        yield path, info.size, False
        return
    for e in system.get_file_info(fs.FileSelector(inside)):
        if not hidden(e.base_name):
            yield before + e.path, e.size or 0, e.type == fs.FileType.Directory


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def _over_paths(paths: DataFrame, rows_of: Callable[[str], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows that `rows_of` gives for each path of the one column of `paths`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((row for b in batches for p in b.column(0).to_pylist() for row in rows_of(p)), schema)

    return paths.mapInArrow(run, ddl)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over as many tasks as there are rows, up to four a core: few bytes, but each stands for a folder or file."""
    n = rows.count()
    return rows.repartition(max(1, min(n, 4 * rows.sparkSession.sparkContext.defaultParallelism)))


_ENTRY = pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())])


def _alternatives(path: str) -> list[str]:
    """A glob's braces written out."""
    m = re.search(r"\{([^{}]*)\}", path)
    return [path] if not m else [p for a in m[1].split(",") for p in _alternatives(path[: m.start()] + a + path[m.end() :])]


def _cut(path: str) -> tuple[str, tuple[str, ...]]:
    """The folder above the first glob of a path, and the names from there on as globs."""
    head, *rest = path.split("/")
    at = next((i for i, name in enumerate(rest) if re.search(r"[*?\[]", name)), None)
    if at is None:
        return path.rstrip("/") or "/", ()
    return "/".join([head, *rest[:at]]) or "/", tuple(rest[at:])


def walk(spark: SparkSession, paths, recursive: bool = True) -> DataFrame:
    """(path, length) of every file at or below `paths` (a path or several; globs allowed), empty files too.

    A folder is listed by one task and the folders found in it are the next round's rows, so there is a job for each
    level of the tree and no list of files on the driver.  Names that Spark's readers pass over are left out.  Local
    paths come without "file:".  With `recursive=False` only the files right in a given folder are listed.  A path that isn't there is
    an error; a glob that meets nothing isn't.
    """
    # imported here: files imports this module
    from scrub.sources.files import glob_regex

    ensure_checkpoint_dir(spark)
    cuts: dict[tuple[str, ...], list[str]] = {}
    given = list(dict.fromkeys(q for p in ([paths] if isinstance(paths, str) else paths) for q in _alternatives(p)))
    for path in given:
        root, globs = _cut(path)
        cuts.setdefault(globs, []).append(qualified(spark, root))
    found = spark.createDataFrame([], "path string, length long")
    for globs, roots in cuts.items():
        level, depth = spark.createDataFrame([(r,) for r in roots], "path string"), 0
        while not level.isEmpty():
            entries = _over_paths(dealt(level), _entries, _ENTRY, "path string, length long, folder boolean")
            if depth < len(globs):
                entries = entries.where(F.substring_index("path", "/", -1).rlike(glob_regex(globs[depth])))
            entries = entries.checkpoint()
            depth += 1
            if depth >= len(globs):
                found = found.unionByName(entries.where(~F.col("folder")).select("path", "length"))
                if not recursive and depth > len(globs):
                    break
            level = entries.where("folder").select("path")
    return found.dropDuplicates(["path"]) if len(given) > 1 else found


def _digest(path: str) -> Iterator[tuple[str, int, str]]:
    system, inside, _ = opened(path)
    sha, length, room = hashlib.sha256(), 0, bytearray(PIECE)
    view = memoryview(room)
    with system.open_input_stream(inside, compression=None) as f:
        while n := f.readinto(view):
            sha.update(view[:n])
            length += n
    yield path, length, sha.hexdigest()


_HASH = pa.schema([("path", pa.string()), ("length", pa.int64()), ("sha256", pa.string())])


def file_hashes(paths: DataFrame) -> DataFrame:
    """(path, length, sha256) of the files in the one column of `paths`, read in pieces; any length of file."""
    return _over_paths(dealt(paths), _digest, _HASH, "path string, length long, sha256 string")


def first_record(lines: Iterator[str]) -> list[str] | None:
    """The first record of CSV lines that isn't blank; cells may hold line ends in quotes.  None without one."""
    csv.field_size_limit(HEADER_CHARS)
    try:
        return next((r for r in csv.reader(lines) if r), None)
    except csv.Error:
        return None


def _header(path: str) -> Iterator[tuple[str, list[str] | None]]:
    system, inside, _ = opened(path)
    with system.open_input_stream(inside) as f, io.TextIOWrapper(f, "utf-8-sig", "replace", newline="") as text:
        yield path, first_record(iter(lambda: text.readline(HEADER_CHARS), ""))


_HEAD = pa.schema([("path", pa.string()), ("header", pa.list_(pa.string()))])


def file_headers(paths: DataFrame) -> DataFrame:
    """(path, header) of CSV files: the cells of the first record that isn't blank, null without one.  Only the head is read."""
    return _over_paths(dealt(paths), _header, _HEAD, "path string, header array<string>")
