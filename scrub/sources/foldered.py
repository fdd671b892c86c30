"""Lines written to a folder for each document, in a given order, and read back, all by tasks.

The layout is that of Spark's partitioned text writer: `<column>=<value>/part-*`, values escaped as there, a document's
text the concatenation of its part files in part order.  Spark's committer moves the files one after the other on the
driver, and its reader lists every folder for the driver; with a folder a document both cost more than the job.  Here
tasks write below a work folder, the commit notes the attempts that Spark accepted, and a second job moves their files
to their places; the reader's listing and its files are rows of tasks.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from scrub.sources.listing import dealt, opened, qualified, walk

FORMAT = "scrub_foldered"
ACCEPTED = "_accepted.json"

#: Folder value of null and empty keys, as in Spark.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"

#: What Spark escapes in a folder's name.
_ESCAPES = {c: f"%{c:02X}" for c in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}

#: Characters that one Arrow batch of the reader holds, or one value.
BATCH_CHARS = 1 << 22


@dataclass
class Attempt(WriterCommitMessage):
    """The work folder of a task's attempt; nothing if it had no rows."""

    folder: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.work, self.column, self.run = options["work"], options["column"].translate(_ESCAPES), options["run"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context = TaskContext.get()
        system, work, _ = opened(self.work)
        own = f"{context.partitionId()}-{context.taskAttemptId()}"
        name = f"part-{context.partitionId():05d}-{self.run}.txt"
        now, out = None, None
        try:
            for batch in iterator:
                for key, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), itemgetter(0)):
                    if key != now:
                        if out is not None:
                            out.close()
                        now, folder = key, f"{work}/{own}/{self.column}={key.translate(_ESCAPES)}"
                        system.create_dir(folder, recursive=True)
                        out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    for _, value in rows:
                        out.write((value or "").encode() + b"\n")
        finally:
            if out is not None:
                out.close()
        return Attempt(own if now is not None else "")

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        system, work, _ = opened(self.work)
        system.create_dir(work, recursive=True)
        with system.open_output_stream(f"{work}/{ACCEPTED}") as f:
            f.write(json.dumps([m.folder for m in messages if m is not None and m.folder]).encode())

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        """Nothing to take back: unfinished files lie in the work folder, which goes in any case."""


class FolderedText(DataSource):
    """Takes (key, value) sorted by key; options `work`, `column` and `run` (part of the files' names)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def folder_key(column: Column) -> Column:
    """The key of a document's folder: its value as text, one key for null and empty."""
    text = column.cast("string")
    return F.when(text != "", text).otherwise(F.lit(NO_VALUE))


def _move(work: str, root: str, attempts: DataFrame) -> None:
    """Move the files of each accepted attempt to their folders below `root`; what a lost task had moved stays moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, here, _ = opened(work)
        _, there, _ = opened(root)
        for batch in batches:
            for attempt in batch.column(0).to_pylist():
                for folder in system.get_file_info(fs.FileSelector(f"{here}/{attempt}")):
                    to = f"{there}/{folder.base_name}"
                    system.create_dir(to, recursive=True)
                    for file in system.get_file_info(fs.FileSelector(folder.path, allow_not_found=True)):
                        try:
                            system.move(file.path, f"{to}/{file.base_name}")
                        except OSError:
                            # A second attempt of this task may have been faster.
                            if system.get_file_info(f"{to}/{file.base_name}").type != fs.FileType.File:
                                raise
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    dealt(attempts).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_foldered(rows: DataFrame, path: str, column: str, mode: str = "errorifexists") -> None:
    """Write ``rows`` (key from `folder_key`, order, value) as lines to ``path/<column>=<key>/part-*``, each key's in their order.

    Rows are ranged over (key, order): a key that holds most rows is cut among tasks.  ``mode`` as in Spark's writer.
    """
    spark = rows.sparkSession
    root = qualified(spark, path).rstrip("/")
    file = spark._jvm.org.apache.hadoop.fs.Path
    hadoop = file(root)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(hadoop):
        if mode in ("error", "errorifexists"):
            raise FileExistsError(f"output {path} is already there")
        if mode == "ignore":
            return
        if mode == "overwrite":
            system.delete(hadoop, True)
    run = uuid.uuid4().hex
    work = f"{root}/_work-{run}"
    spark.dataSource.register(FolderedText)
    try:
        ranged = rows.repartitionByRange("key", "order").sortWithinPartitions("key", "order").select("key", "value")
        ranged.write.format(FORMAT).option("work", work).option("column", column).option("run", run).mode("append").save(root)
        here, at, _ = opened(work)
        with here.open_input_stream(f"{at}/{ACCEPTED}") as f:
            accepted = json.loads(f.read())
        if accepted:
            _move(work, root, spark.createDataFrame([(a,) for a in accepted], "attempt string"))
        with here.open_output_stream(f"{opened(root)[1]}/_SUCCESS"):
            pass
    finally:
        system.delete(file(work), True)


def read_foldered(spark: SparkSession, path: str, column: str, whole: bool = False) -> DataFrame:
    """(``column`` string, file, value) of the files that `write_foldered` put below ``path``: a row a line, or a file with ``whole``."""

    def values(at: str) -> Iterator[tuple[str | None, str, str]]:
        system, inside, _ = opened(at)
        folder, name = inside.rsplit("/", 2)[1:]
        key = unquote(folder.partition("=")[2])
        with system.open_input_stream(inside, compression=None) as f, io.TextIOWrapper(f, "utf-8", "replace", newline="\n") as text:
            for value in [text.read()] if whole else (line.removesuffix("\n") for line in text):
                yield None if key == NO_VALUE else key, name, value

    schema = pa.schema([(column, pa.string()), ("file", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for row in (v for b in batches for p in b.column(0).to_pylist() for v in values(p)):
            held.append(row)
            chars += len(row[2]) + 100
            if chars >= BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], schema=schema)
                held, chars = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], schema=schema)

    escaped = column.replace("`", "``")
    return dealt(walk(spark, path).select("path")).mapInArrow(run, f"`{escaped}` string, file string, value string")
