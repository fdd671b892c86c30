"""Lines written to single files of given names, in a given order, whatever the number of tasks.

Spark's own text writer makes the pieces, by many tasks: rows are ranged over (file, order), so a file that holds
most rows is cut among them.  A second job puts each file's pieces in a row, in parts of a buffer, and its commit
moves the finished files to their names.  Until then nothing but a work folder, whose name readers pass over, is seen; what lost or
repeated attempts leave goes with it.
"""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from scrub.sources.listing import PIECE, dealt, opened, qualified, walk

FORMAT = "scrub_mirrored"


@dataclass
class Finished(WriterCommitMessage):
    """Files that a task has put together: where they lie, and their names below the output."""

    files: list[tuple[str, str]] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root, self.work = options["path"], options["work"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context, out = TaskContext.get(), Finished()
        system, work, _ = opened(self.work)
        own = f"{work}/done/{context.partitionId()}-{context.taskAttemptId()}"
        system.create_dir(own, recursive=True)
        for batch in iterator:
            for name, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = f"{own}/{len(out.files)}"
                with system.open_output_stream(made, compression=None) as to:
                    for piece in pieces:
                        with system.open_input_stream(opened(piece)[1], compression=None) as f:
                            shutil.copyfileobj(f, to, PIECE)
                out.files.append((made, name))
        return out

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        system, root, _ = opened(self.root)
        made: set[str] = set()
        for message in messages:
            for path, name in message.files if message is not None else ():
                to = f"{root}/{name}"
                folder = to.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                system.move(path, to)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        """Nothing to take back: unfinished files lie in the work folder, which goes in any case."""


class MirroredFiles(DataSource):
    """Takes (file, array of the paths of its pieces); options `path` (the output) and `work` (a folder below it)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def join_pieces(whole: DataFrame, root: str, work: str) -> None:
    """Put the pieces of each row of ``whole`` (file, array of paths) in a row as ``root/<file>``; ``work`` is a folder below ``root``."""
    whole.sparkSession.dataSource.register(MirroredFiles)
    dealt(whole).write.format(FORMAT).option("work", work).mode("append").save(root)


def write_mirrored(rows: DataFrame, out_dir: str, mode: str = "errorifexists", observe: tuple[Observation, list] | None = None) -> None:
    """Write ``rows`` (file, block, row, line; any more are only observed) as ``out_dir/<file>``, its lines by (block, row).

    ``mode`` is about the folder: ``errorifexists``, ``overwrite`` (what is there goes first), ``ignore`` or ``append``
    (a file of a name that is there is replaced).
    """
    spark = rows.sparkSession
    root = qualified(spark, out_dir).rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(hadoop):
        if mode in ("error", "errorifexists"):
            raise FileExistsError(f"output {out_dir} is already there")
        if mode == "ignore":
            return
        if mode == "overwrite":
            system.delete(hadoop, True)
    work = f"{root}/_work-{uuid.uuid4().hex}"
    # Not null, so that the writer keeps the order instead of sorting by the file alone.
    order = ["file", "block", "row"]
    ranged = rows.withColumn("file", F.coalesce("file", F.lit(""))).repartitionByRange(*order)
    if observe:
        # Above the exchange: what lies below it is run twice, once for the ranges' bounds.
        ranged = ranged.observe(observe[0], *observe[1])
    try:
        ranged.sortWithinPartitions(*order).select("file", "line").write.partitionBy("file").text(f"{work}/parts")
        parts = walk(spark, f"{work}/parts")
        folder = F.regexp_extract("path", "/file=([^/]*)/[^/]*$", 1)
        name = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
        whole = parts.groupBy(name.alias("file")).agg(F.sort_array(F.collect_list("path")).alias("pieces"))
        join_pieces(whole, root, work)
    finally:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(work), True)
