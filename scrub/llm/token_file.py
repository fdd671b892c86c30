"""Token ids in a compact binary file format, as a Spark data source.

`df.write.format("token_ans")` takes rows (id, ids: array<int>, or little-endian unsigned 32-bit integers as binary) in
their order and writes one file a task; `read` gives them back, with the place of each document's first id in the whole.  A file is a run of sections and a directory:

    section   documents (Arrow: doc_id, n_tokens), the frequency table, blocks (see `rans`)
    directory per section where its parts lie, its documents, ids and checksum, as JSON; its length, checksum and "RANS1"

A section holds whole documents of about SECTION ids and one table for all its blocks, so a writer never holds more than
a section and one document, and every section can be read by another task.  Files are named by partition and attempt;
the commit writes a manifest of the files of the attempts that Spark accepted, with their order, so what lost or repeated
attempts left behind is never read.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from scrub.llm import rans
from scrub.llm.common import Scratch, col, fresh, slices, small_batches, text_of
from scrub.llm.vocab import LibraryBpe, share

FORMAT = "token_ans"
MAGIC = b"RANS1"
MANIFEST = "_manifest.json"

#: Ids after which a section is closed.
SECTION = 1 << 22

#: Least ids that a reading task takes of a file that has them.
READ_IDS = 1 << 22

#: Ids that one Arrow batch of the reader holds, or one document.
BATCH_IDS = 1 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Spark path; a path without a scheme is a local (or mounted) one."""
    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: nothing (`file` empty), or a file of these totals."""

    partition: int
    file: str
    docs: int
    ids: int


class _Sections:
    """Writes a file section by section."""

    def __init__(self, out, id_type: pa.DataType, tokens: int = SECTION):
        self.out, self.id_type, self.tokens = out, id_type, tokens
        self.at, self.directory = 0, []
        self.docs: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.held = 0

    def put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, docs: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their ids in a row, in cuts that fill a section each."""
        while len(docs):
            upto = np.cumsum(lengths)
            n = min(len(docs), 1 + int(np.searchsorted(upto, self.tokens - self.held)))
            self.docs.append(docs.slice(0, n))
            self.lengths.append(lengths[:n])
            # A copy, so that a section doesn't keep whole batches alive.
            self.ids.append(ids[: upto[n - 1]].astype("<u4"))
            self.held += int(upto[n - 1])
            docs, lengths, ids = docs.slice(n), lengths[n:], ids[upto[n - 1] :]
            if self.held >= self.tokens:
                self.close_section()

    def close_section(self) -> None:
        if not self.docs:
            return
        ids = np.concatenate(self.ids)
        self.ids = []
        table = rans.Table.of(ids)
        rows = pa.RecordBatch.from_arrays([pa.concat_arrays(self.docs), pa.array(np.concatenate(self.lengths), pa.int64())], ["doc_id", "n_tokens"])
        index = io.BytesIO()
        with pa.ipc.new_stream(index, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(rows)
        index = index.getvalue()
        entry = {"docs": len(rows), "ids": len(ids), "index": [*self.put(index), zlib.crc32(index)], "table": self.put(table.to_bytes())}
        entry["blocks"] = [self.put(rans.encode(ids[i : i + rans.BLOCK], table)) for i in range(0, len(ids), rans.BLOCK)]
        self.directory.append(entry)
        self.docs, self.lengths, self.held = [], [], 0

    def close(self) -> tuple[int, int]:
        self.close_section()
        body = json.dumps(self.directory).encode()
        self.put(body + struct.pack("<QI", len(body), zlib.crc32(body)) + MAGIC)
        return sum(s["docs"] for s in self.directory), sum(s["ids"] for s in self.directory)


def _directory(f, size: int) -> list[dict]:
    tail = 12 + len(MAGIC)
    f.seek(max(0, size - tail))
    end = f.read(tail)
    if len(end) < tail or end[12:] != MAGIC:
        raise ValueError("no token file: the end isn't there")
    n, crc = struct.unpack("<QI", end[:12])
    f.seek(size - tail - n)
    body = f.read(n)
    if zlib.crc32(body) != crc:
        raise ValueError("the directory doesn't match its checksum")
    return json.loads(body)


def _part(f, place: list[int]) -> bytes:
    f.seek(place[0])
    return f.read(place[1])


def _index(f, section: dict) -> pa.RecordBatch:
    data = _part(f, section["index"])
    if zlib.crc32(data) != section["index"][2]:
        raise ValueError("an index of documents doesn't match its checksum")
    return pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]


def _ids(f, section: dict, table: rans.Table, begin: int, end: int) -> np.ndarray:
    """A section's ids from `begin` to `end`: of the blocks that hold them, from the nearest checkpoints on."""
    out = []
    for k in range(begin // rans.BLOCK, -(-end // rans.BLOCK)):
        base = k * rans.BLOCK
        out.append(rans.decode(_part(f, section["blocks"][k]), table, max(0, begin - base), end - base))
    return np.concatenate([np.zeros(0, np.uint32), *out])


def _manifest(path: str) -> list[dict]:
    system, at = opened(path)
    with system.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class _Piece(InputPartition):
    """Sections `first` up to `last` of a file, the first of which starts at id `start` of the whole."""

    file: str
    first: int
    last: int
    start: int


def _in_a_row(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each row has, and all of them."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        ends = column.offsets.to_numpy()
        return np.diff(ends), column.values.to_numpy()[ends[0] : ends[-1]]
    large = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.diff(ends) // 4, np.frombuffer(data or b"", "<u4", (ends[-1] - ends[0]) // 4, int(ends[0]))


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.tokens = options["path"], int(options.get("section", SECTION))
        self.run = uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{self.run}.ans"
        system, at = opened(self.path)
        sections, out = None, None
        try:
            for batch in iterator:
                if not len(batch):
                    continue
                if sections is None:
                    system.create_dir(at, recursive=True)
                    out = system.open_output_stream(f"{at}/{name}")
                    sections = _Sections(out, batch.schema[0].type, self.tokens)
                sections.add(batch.column(0), *_in_a_row(batch.column(1)))
            if sections is None:
                return Written(context.partitionId(), "", 0, 0)
            docs, ids = sections.close()
        finally:
            if out is not None:
                out.close()
        return Written(context.partitionId(), name, docs, ids)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        files = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.partition)
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{MANIFEST}") as f:
            f.write(json.dumps([asdict(m) for m in files]).encode())

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        system, at = opened(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{at}/{m.file}")


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.names, self.least = options["path"], schema.names, int(options.get("piece", READ_IDS))
        self.raw = schema["ids"].dataType.typeName() == "binary" if "ids" in schema.names else True

    def partitions(self) -> list[InputPartition]:
        """A piece a file, cut where it has READ_IDS (option `piece`) ids or more; the files' directories are read by the tasks."""
        out, start = [], 0
        for m in _manifest(self.path):
            n = max(1, m["ids"] // self.least)
            out += [_Piece(m["file"], k, n, start) for k in range(n)]
            start += m["ids"]
        return out or [_Piece("", 0, 1, 0)]

    def read(self, piece: InputPartition) -> Iterator[pa.RecordBatch]:
        if not piece.file:
            return
        system, at = opened(self.path)
        with system.open_input_file(f"{at}/{piece.file}") as f:
            sections = _directory(f, f.size())
            start = piece.start
            for k, section in enumerate(sections):
                if k * piece.last // len(sections) == piece.first:
                    yield from self.section(f, section, start)
                start += section["ids"]

    def section(self, f, section: dict, start: int) -> Iterator[pa.RecordBatch]:
        rows, table = _index(f, section), rans.Table.from_bytes(_part(f, section["table"]))
        upto = np.concatenate([[0], np.cumsum(rows.column(1).to_numpy())])
        row = 0
        while row < len(rows):
            last = max(row + 1, int(np.searchsorted(upto, upto[row] + BATCH_IDS, "right")) - 1)
            offsets = upto[row : last + 1] - upto[row]
            ids = _ids(f, section, table, int(upto[row]), int(upto[last]))
            if self.raw:
                data = pa.py_buffer(ids.astype("<u4").tobytes())
                lists = pa.BinaryArray.from_buffers(pa.binary(), last - row, [None, pa.py_buffer((4 * offsets).astype(np.int32)), data])
            else:
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            columns = {"doc_id": rows.column(0).slice(row, last - row), "start": pa.array(start + upto[row:last]), "n_tokens": pa.array(np.diff(upto[row : last + 1])), "ids": lists}
            yield pa.RecordBatch.from_arrays([columns[n] for n in self.names], self.names)
            row = last


class TokenFiles(DataSource):
    """`token_ans`: options `path`, for writing `section` (ids of a section), for reading `piece` (least ids of a task)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids array<int>"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenFiles)


def encoded(docs: DataFrame, vocabulary: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary) in ascending order of the id: the library's ids of each whole text, with `end_id` after them.

    Null ids come last; rows that repeat an id are ordered by the hash of their texts.  Null texts are empty.
    """
    spark = docs.sparkSession
    shared = share(spark, vocabulary)
    tail = b"" if end_id is None else end_id.to_bytes(4, "little")

    # Binary, since Spark copies arrays one by one.
    @F.arrow_udf("binary")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = shared.encoder(LibraryBpe)

        def part(some: pa.Array) -> pa.Array:
            return pa.array([ids + tail for ids in bpe.encode_all(some)], pa.binary())

        return slices(texts, part)

    small_batches(spark)
    slim = docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    # The texts are shuffled, not their ids, which take more room. Equal rows, however many, are split by their place.
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    return slim.orderBy(*order).select("doc_id", run("text").alias("ids"))


def write_tokens(ids: DataFrame, path: str, section: int = SECTION) -> None:
    """Write (id, ids) as token files below `path`, a new folder, in the order of the rows."""
    register(ids.sparkSession)
    ids.write.format(FORMAT).option("section", section).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, id_type: str = "long", raw: bool = False, piece: int = READ_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents below `path`, a task to `piece` ids or so (whole sections).

    `start` is the number of ids of all documents before; `ids` is array<int>, or with `raw` the little-endian unsigned
    32-bit integers as binary.  Whatever doesn't match its checksum raises an error.
    """
    register(spark)
    return spark.read.format(FORMAT).schema(f"doc_id {id_type}, start long, n_tokens long, ids {'binary' if raw else 'array<int>'}").option("piece", piece).load(path)


def read_windows(windows: DataFrame, path: str, begin_col: str = "begin", n_col: str = "n") -> DataFrame:
    """`windows` with `ids` array<int>: the n ids from place `begin` of the whole on, fewer where it ends.

    Windows are sorted by where they begin, so that neighbours are read by one task; a window costs the checkpoint
    intervals it touches, not its blocks or files.  Null or negative numbers and windows behind the end give no ids.
    """
    files = _manifest(path)
    starts = np.concatenate([[0], np.cumsum([m["ids"] for m in files], dtype=np.int64)])
    names = [m["file"] for m in files]

    @F.arrow_udf("array<int>")
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        system, at = opened(path)
        known: tuple = (None, None, None)  # number of the file, the open file, its sections with where they start
        tables: dict = {}

        def piece(begin: int, end: int) -> np.ndarray:
            nonlocal known
            out = []
            while begin < end:
                k = int(np.searchsorted(starts, begin, "right")) - 1
                if known[0] != k:
                    f = system.open_input_file(f"{at}/{names[k]}")
                    sections = _directory(f, f.size())
                    known = (k, f, sections, np.concatenate([[0], np.cumsum([s["ids"] for s in sections])]) + starts[k])
                    tables.clear()
                _, f, sections, ends = known
                s = int(np.searchsorted(ends, begin, "right")) - 1
                if s not in tables:
                    tables.clear()
                    tables[s] = rans.Table.from_bytes(_part(f, sections[s]["table"]))
                upto = min(end, int(ends[s + 1]))
                out.append(_ids(f, sections[s], tables[s], begin - int(ends[s]), upto - int(ends[s])))
                begin = upto
            return np.concatenate([np.zeros(0, np.uint32), *out]).astype(np.int32)

        for begins, counts in columns:
            got = [piece(b, min(int(starts[-1]), b + n)) if b is not None and n is not None and b >= 0 else np.zeros(0, np.int32) for b, n in zip(begins.to_pylist(), counts.to_pylist())]
            yield pa.array(got, pa.list_(pa.int32()))

    return windows.sort(col(begin_col)).withColumn(fresh(windows, "ids"), run(col(begin_col).cast("long"), col(n_col).cast("long")))


def token_digests(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`, read back from token files written for it: (doc_id, start, n_tokens, ids_crc32).

    Null and empty texts have the end id alone.  Rows that repeat an id are documents each; other columns are ignored;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    path = f"{scratch.root}/files"
    write_tokens(encoded(docs, vocabulary, end_id, id_col, text_col), path)
    back = read_tokens(spark, path, docs.schema[id_col].dataType.simpleString(), raw=True)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
