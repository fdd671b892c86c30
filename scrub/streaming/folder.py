"""Incremental redaction of files arriving in a folder (Structured Streaming), with a result for every file.

Each new CSV file is redacted exactly once: the file source remembers what it
has read in the checkpoint, and a micro-batch overwrites its own output and its
own part of the ledger, so a restarted query (or a lost executor) resumes without
re-emitting or skipping files.  The work on rows is stateless (a projection), so no
watermark or state store is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scrub.names import col, unique_names
from scrub.operators.runs import SOURCE, cell_tallies, file_rows, group_results, header_groups, kept_rows
from scrub.operators.tables import RESULT_PREFIX
from scrub.policy import DEFAULT_POLICY, Policy
from scrub.sources.files import local_path
from scrub.sources.listing import file_headers

#: Folder of the file results below the output; readers of the output skip names that start so.
LEDGER = "_files"


def redact_folder_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, columns,
                         policy: Policy = DEFAULT_POLICY, keep=(), available_now: bool = True,
                         max_files_per_trigger: int | None = None, null_tokens=(), multiline: bool = True,
                         pattern: str | None = None) -> StreamingQuery:
    """Start the stream; ``available_now`` drains what is there and stops (batch-like runs).

    The stream carries paths; a micro-batch reads its files by their own
    headers, so a file with another column order or set gives the same
    ``columns`` by name (missing ones null, further ones left out).  Output is Parquet in
    ``out_dir/batch=<n>``, overwritten when a micro-batch is repeated.

    Files fail as in a batch run: a file without a header line, one holding a row with more fields than its header,
    and here also one whose header has none of ``columns``.  Nothing of a failed file is written; the stream goes on.
    ``stream_files`` has the result of every file but those of no bytes, which the file source never hands on.  ``pattern`` is a glob over file names.
    """
    names = list(columns)
    out_dir = out_dir.rstrip("/")

    def redact_batch(df: DataFrame, batch: int) -> None:
        listed = df.select(local_path(df["path"]).alias("input_path"))
        # Read once: the groups and the ledger must agree.
        heads = kept_rows(file_headers(listed), True)
        groups = header_groups(heads)
        headed = [(p, None if set(names) & set(unique_names(h)) else "the header has none of the wanted columns") for h, g in groups.items() for p in g]
        known = spark.createDataFrame(headed, "p string, refused string")
        listed = listed.join(known, listed["input_path"] == known["p"], "left").select(
            "input_path", F.lit("csv").alias("kind"), F.col("p").isNotNull().alias("has_header"), "refused"
        )
        counted, parts = None, []
        for header, group in sorted(groups.items()):
            have = unique_names(header)
            if not set(names) & set(have):
                continue
            res, places, _ = group_results(spark, header, group, policy, null_tokens, multiline, keep)
            res = kept_rows(res, True)
            redacted = [c for c, n in zip(places, have) if n not in set(keep)]
            here = cell_tallies(res, redacted)
            counted = here if counted is None else counted.unionByName(here)
            cells = {n: col(RESULT_PREFIX + c)["redacted"] if c in redacted else col(c) for c, n in zip(places, have)}
            parts.append(res.select(SOURCE, *[cells.get(n, F.lit(None).cast("string")).alias(f"c{i}") for i, n in enumerate(names)]))
        files = kept_rows(file_rows(listed, counted), True)
        failed = files.where(~F.col("success")).select(F.col("input_path").alias(SOURCE))
        rows = None
        for part in parts:
            good = part.join(failed, SOURCE, "left_anti").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
            rows = good if rows is None else rows.unionByName(good)
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{out_dir}/batch={batch}")
        # The ledger last: a file has a result only when its rows are there.
        files.write.mode("overwrite").parquet(f"{out_dir}/{LEDGER}/batch={batch}")

    # Only paths are selected, so the source reads no content.
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    w = reader.load(in_dir).select("path").writeStream.foreachBatch(redact_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def stream_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """The result of every file that the stream has finished: those of ``redact_csv_files``, and the ``batch``."""
    return spark.read.parquet(f"{out_dir.rstrip('/')}/{LEDGER}")
