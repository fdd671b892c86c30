"""End-to-end runs: redact CSV files or document pages, audit them, write only when applying.

A run reads every input with one multi-path read (files become splits; the
file a row came from is ``_metadata.file_path``), redacts with one projection,
and derives per-file results and the run summary with grouped aggregates.
Nothing is looped over on the driver.  With ``apply=False`` (the default, a dry
run) everything is computed and counted, nothing is written.

When applying, the redacted rows feed two outputs (the files and the audit);
they are checkpointed between the two jobs, into the shared folder named by
``spark.checkpoint.dir``: the redaction runs once, and nothing is recomputed after
an executor loss.  With ``durable=False`` they are persisted on executor disks
instead, and a lost executor's blocks are recomputed from the input.
"""

from __future__ import annotations

import csv
import datetime as _dt
import io
import re
import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrub.functions.arrays import explode_kept
from scrub.operators.audit import count_by, explode_entities, file_results, run_summary, tallies, tally_maps, types_in
from scrub.operators.documents import redact_pages, write_renders
from scrub.names import col, unique_names
from scrub.operators.tables import RESULT_PREFIX, cell_results
from scrub.policy import DEFAULT_POLICY, Policy
from scrub.session import ensure_checkpoint_dir
from scrub.sources.files import base_name, guard_output, large_files, plain_path, quoted_line_ends, save_report
from scrub.sources.listing import file_hashes, file_headers, qualified, walk
from scrub.sources.mirrored import write_mirrored


@dataclass
class RunResult:
    run_id: str
    started_at: str
    completed_at: str
    dry_run: bool
    files: DataFrame
    summary: DataFrame
    findings: DataFrame
    # Run totals counted by the write itself (``Observation``); apply runs only.
    observed: dict | None = None


def kept_rows(df: DataFrame, durable: bool) -> DataFrame:
    """Materialise rows that feed two jobs: reliable checkpoint, or executor-disk persist."""
    if durable:
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.DISK_ONLY)


def entity_types_of(policy: Policy) -> list[str]:
    """Every entity type a policy can report (fixed by the policy, so known before the run)."""
    from scrub.functions.mask import ACCOUNT_NUMBER, CARD_NUMBER, ROUTING_NUMBER
    from scrub.functions.rules import active_rules
    from scrub.policy import FULL_COLUMN_REDACTION

    types = [CARD_NUMBER, ACCOUNT_NUMBER] + ([ROUTING_NUMBER] if policy.financial.mask_routing else [])
    types += [r.entity_type for r in active_rules(policy)]
    types += [p.entity_type for p in policy.custom_patterns]
    if policy.sensitive_columns:
        types.append(FULL_COLUMN_REDACTION)
    return list(dict.fromkeys(types))


def _observed_totals(policy: Policy) -> list:
    """Aggregates for ``observe``: rows, changed cells and findings per type in changed cells (of ``_output_lines``)."""

    def of_type(et):
        return lambda t: t == et  # one argument: filter passes (x, index) to two

    found = [F.sum(F.size(F.filter("types", of_type(et)))).cast("long").alias(et) for et in entity_types_of(policy)]
    return [F.count(F.when(F.col("row") >= 0, 1)).alias("rows"), F.sum("changed").alias("fields_changed"), *found]


def _changes(places: list[str]) -> tuple:
    """Number of changed cells of a row, and the types found in them."""
    cell = [col(RESULT_PREFIX + c) for c in places]
    changed = sum((r["changed"].cast("long") for r in cell), F.lit(0).cast("long"))
    types = F.flatten(F.array(*[F.when(r["changed"], F.transform(r["entities"], lambda e: e["entity_type"])).otherwise(F.array().cast("array<string>")) for r in cell]))
    return changed, types


def _output_lines(res: DataFrame, places: list[str], file, *more) -> DataFrame:
    """A line of the output for each row: (file, block, row, line, changed, types); quotes doubled, cells untrimmed."""
    changed, types = _changes(places)
    cells = F.struct(*[col(RESULT_PREFIX + c)["redacted"].alias(c) for c in places])
    line = F.to_csv(cells, {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    if len(places) == 1:
        # A single missing cell must not become a blank line, which readers skip (and ``to_csv`` gives null for it).
        line = F.when(col(RESULT_PREFIX + places[0])["redacted"].isNull(), F.lit('""')).otherwise(line)
    return res.select(file.alias("file"), F.col(BLOCK).alias("block"), F.col(ROW).alias("row"), line.alias("line"), changed.alias("changed"), types.alias("types"), *more)


def _header_line(names: list[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(names)
    return out.getvalue()


def now_text() -> str:
    return _dt.datetime.now(_dt.timezone.utc).isoformat()


CORRUPT, SOURCE = "_corrupt_record", "_source"
#: A row's place in its file: the split's first byte, and the rows of a split counted up.
BLOCK, ROW = "_block", "_row"
FINDINGS = "source string, column_name string, entity_type string"


def _fields(record):
    """Number of fields of a raw CSV record, in linear time: separators outside double quotes, plus one."""
    bare = F.regexp_replace(record, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _relative(path, base: str):
    """The path below ``base``; the bare name of a file elsewhere."""
    base = base.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(base_name(path))


def _base_of(paths) -> str:
    """The deepest folder that holds all inputs; an input that is no file of its own counts as a folder."""
    import os

    plain = [re.sub(r"^file:/*", "/", p) for p in paths]
    tops = [os.path.dirname(p) if os.path.splitext(p)[1] else p for p in plain]
    return os.path.commonpath(tops) if all(t.startswith("/") for t in tops) else os.path.commonprefix(tops).rsplit("/", 1)[0]


def group_results(spark: SparkSession, header: tuple, paths, policy: Policy, null_tokens, multiline: bool, keep=()) -> tuple[DataFrame, list[str], list[str]]:
    """Cell results of files with one header, their columns named by place: ``(results, places, names)``.

    Headers can be any text, so they name columns only where a file is written and a finding reported.  Columns
    named in ``keep`` have their cells as they are, under their places.
    """
    names = unique_names(header)
    places = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*places, CORRUPT]])

    def read(some, whole: bool) -> DataFrame:
        reader = (
            spark.read.schema(schema).option("header", True).option("multiLine", whole).option("escape", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        )
        place = [plain_path(F.col("_metadata.file_path")).alias(SOURCE), F.col("_metadata.file_block_start").alias(BLOCK), F.monotonically_increasing_id().alias(ROW)]
        return reader.csv(some).select(*places, CORRUPT, *place)

    # A large file whose line ends all lie between records is read in splits.
    large = large_files(spark, list(paths)) if multiline else []
    cut = set(large) - set(quoted_line_ends(spark, large)) if large else set() if multiline else set(paths)
    parts = [(some, whole) for some, whole in (([p for p in paths if p in cut], False), ([p for p in paths if p not in cut], True)) if some]
    src = read(*parts[0])
    for part in parts[1:]:
        src = src.unionByName(read(*part))
    tokens = [t for t in null_tokens if t != ""]
    cells = [(F.when(~F.col(c).isin(*tokens), F.col(c)) if tokens else F.col(c)).alias(c) for c in places]
    src = src.select(*cells, (F.col(CORRUPT).isNotNull() & (_fields(F.col(CORRUPT)) > len(places))).alias("_long"), SOURCE, BLOCK, ROW)
    hidden = [c for c, n in zip(places, names) if n in set(policy.sensitive_columns)]
    kept = [c for c, n in zip(places, names) if n in set(keep)]
    return cell_results(src, policy.with_(sensitive_columns=tuple(hidden)), keep=[SOURCE, *kept]), places, names


def cell_tallies(res: DataFrame, places: list[str]) -> DataFrame:
    changed, types = _changes(places)
    return tallies(res, SOURCE, types, changed, F.col("_long"))


def file_rows(listed: DataFrame, counted: DataFrame | None) -> DataFrame:
    """One result for every listed file, whatever it holds: (path, kind, header, refused) with its tallies.

    ``refused``, where it is given, says why a file was not read.
    """
    none = F.create_map().cast("map<string,bigint>")
    if counted is None:
        counted = listed.sparkSession.createDataFrame([], f"{SOURCE} string, key string, n long")
    maps = tally_maps(counted, SOURCE)
    got = listed.join(maps, listed["input_path"] == maps[SOURCE], "left")
    long_row = F.coalesce(F.col("m")["#failed"], F.lit(0)) > 0
    error = (
        F.when(F.col("kind") != "csv", F.lit("only extracted page text is processed: pass it to redact_documents_run"))
        .when(~F.col("has_header"), F.lit("no header line (empty file)"))
        .when(long_row, F.lit("a row has more fields than the header"))
    )
    if "refused" in listed.columns:
        error = F.coalesce(F.col("refused"), error)
    ok = error.isNull()
    number = lambda k: F.when(ok, F.coalesce(F.col("m")[k], F.lit(0))).otherwise(0).cast("long")
    types = types_in(F.col("m"))
    return got.select(
        "input_path", F.col("kind").alias("file_type"), ok.alias("success"), number("#units").alias("rows_or_pages"), number("#changed").alias("fields_changed"),
        F.when(ok, F.coalesce(types, none)).otherwise(none).alias("entities_by_type"), error.alias("error"),
    )


def redact_csv_files(spark: SparkSession, inputs, out_dir: str | None = None, policy: Policy = DEFAULT_POLICY,
                     apply: bool = False, report_dir: str | None = None, force: bool = False,
                     durable: bool = True, hashes: bool = False, write_mode: str = "errorifexists",
                     null_tokens=(), multiline: bool = True, input_base: str | None = None, others: DataFrame | None = None) -> RunResult:
    """Redact CSV files.  Output: ``out_dir/<path below input_base>``, one file for each, rows in their order.

    Files are grouped by header and each group is one multi-path read by its own
    header, so columns are never taken by another file's order.  Every input
    has a result: rows and changes; a file of a header alone succeeds with no
    rows; an empty file, or one holding a row with more fields than its header,
    fails (as with a pandas reader), nothing of it is written or counted, and the
    run goes on.  Short rows are padded with nulls.  Findings are those of
    changed cells, one ``FULL_COLUMN_REDACTION`` per non-null cell of a sensitive
    column.  Headers may hold any characters; blank and repeated ones are renamed
    as a pandas reader does.
    ``inputs`` is a path or several (globs too), or a DataFrame whose one column holds the files' paths.
    ``input_base`` (default: the deepest folder of all inputs; needed with a DataFrame) is where outputs'
    relative paths start, so equal names in two folders stay two outputs.
    A file of a header alone is written as such.  ``hashes`` fills ``input_hash`` and, when applying, ``output_hash`` with
    the SHA-256 of the files' bytes.
    ``null_tokens`` are read as missing cells.  Large files without quoted line ends are read in splits;
    ``multiline=False`` says that no file holds any.  ``others`` (input_path, kind) are listed
    files of other kinds, reported as failed.
    """
    started, run_id = now_text(), uuid.uuid4().hex
    found = inputs if isinstance(inputs, DataFrame) else None
    paths = [] if found is not None else [inputs] if isinstance(inputs, str) else list(inputs)
    if found is not None and not input_base:
        raise ValueError("listed inputs need an input_base")
    if apply:
        if out_dir is None:
            raise ValueError("apply=True needs out_dir")
        for p in paths or [input_base or ""]:
            guard_output(p, out_dir, force)
    base = re.sub(r"^file:/*", "/", input_base) if input_base else _base_of(paths)
    groups: dict = {}
    listed = None
    if paths:
        found = walk(spark, paths, recursive=False).select("path")
    if found is not None:
        ensure_checkpoint_dir(spark)
        heads = file_headers(found).checkpoint()
        groups = header_groups(heads)
        listed = heads.select(F.col("path").alias("input_path"), F.lit("csv").alias("kind"), F.col("header").isNotNull().alias("has_header"))
    if others is not None:
        more = others.select("input_path", "kind", F.lit(True).alias("has_header"))
        listed = more if listed is None else listed.unionByName(more)
    if listed is None:
        listed = spark.createDataFrame([], "input_path string, kind string, has_header boolean")

    done, counted, findings = [], None, spark.createDataFrame([], FINDINGS)
    for header, group in sorted(groups.items()):
        res, places, names = group_results(spark, header, group, policy, null_tokens, multiline)
        if apply:
            res = kept_rows(res, durable)
        done.append((res, places, names))
        here = cell_tallies(res, places)
        counted = here if counted is None else counted.unionByName(here)
        per_cell = F.array(*[F.struct(F.lit(n).alias("column_name"), col(RESULT_PREFIX + c).alias("r")) for c, n in zip(places, names)])
        cells = explode_kept(res, [SOURCE], per_cell, "cell").where(F.col("cell.r.changed"))
        cells = cells.select(SOURCE, F.col("cell.column_name").alias("column_name"), F.col("cell.r.entities").alias("_e"))
        findings = findings.unionByName(explode_kept(cells, [SOURCE, "column_name"], F.col("_e"), "e").select(
            F.col(SOURCE).alias("source"), "column_name", F.col("e.entity_type").alias("entity_type")))
    files = file_rows(listed, counted)
    observed = None
    if apply:
        # One row per file: materialised first, so failed files can be left out of the write.
        root = qualified(spark, out_dir).rstrip("/")
        out_path = F.concat(F.lit(root + "/"), _relative(F.col("input_path"), base))
        files = files.withColumn("output_paths", F.when(F.col("success"), F.array(out_path)).otherwise(F.array().cast("array<string>")))
        files = kept_rows(files, durable)
        twice = files.where(F.size("output_paths") > 0).groupBy("output_paths").count().where("count > 1").first()
        if twice:
            raise ValueError(f"{twice['count']} inputs would be written to {twice['output_paths'][0]}: pass an input_base above them")
        failed = files.where(~F.col("success")).select(F.col("input_path").alias(SOURCE))
        heads = spark.createDataFrame([(p, _header_line(unique_names(h))) for h, g in groups.items() for p in g], f"{SOURCE} string, line string")
        lines = heads.select(_relative(F.col(SOURCE), base).alias("file"), F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("row"), "line",
                             F.lit(0).cast("long").alias("changed"), F.array().cast("array<string>").alias("types"), SOURCE)
        for res, places, _ in done:
            lines = lines.unionByName(_output_lines(res, places, _relative(F.col(SOURCE), base), SOURCE))
        totals = Observation(f"scrub_run_{run_id}")
        write_mirrored(lines.join(failed, SOURCE, "left_anti"), out_dir, write_mode, (totals, _observed_totals(policy)))
        observed = {k: n or 0 for k, n in totals.get.items()}
    if hashes:
        files = _with_hashes(files, apply)
    summary = run_summary(files)
    result = RunResult(run_id, started, now_text(), not apply, files, summary, findings, observed)
    if apply and report_dir and policy.create_audit_report:
        save_report(files, report_summary(result), report_dir)
    return result


def _with_hashes(files: DataFrame, written: bool) -> DataFrame:
    read = file_hashes(files.select("input_path")).select(F.col("path").alias("_p"), F.col("sha256").alias("input_hash"))
    files = files.join(read, files["input_path"] == read["_p"], "left").drop("_p")
    if written:
        out = F.get("output_paths", F.lit(0))
        made = file_hashes(files.where(out.isNotNull()).select(out.alias("path"))).select(F.col("path").alias("_o"), F.col("sha256").alias("output_hash"))
        files = files.join(made, out == made["_o"], "left").drop("_o")
    return files


def report_summary(run: RunResult) -> DataFrame:
    """The saved summary: totals, findings by type over all files, and the run's id, times and mode."""
    types = run.files.select(F.explode("entities_by_type").alias("t", "n")).groupBy("t").agg(F.sum("n").alias("n"))
    total = types.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("t", "n")))).alias("aggregate_entities"))
    told = [F.lit(run.run_id).alias("run_id"), F.lit(run.started_at).alias("started_at"), F.lit(run.completed_at).alias("completed_at"), F.lit(run.dry_run).alias("dry_run")]
    return run.summary.select("total_files", "successful_files", "failed_files").join(F.broadcast(total)).select("*", *told)


def redact_documents_run(pages: DataFrame, out_dir: str | None = None, policy: Policy = DEFAULT_POLICY,
                         apply: bool = False, doc: str = "doc_id", page: str = "page_number",
                         source_name: str | None = None, durable: bool = True) -> RunResult:
    """Redact ``(doc, page, text)`` rows; with ``apply`` write the formats chosen in the policy."""
    started = now_text()
    red = redact_pages(pages, policy)
    if apply:
        if out_dir is None:
            raise ValueError("apply=True needs out_dir")
        red = kept_rows(red, durable)
        write_renders(red, out_dir, policy.formats, doc, page, source_name)
    findings = explode_entities(red, [doc], "entities")
    files = file_results(red.select(doc, "changed"), doc, count_by(findings, doc, "entity_type"), "pdf")
    if apply:
        files = kept_rows(files, durable)
        files.count()
        red.unpersist()
    return RunResult(uuid.uuid4().hex, started, now_text(), not apply, files, run_summary(files), findings)


def header_groups(heads: DataFrame) -> dict:
    """Files of ``file_headers`` grouped by their header: ``{header: [paths]}``; files without one are in no group.

    The paths reach the driver, since the CSV reader takes them from there.
    """
    groups: dict = {}
    for r in heads.where("header is not null").toLocalIterator():
        groups.setdefault(tuple(r["header"]), []).append(r["path"])
    return groups


def redact_folder(spark: SparkSession, folder: str, out_dir: str | None = None, policy: Policy = DEFAULT_POLICY,
                  recursive: bool = False, apply: bool = False, **kw) -> tuple[DataFrame, RunResult | None]:
    """Inventory a folder with the policy's globs, then redact every supported CSV file.

    Returns the inventory (every file with ``supported``/``skipped``) and the run
    (``None`` when no file is supported), whose results hold every supported file:
    PDF files fail with the reason, as only extracted page text is processed.
    Outputs mirror the folder: ``out_dir/<path below folder>``.  Other options
    are those of ``redact_csv_files``.
    """
    from scrub.sources.files import extension, inventory

    inv = inventory(spark, folder, recursive, policy.include_globs, policy.exclude_globs)
    if apply and out_dir is not None:
        guard_output(folder, out_dir, kw.get("force", False))
    supported = inv.where(F.col("status") == "supported").select(F.col("path").alias("input_path"), F.substr(extension(F.col("path")), F.lit(2)).alias("kind"))
    supported = kept_rows(supported, True)
    if supported.isEmpty():
        return inv, None
    csvs, others = supported.where(F.col("kind") == "csv").select("input_path"), supported.where(F.col("kind") != "csv")
    return inv, redact_csv_files(spark, csvs, out_dir, policy, apply, input_base=folder, others=others, **kw)
