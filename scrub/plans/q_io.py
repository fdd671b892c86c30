"""Registered queries: CSV round trips, inventories, fingerprints, paths, reports, streams, UDF hook.

Queries that exercise a sink first write Spark-derived data to a fresh folder
under the session's checkpoint folder, then read it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrub.functions import rules as R
from scrub.functions.arrays import explode_kept
from scrub.functions.detector import model_detector, regex_detector
from scrub.operators.audit import run_summary
from scrub.operators.runs import RunResult, now_text, redact_csv_files, redact_folder, report_summary
from scrub.operators.tables import redact_table
from scrub.plans import sqlgen as S
from scrub.plans import sqlpipe as SP
from scrub.plans.catalog import scratch_dir, stmt, table
from scrub.plans.q_audit import COUNTS, FILES, PIPE, _files, _redacted
from scrub.plans.q_detect import _sql as detect_sql
from scrub.plans.registry import ORACLE_SQL, query
from scrub.policy import DEFAULT_POLICY
from scrub.sources.files import (base_name, csv_writer, file_status, fingerprints, inventory, is_supported, load_report,
                                 output_path, read_csv_strings, row_fingerprint, save_report, write_csv)
from scrub.sources.listing import qualified, walk
from scrub.sources.mirrored import join_pieces
from scrub.streaming.folder import redact_folder_stream, stream_files

W = S.stmt_cte()
KEY = "o_orderkey"
COLS = S.STMT_COLUMNS
_ALL_STR = ", ".join([f"cast({KEY} as varchar) as {KEY}"] + list(S.STMT_TEXT_COLUMNS))


#: Rows of a table that one task writes.
TASK_ROWS = 250_000


def _tasks(df, least=1):
    """So many tasks to write a table, a multiple of ``least``."""
    return least * max(1, -(-df.count() // (least * TASK_ROWS)))


def _stmt_csv(spark, sf, name, n_files=4):
    path, s = scratch_dir(spark, name), stmt(spark, sf)
    write_csv(s.repartition(_tasks(s, n_files)), path)
    return path


def _join_csv(df, root, names, tasks):
    """CSV files ``root/<name>`` of all rows: ``tasks`` write pieces, which are dealt to the files and put in a row below a header."""
    spark = df.sparkSession
    root = qualified(spark, root).rstrip("/")
    work = f"{root}/_work-{uuid.uuid4().hex}"
    spark.createDataFrame([(",".join(df.columns),)], "value string").coalesce(1).write.text(f"{work}/head")
    csv_writer(df.repartition(tasks)).option("header", False).csv(f"{work}/rows")
    number = F.regexp_extract("path", "/part-([0-9]+)-[^/]*$", 1).cast("int")
    which = F.array(*map(F.lit, names))[number % len(names)]
    pieces = walk(spark, f"{work}/rows").select(which.alias("file"), "path").groupBy("file").agg(F.sort_array(F.collect_list("path")).alias("p"))
    head = F.array(*[F.lit(r.path) for r in walk(spark, f"{work}/head").collect()])  # one path
    join_pieces(pieces.select("file", F.concat(head, "p").alias("pieces")), root, work)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(work)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@query("src_csv_strings", f"with {W} select {_ALL_STR} from stmt")
def q_src_csv_strings(spark, sf):
    return read_csv_strings(spark, _stmt_csv(spark, sf, "csv-in"))


def _redacted_sql():
    cells = ", ".join(f"{SP.cell_sql(c, DEFAULT_POLICY)} as {c}" for c in S.STMT_TEXT_COLUMNS)
    return f"with {W} select cast({KEY} as varchar) as {KEY}, {cells} from stmt"


@query("sink_csv_roundtrip", _redacted_sql())
def q_sink_csv_roundtrip(spark, sf):
    src = read_csv_strings(spark, _stmt_csv(spark, sf, "csv-src"))
    out = scratch_dir(spark, "csv-out")
    write_csv(redact_table(src, DEFAULT_POLICY, keep=[KEY]), out)
    return read_csv_strings(spark, out)


@query("stream_redact", _redacted_sql())
def q_stream_redact(spark, sf):
    src, s = scratch_dir(spark, "stream-in"), stmt(spark, sf)
    tasks = _tasks(s, 6)
    if tasks == 6:
        write_csv(s.repartition(6), src)
    else:
        _join_csv(s, src, [f"part-{k}.csv" for k in range(6)], tasks)
    out, ckpt = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-ckpt")
    q = redact_folder_stream(spark, src, out, ckpt, COLS, DEFAULT_POLICY, keep=[KEY], max_files_per_trigger=2)
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query("row_fingerprint", "select doc_id, sha256(text) as sha256 from documents")
def q_row_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", row_fingerprint(F.col("text")).alias("sha256"))


#: Documents of one file in the fingerprint query, by doc_id.
FILE_DOCS = 1_000


@query("file_fingerprint", f"""select source, lot, strlen(body)::bigint as length, sha256(body) as sha256
from (select source, doc_id // {FILE_DOCS} as lot, string_agg(coalesce(text, '') || chr(10), '' order by doc_id) as body
      from documents group by source, doc_id // {FILE_DOCS})""")
def q_file_fingerprint(spark, sf):
    """Text files of a source's documents with neighbouring ids, in their order; the hashes of the files' bytes."""
    path = scratch_dir(spark, "fingerprint")
    d = table(spark, sf, "documents").select("source", F.expr(f"doc_id div {FILE_DOCS}").alias("lot"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartition("source", "lot").sortWithinPartitions("source", "lot", "doc_id")
    d.select("source", "lot", "text").write.partitionBy("source", "lot").text(path)
    fp = fingerprints(spark, f"{path}/source=*/lot=*/part-*")
    return fp.select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), F.regexp_extract("path", "lot=([0-9]+)/", 1).cast("long").alias("lot"), "length", "sha256")


@query("folder_sizes", """select lang, source, sum(strlen(coalesce(text, '')) + 1)::bigint as bytes from documents group by lang, source""")
def q_folder_sizes(spark, sf):
    """A tree of text files two folders deep, several files a folder, listed by tasks; the bytes below each folder."""
    path = scratch_dir(spark, "folder-sizes")
    d = table(spark, sf, "documents").select("lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    d.write.partitionBy("lang", "source").option("maxRecordsPerFile", FILE_DOCS).text(path)
    parts = F.split("rel_path", "/")
    listed = inventory(spark, path, recursive=True, include_globs=("part-*",)).select(
        F.substr(parts[0], F.lit(6)).alias("lang"), F.substr(parts[1], F.lit(8)).alias("source"), "length")
    return listed.groupBy("lang", "source").agg(F.sum("length").alias("bytes"))


# Derived file names: one per document, the extension chosen by language.
_NAME = ("source || '_' || cast(doc_id as varchar) || case lang when 'en' then '.csv' when 'fr' then '.PDF' "
         "when 'de' then '.txt' else '.xlsx' end")


def _named_docs(spark, sf):
    d = table(spark, sf, "documents")
    ext = (F.when(F.col("lang") == "en", ".csv").when(F.col("lang") == "fr", ".PDF")
           .when(F.col("lang") == "de", ".txt").otherwise(".xlsx"))
    return d.select("doc_id", F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), ext).alias("name"))


@query("supported_types", f"""select doc_id, {_NAME} as name,
  lower(regexp_extract({_NAME}, '(\\.[^./]+)$', 1)) in ('.csv', '.pdf') as supported from documents""")
def q_supported_types(spark, sf):
    n = _named_docs(spark, sf)
    return n.select("doc_id", "name", is_supported(F.col("name")).alias("supported"))


INCLUDE, EXCLUDE = ("*.csv", "*.pdf"), ("src1_*", "src?_1?.csv")


@query("glob_filter", f"""select doc_id, {_NAME} as name,
  case when not (regexp_matches({_NAME}, '^src1_.*$') or regexp_matches({_NAME}, '^src._1.\\.csv$'))
        and (regexp_matches({_NAME}, '^.*\\.csv$') or regexp_matches({_NAME}, '^.*\\.pdf$'))
        and lower(regexp_extract({_NAME}, '(\\.[^./]+)$', 1)) in ('.csv', '.pdf')
       then 'supported' else 'skipped' end as status
from documents""")
def q_glob_filter(spark, sf):
    n = _named_docs(spark, sf)
    return n.select("doc_id", "name", file_status(F.col("name"), F.col("name"), INCLUDE, EXCLUDE).alias("status"))


_PATH = ("case when lang = 'en' then '/data/in/' else '/archive/' end || source || '/' || cast(doc_id as varchar) "
         "|| '.csv'")


@query("output_paths", f"""select doc_id, {_PATH} as input_path,
  case when starts_with({_PATH}, '/data/in/') then '/data/out' || substring({_PATH}, 9)
       else '/data/out/' || regexp_extract({_PATH}, '([^/]*)$', 1) end as output_path from documents""")
def q_output_paths(spark, sf):
    d = table(spark, sf, "documents")
    p = F.concat(F.when(F.col("lang") == "en", "/data/in/").otherwise("/archive/"), F.col("source"), F.lit("/"),
                 F.col("doc_id").cast("string"), F.lit(".csv"))
    return d.select("doc_id", p.alias("input_path"), output_path(p, "/data/in", "/data/out").alias("output_path"))


_TOP = ("nation", "region", "customer", "supplier")


@query("src_folder_inventory", """with t as (select unnest(['nation', 'region', 'customer', 'supplier']) as t),
  f as (select t || '.csv' as rel_path from t union all select 'deep/' || t || '.csv' from t union all select 'deep/er/' || t || '_old.csv' from t
        union all select 'x.PDF' union all select 'y.pdf' union all select 'notes.txt')
select rel_path, regexp_extract(rel_path, '([^/]*)$', 1) as name, rel_path = 'x.PDF' or rel_path = 'y.pdf' or rel_path = 'notes.txt' as is_empty,
       case when rel_path like '%_old.csv' or rel_path in ('x.PDF', 'notes.txt') then 'skipped' else 'supported' end as status from f""")
def q_src_folder_inventory(spark, sf):
    """Files of known names in three folders, some without a byte; upper-case suffixes and excluded names are skipped."""
    root = scratch_dir(spark, "inventory")
    for t in _TOP:
        df = table(spark, sf, t)
        for path in (f"{t}.csv", f"deep/{t}.csv", f"deep/er/{t}_old.csv"):
            _put_csv(df, f"{root}/{path}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("x.PDF", "y.pdf", "notes.txt"):
        fs.create(hadoop.Path(f"{root}/{name}")).close()
    found = inventory(spark, root, recursive=True, exclude_globs=("*_old.csv",))
    return found.select("rel_path", "name", (F.col("length") == 0).alias("is_empty"), "status")


@query("report_roundtrip", f"""with {PIPE}, {FILES}, {COUNTS}
select source as input_path, success, cast(rows_or_pages as bigint) as rows_or_pages, fields_changed, null as entity_type, null::bigint as n from files
union all select source, null, null, null, entity_type, n from counts
union all select null, null, null, null, entity_type, sum(n)::bigint from counts group by entity_type
union all select null, null, count(*), null, 'total_files', count_if(success) from files""")
def q_report_roundtrip(spark, sf):
    """A report saved and loaded: file results, their counts by type, the counts of the whole run, its file totals."""
    files = _files(_redacted(spark, sf))
    now = now_text()
    run = RunResult("run", now, now, False, files, run_summary(files), files)
    full = files.select(*[F.col(f.name) if f.name in files.columns else F.lit(None).cast(f.dataType).alias(f.name)
                          for f in file_results_schema()])
    path = scratch_dir(spark, "report")
    save_report(full, report_summary(run), path)
    back, summary = load_report(spark, path)
    parts = [
        back.select("input_path", "success", "rows_or_pages", "fields_changed"),
        back.select("input_path", F.explode("entities_by_type").alias("entity_type", "n")),
        summary.select(F.explode("aggregate_entities").alias("entity_type", "n")),
        summary.select(F.col("total_files").alias("rows_or_pages"), F.lit("total_files").alias("entity_type"), F.col("successful_files").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def file_results_schema():
    from scrub.operators.audit import FILE_RESULT_TYPE

    return FILE_RESULT_TYPE.fields


def _put_csv(df, path):
    """One CSV file of exactly this path."""
    spark = df.sparkSession
    if (tasks := _tasks(df)) > 1:
        folder, _, name = path.rpartition("/")
        _join_csv(df, folder, [name], tasks)
        return
    tmp = path + ".parts"
    write_csv(df.coalesce(1), tmp)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(hadoop.Path(tmp)) if f.getPath().getName().startswith("part-"))
    fs.rename(part, hadoop.Path(path))
    fs.delete(hadoop.Path(tmp), True)


RUN_POLICY = DEFAULT_POLICY.with_(sensitive_columns=("source",))
_RUN_CELLS = {c: SP.cell_sql(c, RUN_POLICY) for c in ("o_orderkey", "acct", "email", "source")}


@query("run_csv_folder", f"""with {W},
  given as (select case when o_orderkey % 2 = 0 then 'a/x.csv' else 'b/x.csv' end as file, cast(o_orderkey as varchar) as o_orderkey,
                   account_number as acct, email, '  ' || name || ' ' as source from stmt),
  done as (select file, {", ".join(f"{c} as before_{c}, {sql} as {c}" for c, sql in _RUN_CELLS.items())} from given),
  files as (select file, count(*) as rows_or_pages, sum({" + ".join(f"(before_{c} is distinct from {c})::int" for c in _RUN_CELLS)})::bigint as fields_changed
            from done group by file)
select file, o_orderkey, acct, email, source, null::boolean as success, null::bigint as rows_or_pages, null::bigint as fields_changed from done
union all select file, null, null, null, null, true, rows_or_pages, fields_changed from files
union all select * from (values ('c/head.csv', null, null, null, null, true, 0, 0), ('c/surplus.csv', null, null, null, null, false, 0, 0),
                                ('c/scan.pdf', null, null, null, null, false, 0, 0))""")
def q_run_csv_folder(spark, sf):
    """A folder run end to end: two column orders, equal names in two folders, odd headers, padded cells, a header alone, a surplus field, a PDF."""
    root, out = scratch_dir(spark, "run-in"), scratch_dir(spark, "run-out")
    s = stmt(spark, sf).select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("account_number").alias("Acct. No."), "email",
                               F.concat(F.lit("  "), F.col("name"), F.lit(" ")).alias("source"))
    even = F.col("o_orderkey").cast("long") % 2 == 0
    _put_csv(s.where(even), f"{root}/a/x.csv")
    _put_csv(s.where(~even).select("source", "email", "`Acct. No.`", "o_orderkey"), f"{root}/b/x.csv")
    _put_csv(s.limit(0), f"{root}/c/head.csv")
    line = table(spark, sf, "region").select(F.concat(F.lit("email,source\n"), F.concat_ws(",", "r_name", "r_name", "r_name")))
    line.coalesce(1).write.text(f"{root}/c.parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(hadoop.Path(f"{root}/c.parts")) if f.getPath().getName().startswith("part-"))
    fs.rename(part, hadoop.Path(f"{root}/c/surplus.csv"))
    fs.create(hadoop.Path(f"{root}/c/scan.pdf")).close()
    fs.delete(hadoop.Path(f"{root}/c.parts"), True)
    _, run = redact_folder(spark, root, out, RUN_POLICY, recursive=True, apply=True)
    name = F.regexp_extract("input_path", "([^/]+/[^/]+)$", 1)
    results = run.files.select(name.alias("file"), "success", "rows_or_pages", "fields_changed")
    cells = None
    for f in ("a/x.csv", "b/x.csv"):
        back = read_csv_strings(spark, f"{out}/{f}")
        back = back.select(F.lit(f).alias("file"), "o_orderkey", F.col("`Acct. No.`").alias("acct"), "email", "source")
        cells = back if cells is None else cells.unionByName(back)
    every = cells.unionByName(results, allowMissingColumns=True)
    return every.select("file", "o_orderkey", "acct", "email", "source", "success", "rows_or_pages", "fields_changed")


def _write_lines(lines, path):
    """One text file of exactly this path holding the lines of a small table."""
    spark = lines.sparkSession
    lines.coalesce(1).write.text(path + ".parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(hadoop.Path(path + ".parts")) if f.getPath().getName().startswith("part-"))
    fs.rename(part, hadoop.Path(path))
    fs.delete(hadoop.Path(path + ".parts"), True)


# Orders as lines of three kinds by their key: sound ones, some with a field too many (two files of ten), short ones.
_LINE_FILE = "'f' || cast(o_orderkey % 10 as varchar) || '.csv'"


@query("bad_records", f"""
with d as (select {_LINE_FILE} as file, o_orderkey, 'o' || o_orderkey || '@shop.test' as email,
                  o_orderkey % 10 in (3, 7) and o_orderkey % 70 in (3, 7) as surplus, o_orderkey % 10 = 5 as short from orders),
  f as (select file, not bool_or(surplus) as success, count(*) as n, count(*) filter (not short) as changed from d group by file)
select file, success, case when success then n else 0 end as rows_or_pages, case when success then changed else 0 end::bigint as fields_changed,
       case when not success then 'a row has more fields than the header' end as error from f""")
def q_bad_records(spark, sf):
    """Ten files, two of which hold lines with a field too many: these fail, the others, short lines included, are redacted."""
    path = scratch_dir(spark, "bad-records")
    key = F.col("o_orderkey")
    ten = (key % 10).cast("string")
    email = F.concat(F.lit("o"), key.cast("string"), F.lit("@shop.test"))
    line = (
        F.when((key % 70).isin(3, 7), F.concat_ws(",", key.cast("string"), email, F.col("o_orderstatus"), F.lit("surplus")))
        .when(key % 10 == 5, key.cast("string"))
        .otherwise(F.concat_ws(",", key.cast("string"), email, F.col("o_orderstatus")))
    )
    o = table(spark, sf, "orders").select(F.concat(F.lit("f"), ten, F.lit(".csv")).alias("name"), line.alias("value"))
    head = spark.createDataFrame([("o_orderkey,email,o_orderstatus",)], "value string")
    for r in o.select("name").distinct().collect():  # ten names, whatever the table's size
        _write_lines(head.union(o.where(F.col("name") == r.name).select("value")), f"{path}/{r.name}")
    run = redact_csv_files(spark, f"{path}/*.csv", policy=DEFAULT_POLICY)
    return run.files.select(base_name(F.col("input_path")).alias("file"), "success", "rows_or_pages", "fields_changed", "error")


_STREAM_CELLS = {c: SP.cell_sql(c, DEFAULT_POLICY) for c in ("email", "account_number")}


@query("stream_ledger", f"""
with {W}, d as (select case when o_orderkey % 3 = 0 then 'a.csv' else 'b.csv' end as file, email, account_number, {", ".join(f"{sql} as r_{c}" for c, sql in _STREAM_CELLS.items())} from stmt)
select file, true as success, count(*) as rows_or_pages,
       sum((email is distinct from r_email)::int + (account_number is distinct from r_account_number)::int)::bigint as fields_changed, null as error from d group by file
union all select * from (values ('surplus.csv', false, 0, 0, 'a row has more fields than the header'),
                                ('other.csv', false, 0, 0, 'the header has none of the wanted columns'),
                                ('empty.csv', false, 0, 0, 'no header line (empty file)'))""")
def q_stream_ledger(spark, sf):
    """Files that come in two goes, the stream ended between: each has one result, whichever micro-batch read it."""
    root, out, ckpt = (scratch_dir(spark, x) for x in ("ledger-in", "ledger-out", "ledger-ckpt"))
    s = stmt(spark, sf).select("o_orderkey", "email", "account_number")
    third = F.col("o_orderkey") % 3 == 0
    region = table(spark, sf, "region")

    def go():
        redact_folder_stream(spark, root, out, ckpt, ["email", "account_number"], DEFAULT_POLICY, max_files_per_trigger=2, pattern="*.csv").awaitTermination()

    _put_csv(s.where(third).drop("o_orderkey"), f"{root}/a.csv")
    _write_lines(region.select(F.concat(F.lit("email,account_number\n"), F.concat_ws(",", "r_name", "r_name", "r_name"))), f"{root}/surplus.csv")
    go()
    _put_csv(s.where(~third).select("account_number", "o_orderkey", "email"), f"{root}/b.csv")
    _write_lines(region.select(F.concat(F.lit("r_name,r_comment\n"), F.concat_ws(",", "r_name", "r_name"))), f"{root}/other.csv")
    _write_lines(region.agg(F.lit("").alias("value")), f"{root}/empty.csv")
    go()
    return stream_files(spark, out).select(base_name(F.col("input_path")).alias("file"), "success", "rows_or_pages", "fields_changed", "error")


EMAIL_DETECTOR = regex_detector(R.EMAIL_RE, R.EMAIL_ADDRESS, 1.0)


@query("udf_detector", f"select doc_id, entity_type, start_pos, end_pos, score from "
                       f"({detect_sql('documents', 'doc_id', 'text', R.BUILTIN_BY_TYPE[R.EMAIL_ADDRESS])})")
def q_udf_detector(spark, sf):
    d = table(spark, sf, "documents")
    found = explode_kept(d, ["doc_id"], EMAIL_DETECTOR(F.col("text")), "e")
    return found.select("doc_id", F.col("e.entity_type").alias("entity_type"), F.col("e.start").alias("start_pos"),
                        F.col("e.end").alias("end_pos"), F.col("e.score").alias("score"))


def _load_email():
    import re

    return re.compile(R.EMAIL_RE)


def _emails(model, texts):
    return [[(R.EMAIL_ADDRESS, m.start(), m.end(), 1.0) for m in model.finditer(t)] for t in texts]


EMAIL_MODEL = model_detector(_load_email, _emails)


@query("udf_model_detector", ORACLE_SQL["udf_detector"])
def q_udf_model_detector(spark, sf):
    """The hook for models: set up once a worker process, asked in batches of texts."""
    found = explode_kept(table(spark, sf, "documents"), ["doc_id"], EMAIL_MODEL(F.col("text")), "e")
    return found.select("doc_id", F.col("e.entity_type").alias("entity_type"), F.col("e.start").alias("start_pos"),
                        F.col("e.end").alias("end_pos"), F.col("e.score").alias("score"))
