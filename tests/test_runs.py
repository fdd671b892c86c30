"""End-to-end runs: dry run writes nothing, apply writes and audits."""

import glob
import os
import tempfile

from scrub.operators.runs import redact_csv_files, redact_documents_run
from scrub.policy import Policy


HEADER = "branch,ref,paid from,reply to,remark\n"


def _csv_dir():
    """A file with quoted commas, quotes and line ends, empty cells, blanks at a cell's end and two numbers in one cell."""
    d = tempfile.mkdtemp(prefix="scrub-run-")
    with open(d + "/test.csv", "w") as f:
        f.write(HEADER + '"Quay, North",x7,2044518890 4000123412341234,till@shop.test,"says ""ok""\n at 9"\n'
                ",,7719046652 5100987654325678,,write to desk@shop.test \n")
    return d


def test_csv_dry_run_counts_without_writing(spark):
    d = _csv_dir()
    out = d + "/out"
    r = redact_csv_files(spark, d + "/test.csv", out, apply=False)
    assert r.dry_run and not os.path.exists(out)
    f = r.files.first()
    assert f.rows_or_pages == 2 and f.fields_changed == 4 and f.success
    assert f.entities_by_type == {"CARD_NUMBER": 2, "ACCOUNT_NUMBER": 2, "EMAIL_ADDRESS": 2}
    s = r.summary.first()
    assert (s.total_files, s.successful_files, s.failed_files, s.total_entities) == (1, 1, 0, 6)


def test_csv_apply_writes_redacted_file(spark):
    d = _csv_dir()
    out = d + "/out"
    redact_csv_files(spark, d + "/test.csv", out, Policy(sensitive_columns=("branch",)), apply=True,
                     report_dir=d + "/report", durable=True)
    text = "".join(open(p).read() for p in glob.glob(out + "/test.csv"))
    assert "4000123412341234" not in text and "XXXXXXXXXXXX1234" in text and "[REDACTED]" in text
    assert text.startswith(HEADER) and '"says ""ok""\n at 9"' in text and "write to [EMAIL_ADDRESS] \n" in text
    assert os.path.isdir(d + "/report/files") and os.path.isdir(d + "/report/summary")


def test_documents_run(spark):
    pages = spark.createDataFrame([("test.pdf", 1, "Card: 4111 1111 1111 9876")],
                                  "doc_id string, page_number int, text string")
    out = tempfile.mkdtemp(prefix="scrub-run-") + "/out"
    dry = redact_documents_run(pages, out, apply=False)
    assert not os.path.exists(out) and dry.files.first().rows_or_pages == 1
    redact_documents_run(pages, out, apply=True)
    txt = "".join(open(p).read() for p in glob.glob(out + "/txt/doc_id=test.pdf/part-*"))
    assert "4111 1111 1111 9876" not in txt and "9876" in txt
    assert glob.glob(out + "/md/doc_id=test.pdf/part-*") and glob.glob(out + "/json/doc_id=test.pdf/part-*")


def test_csv_run_over_several_files(spark):
    d = _csv_dir()
    with open(d + "/other.csv", "w") as f:
        f.write(HEADER + "Al,,,,1.00\n")
    r = redact_csv_files(spark, [d + "/test.csv", d + "/other.csv"])
    got = {os.path.basename(x.input_path): (x.rows_or_pages, x.fields_changed) for x in r.files.collect()}
    assert got == {"test.csv": (2, 4), "other.csv": (1, 0)}
    s = r.summary.first()
    assert (s.total_files, s.successful_files, s.rows_or_pages) == (2, 2, 3)


def test_apply_counts_during_the_write(spark):
    d = _csv_dir()
    r = redact_csv_files(spark, d + "/test.csv", d + "/out", apply=True)
    o = r.observed
    assert r.files.first().output_paths == [d + "/out/test.csv"]
    assert (o["rows"], o["fields_changed"]) == (2, 4)
    assert (o["CARD_NUMBER"], o["ACCOUNT_NUMBER"], o["EMAIL_ADDRESS"], o["PHONE_NUMBER"]) == (2, 2, 2, 0)
    per_file = r.files.first().entities_by_type
    assert all(o[k] == v for k, v in per_file.items())


def test_csv_run_hashes_inputs(spark):
    import hashlib

    d = _csv_dir()
    r = redact_csv_files(spark, d + "/test.csv", hashes=True)
    want = hashlib.sha256(open(d + "/test.csv", "rb").read()).hexdigest()
    assert r.files.first().input_hash == want


def test_redact_folder(spark):
    from scrub.operators.runs import redact_folder

    d = _csv_dir()
    with open(d + "/notes.txt", "w") as f:
        f.write("a@b.io")
    with open(d + "/archive_old.csv", "w") as f:
        f.write("name\nx\n")
    inv, run = redact_folder(spark, d, policy=Policy(exclude_globs=("archive_*",)))
    status = {r.name: r.status for r in inv.collect()}
    assert status == {"test.csv": "supported", "notes.txt": "skipped", "archive_old.csv": "skipped"}
    assert [os.path.basename(r.input_path) for r in run.files.collect()] == ["test.csv"]


def test_file_with_surplus_fields_fails_and_the_run_goes_on(spark):
    d = _csv_dir()
    with open(d + "/bad.csv", "w") as f:
        f.write(HEADER + "A,1,2,3,4,SURPLUS\nB,,,,\n")
    with open(d + "/short.csv", "w") as f:
        f.write(HEADER + "C,1234567890\n")
    r = redact_csv_files(spark, [d + "/test.csv", d + "/bad.csv", d + "/short.csv"], d + "/out", apply=True)
    got = {os.path.basename(x.input_path): (x.success, x.rows_or_pages, x.error) for x in r.files.collect()}
    assert got["bad.csv"] == (False, 0, "a row has more fields than the header")
    assert got["test.csv"][:2] == (True, 2) and got["short.csv"][:2] == (True, 1)
    assert glob.glob(d + "/out/test.csv") and glob.glob(d + "/out/short.csv")
    assert not glob.glob(d + "/out/bad.csv")
    s = r.summary.first()
    assert (s.total_files, s.successful_files, s.failed_files) == (3, 2, 1)


def test_folder_with_mixed_headers(spark):
    from scrub.operators.runs import redact_folder

    d = _csv_dir()
    open(d + "/empty.csv", "w").close()
    with open(d + "/people.csv", "w") as f:
        f.write("email,name\nx@y.io,Zed\n")
    inv, run = redact_folder(spark, d, d + "/out", apply=True, report_dir=d + "/report")
    from scrub.sources.files import load_report

    files, summary = load_report(spark, d + "/report")
    assert files.count() == 3 and summary.first().total_files == 3
    got = {os.path.basename(r.input_path): (r.rows_or_pages, r.entities_by_type) for r in run.files.collect()}
    assert got["people.csv"] == (1, {"EMAIL_ADDRESS": 1})
    failed = {os.path.basename(r.input_path): r.error for r in run.files.where("not success").collect()}
    assert failed == {"empty.csv": "no header line (empty file)"}
    assert run.summary.first().failed_files == 1
    assert got["test.csv"][0] == 2
    text = "".join(open(p).read() for p in glob.glob(d + "/out/people.csv"))
    assert text.splitlines() == ["email,name", "[EMAIL_ADDRESS],Zed"]
    assert run.observed["rows"] == 3


def test_header_groups(spark):
    from scrub.operators.runs import header_groups
    from scrub.sources.listing import file_headers, walk

    d = tempfile.mkdtemp(prefix="scrub-hdr-")
    for name, body in [("a.csv", "x,y\n1,2\n"), ("b.csv", "x,y\n3,4\n"), ("c.csv", 'y,"x, quoted"\n5,6\n'),
                       ("empty.csv", "x,y\n")]:
        with open(f"{d}/{name}", "w") as f:
            f.write(body)
    groups = header_groups(file_headers(walk(spark, d + "/*.csv").select("path")))
    named = {k: sorted(os.path.basename(p) for p in v) for k, v in groups.items()}
    assert named == {("x", "y"): ["a.csv", "b.csv", "empty.csv"], ("y", "x, quoted"): ["c.csv"]}


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def _out(pattern):
    return "".join(open(p).read() for p in sorted(glob.glob(pattern))).splitlines()


def test_files_are_read_by_their_own_header(spark):
    d = tempfile.mkdtemp(prefix="scrub-run-")
    _write(d + "/in/a.csv", "name,ssn\nAda,123-45-6789\n")
    _write(d + "/in/b.csv", "ssn,name\n987-65-4321,Bo\n")
    redact_csv_files(spark, [d + "/in/a.csv", d + "/in/b.csv"], d + "/out", Policy(sensitive_columns=("ssn",)), apply=True)
    assert _out(d + "/out/a.csv") == ["name,ssn", "Ada,[REDACTED]"]
    assert _out(d + "/out/b.csv") == ["ssn,name", "[REDACTED],Bo"]


def test_any_header_and_cells_as_they_were(spark):
    d = tempfile.mkdtemp(prefix="scrub-run-")
    _write(d + "/in/p/x.csv", 'source,file,Acct. No.,Payee\'s,_source\n"  padded  ",f1,`a.b`,x@y.io,NA\n')
    _write(d + "/in/q/x.csv", "id,id,\n1,2,z@y.io\n")
    from scrub.operators.runs import redact_folder
    from scrub.operators.tables import changed_per_column

    _, run = redact_folder(spark, d + "/in", d + "/out", recursive=True, apply=True, null_tokens=("NA",))
    assert _out(d + "/out/p/x.csv") == ["source,file,Acct. No.,Payee's,_source", '  padded  ,f1,`a.b`,[EMAIL_ADDRESS],']
    assert _out(d + "/out/q/x.csv") == ["id,id.1,Unnamed: 2", "1,2,[EMAIL_ADDRESS]"]
    assert sorted(r.output_paths[0] for r in run.files.collect()) == [d + "/out/p/x.csv", d + "/out/q/x.csv"]
    assert {(os.path.basename(r.source), r.column_name) for r in run.findings.collect()} == {("x.csv", "Payee's"), ("x.csv", "Unnamed: 2")}
    df = spark.createDataFrame([("x@y.io", "b@c.de", None)], "`Payee's` string, `a.b` string, `c,d` string")
    assert {tuple(r) for r in changed_per_column(df).collect()} == {("Payee's", 1), ("a.b", 1), ("c,d", 0)}


def test_every_listed_file_has_a_result(spark):
    from scrub.operators.runs import redact_folder
    from scrub.sources.files import load_report

    d = _csv_dir()
    _write(d + "/in/only_header.csv", "a,b\n")
    _write(d + "/in/nothing.csv", "")
    _write(d + "/in/scan.pdf", "%PDF")
    _write(d + "/in/sur plus+1.csv", 'a,b\n"x,""y",2,3\n')
    _write(d + "/in/good.csv", 'a,b\n"x,""y",z@y.io\n')
    _, run = redact_folder(spark, d + "/in", d + "/out", apply=True, report_dir=d + "/report", hashes=True)
    got = {os.path.basename(r.input_path): (r.success, r.rows_or_pages, r.error and r.error[:12]) for r in run.files.collect()}
    assert got == {"only_header.csv": (True, 0, None), "nothing.csv": (False, 0, "no header li"), "scan.pdf": (False, 0, "only extract"),
                   "sur plus+1.csv": (False, 0, "a row has mo"), "good.csv": (True, 1, None)}
    assert _out(d + "/out/good.csv") == ["a,b", '"x,""y",[EMAIL_ADDRESS]']
    files, summary = load_report(spark, d + "/report")
    s = summary.first()
    assert (s.total_files, s.successful_files, s.failed_files, s.aggregate_entities) == (5, 2, 3, {"EMAIL_ADDRESS": 1})
    assert s.run_id == run.run_id and s.dry_run is False and s.started_at <= s.completed_at
    import hashlib

    part = d + "/out/good.csv"
    assert _out(d + "/out/only_header.csv") == ["a,b"]
    good = files.where("input_path like '%good.csv'").first()
    assert good.output_hash == hashlib.sha256(open(part, "rb").read()).hexdigest() and good.input_hash


def test_output_over_the_input_is_refused(spark):
    import pytest

    from scrub.operators.runs import redact_folder
    from scrub.sources.files import OverwriteError

    d = _csv_dir()
    for out in (d, d + "/", "file://" + d, os.path.dirname(d)):
        with pytest.raises(OverwriteError):
            redact_folder(spark, d, out, apply=True)
        with pytest.raises(OverwriteError):
            redact_csv_files(spark, d + "/test.csv", out, apply=True)


def test_no_report_when_the_policy_says_so(spark):
    d = _csv_dir()
    redact_csv_files(spark, d + "/test.csv", d + "/out", Policy.from_config({"create_audit_report": False}), apply=True, report_dir=d + "/r")
    assert not os.path.exists(d + "/r")


def test_stream_reads_by_header_name(spark):
    from scrub.streaming.folder import redact_folder_stream

    d = tempfile.mkdtemp(prefix="scrub-run-")
    _write(d + "/in/a.csv", "name,ssn\nAda,123-45-6789\n")
    _write(d + "/in/b.csv", "ssn,more,name\n987-65-4321,m,Bo\n")
    q = redact_folder_stream(spark, d + "/in", d + "/out", d + "/ckpt", ["name", "ssn"], Policy(sensitive_columns=("ssn",)))
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(d + "/out").select("name", "ssn").collect()) == [("Ada", "[REDACTED]"), ("Bo", "[REDACTED]")]


def test_cached_trees_are_kept_apart(spark):
    from pyspark.sql import functions as F

    from scrub.operators.redact import redact_text

    df = spark.createDataFrame([("x@y.io", ("plain",))], "`a, b` string, a struct<b:string>")
    r = df.select(redact_text(F.col("a.b"), Policy()).alias("s"), redact_text(F.col("`a, b`"), Policy()).alias("t")).first()
    assert (r.s, r.t) == ("plain", "[EMAIL_ADDRESS]")


def test_stream_has_a_result_for_every_file_across_a_restart(spark):
    from scrub.streaming.folder import redact_folder_stream, stream_files

    d = tempfile.mkdtemp(prefix="scrub-run-")
    how = Policy(sensitive_columns=("ssn",))
    go = lambda: redact_folder_stream(spark, d + "/in", d + "/out", d + "/ckpt", ["name", "ssn", "id"], how, keep=["id"], max_files_per_trigger=1).awaitTermination()
    _write(d + "/in/a.csv", "id,name,ssn\n8888888888,x@y.io,123-45-6789\n")
    _write(d + "/in/surplus.csv", "name,ssn\nA,1\nB,c@d.com,EXTRA\n")
    go()
    first = {(os.path.basename(r.input_path), r.batch) for r in stream_files(spark, d + "/out").collect()}
    _write(d + "/in/other.csv", "colour,shape\nred,round\n")
    _write(d + "/in/empty.csv", "\n")
    _write(d + "/in/b.csv", "ssn,more,name\n,m,Bo\n")
    go()
    go()
    files = stream_files(spark, d + "/out").collect()
    got = {os.path.basename(r.input_path): (r.success, r.rows_or_pages, r.fields_changed, r.entities_by_type, r.error) for r in files}
    assert len(files) == 5 and first <= {(os.path.basename(r.input_path), r.batch) for r in files}
    assert got["a.csv"] == (True, 1, 2, {"EMAIL_ADDRESS": 1, "FULL_COLUMN_REDACTION": 1}, None) and got["b.csv"] == (True, 1, 0, {}, None)
    assert got["surplus.csv"] == (False, 0, 0, {}, "a row has more fields than the header")
    assert got["other.csv"][4] == "the header has none of the wanted columns" and got["empty.csv"][4] == "no header line (empty file)"
    rows = spark.read.parquet(d + "/out").select("name", "ssn", "id").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("[EMAIL_ADDRESS]", "[REDACTED]", "8888888888"), ("Bo", None, None)], key=str)
    batch = redact_csv_files(spark, [d + f"/in/{n}.csv" for n in ("a", "surplus", "b")], policy=how).files
    for r in batch.collect():
        n = os.path.basename(r.input_path)
        assert got[n][0] == r.success and got[n][4] == r.error and got[n][1] == r.rows_or_pages
