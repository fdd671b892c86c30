"""Documents as pages: renders, the redaction map, tables in pages, writes and dry runs."""

import os
import tempfile

from pyspark.sql import functions as F

from scrub.operators.documents import (flatten_tables, pages_from_lines, preview_lines, redact_pages,
                                       redaction_map_json, render_md, render_txt, write_renders)

PAGE = "Account: 1234567890123456\nCard: 4111 1111 1111 9876\nJohn Doe, email: john@example.com"


def _pages(spark, text=PAGE):
    return redact_pages(spark.createDataFrame([("test.pdf", 1, text)], "doc_id string, page_number int, text string"))


def test_renders(spark):
    p = _pages(spark)
    txt = render_txt(p).first()["txt"]
    assert txt.startswith("=== Page 1 ===\n") and txt.endswith("\n\n")
    assert "4111 1111 1111 9876" not in txt and "9876" in txt
    md = render_md(p).first()["md"]
    assert md.startswith("# Sanitized: test.pdf\n\n> **Note:**") and "## Page 1\n\n" in md
    js = redaction_map_json(p).first()["json"]
    assert '"page_number":1' in js and "redacted_text_preview" in js


def test_pages_in_order_and_tables(spark):
    df = spark.createDataFrame([("d", 2, "second"), ("d", 1, "first")], "doc_id string, page_number int, text string")
    txt = render_txt(redact_pages(df)).first()["txt"]
    assert txt == "=== Page 1 ===\nfirst\n\n=== Page 2 ===\nsecond\n\n"
    t = spark.createDataFrame([([[["a", None, "c"], []]],)], "t array<array<array<string>>>")
    assert t.select(flatten_tables(F.col("t"))).first()[0] == "\na\t\tc"


def test_write_and_dry_run(spark):
    p = _pages(spark)
    out = tempfile.mkdtemp(prefix="scrub-test-") + "/out"
    written = write_renders(p, out, formats=("txt", "md", "json"))
    assert len(written) == 3 and all(os.path.isdir(w) for w in written)
    dry = tempfile.mkdtemp(prefix="scrub-test-") + "/none"
    render_txt(p).count()  # dry run: computed, not written
    assert not os.path.exists(dry)


def test_paging_and_line_preview(spark):
    df = spark.createDataFrame([(1, "a\nmail a@b.io\n\nz")], "doc_id int, text string")
    pages = pages_from_lines(df, "doc_id", "text").collect()
    assert [(r.page_number, r.text) for r in pages] == [(1, "a"), (2, "mail a@b.io"), (3, ""), (4, "z")]
    red = redact_pages(df.withColumnRenamed("text", "text"))
    diff = preview_lines(red, "doc_id", "text", "redacted").collect()
    assert [(r.line_no, r.after) for r in diff] == [(2, "mail [EMAIL_ADDRESS]")]


def test_write_renders_is_ordered_per_document(spark):
    df = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one 4111111111111234"), ("b", 1, "x")],
                               "doc_id string, page_number int, text string")
    out = tempfile.mkdtemp(prefix="scrub-test-") + "/r"
    write_renders(redact_pages(df), out, formats=("txt", "md"))
    import glob
    a_txt = "".join(open(f).read() for f in sorted(glob.glob(out + "/txt/doc_id=a/part-*")))
    assert a_txt == "=== Page 1 ===\none XXXXXXXXXXXX1234\n\n=== Page 2 ===\ntwo\n\n"
    a_md = "".join(open(f).read() for f in sorted(glob.glob(out + "/md/doc_id=a/part-*")))
    assert a_md.startswith("# Sanitized: a\n\n> **Note:**") and a_md.endswith("## Page 2\n\ntwo\n\n")


def test_text_files_as_paged_documents(spark):
    from scrub.operators.runs import redact_documents_run
    from scrub.sources.files import read_text_pages

    d = tempfile.mkdtemp(prefix="scrub-pages-")
    with open(d + "/a.txt", "w") as f:
        f.write("page one a@b.io\fpage two 4111111111111234")
    with open(d + "/b.txt", "w") as f:
        f.write("single page")
    pages = read_text_pages(spark, d)
    got = sorted((os.path.basename(r.doc), r.page_number, r.text) for r in pages.collect())
    assert got == [("a.txt", 1, "page one a@b.io"), ("a.txt", 2, "page two 4111111111111234"), ("b.txt", 1, "single page")]
    run = redact_documents_run(pages, doc="doc")
    assert {os.path.basename(r.input_path): r.rows_or_pages for r in run.files.collect()} == {"a.txt": 2, "b.txt": 1}


def test_preview_pages_limits_pages_not_redaction(spark):
    from scrub.operators.documents import preview_pages

    rows = [("d", p, f"page {p}\nmail a{p}@b.io") for p in range(1, 6)]
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, text string")
    got = sorted((r.page_number, r.line_no, r.after) for r in preview_pages(pages).collect())
    assert got == [(1, 2, "mail [EMAIL_ADDRESS]"), (2, 2, "mail [EMAIL_ADDRESS]"), (3, 2, "mail [EMAIL_ADDRESS]")]
