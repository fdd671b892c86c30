"""File sources and sinks: CSV as all-string tables, folder inventory, fingerprints, paths, reports.

Everything is a Spark reader or writer.  Many files are read with one
multi-path load (files become splits, ``source`` comes from
``_metadata.file_path``), never with a driver-side loop.
"""

from __future__ import annotations

import os
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrub.names import col, fresh
from scrub.operators.audit import FILE_RESULT_TYPE, SUMMARY_TYPE
from scrub.policy import DEFAULT_INCLUDE_GLOBS, SUPPORTED_EXTENSIONS
from scrub.sources.listing import file_hashes, qualified, walk


class OverwriteError(ValueError):
    """Output would overwrite the input."""


# ---------------------------------------------------------------- CSV
# Tokens pandas reads as missing by default; pass them as ``null_tokens`` to
# read CSV files the way a pandas-based tool would.  Fixed values.
PANDAS_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


#: Files above this many bytes are looked through for line ends in quotes, so that several tasks can read one.
LARGE = 8 << 20

_CELL = r'(?:"(?:[^"\r\x00]++|"")*+"|[^",\r\x00]*+)'
#: A line that is a whole record, however it is read: cells without quotes, or quoted from end to end; not just blanks.
PLAIN_LINE = rf"^(?![\x00-\x20]+\z){_CELL}(?:,{_CELL})*+\z"


def large_files(spark: SparkSession, paths) -> list[str]:
    """The files of more than LARGE bytes; names only, which readers take from the driver anyhow."""
    sized = spark.read.format("binaryFile").load(paths if isinstance(paths, (list, tuple)) else [paths]).where(F.col("length") > LARGE)
    return [r["p"] for r in sized.select(local_path(F.col("path")).alias("p")).toLocalIterator()]


def quoted_line_ends(spark: SparkSession, paths) -> list[str]:
    """The CSV files that can't be cut at their line ends.

    Every line of the others is a whole record by itself, so it makes no difference whether a reader looks at lines or
    follows quotes.  The files are read once for it, in splits.
    """
    lines = spark.read.option("lineSep", "\n").text(paths)
    odd = lines.where(~F.col("value").rlike(PLAIN_LINE)).select(plain_path(F.col("_metadata.file_path")).alias("p")).distinct()
    return [r["p"] for r in odd.toLocalIterator()]


def read_csv_strings(spark: SparkSession, paths, multiline: bool = True, with_source: bool = False,
                     schema=None, corrupt_column: str | None = None, null_tokens=()) -> DataFrame:
    """Header CSV with every column as a string (leading zeros survive; no inference).

    ``multiline`` allows quoted newlines in cells: where a file is large all are looked through for them, and when there
    are none the files are read in splits; else each file is one.  Turn it off for files known to hold none.  Cells equal
    to one of ``null_tokens`` become null (default: none; text such as ``NA``
    is kept as text).
    """
    if multiline and large_files(spark, paths):
        multiline = bool(quoted_line_ends(spark, paths))
    r = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
    )
    if schema is not None:
        r = r.schema(schema)
    if corrupt_column:
        r = r.option("columnNameOfCorruptRecord", corrupt_column)
    df = r.csv(paths if isinstance(paths, (list, tuple)) else [paths])
    tokens = [t for t in null_tokens if t != ""]
    if tokens:
        clean = [F.when(col(c).isin(*tokens), F.lit(None).cast("string")).otherwise(col(c)).alias(c)
                 if c != corrupt_column else col(c) for c in df.columns]
    else:
        clean = [col(c) for c in df.columns]
    if with_source:
        clean.append(plain_path(F.col("_metadata.file_path")).alias(fresh(df, "source")))
    return df.select(*clean)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header kept, no index column; quotes doubled inside quoted cells (RFC 4180); cells untrimmed."""
    csv_writer(df, mode).csv(path)


def csv_writer(df: DataFrame, mode: str = "errorifexists"):
    return (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def _normal(path: str) -> str:
    """A path or URI without its local scheme, ``.``, ``..``, links (local paths) and trailing slashes."""
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*:)(//[^/]*)?(/.*|$)", path)
    if m and m[1].lower() != "file:":
        return m[1].lower() + (m[2] or "") + posixpath.normpath(m[3] or "/")
    return os.path.realpath(m[3] if m else path)


def guard_output(input_path: str, output_path: str, force: bool = False) -> None:
    """Refuse an output that is the input or a folder above it, unless forced (normalised paths compared)."""
    given, out = _normal(input_path), _normal(output_path)
    if not force and (given == out or given.startswith(out.rstrip("/") + "/")):
        raise OverwriteError(f"output {output_path} is or holds the input {input_path}; pass force=True to overwrite")


# ---------------------------------------------------------------- paths
def plain_path(c: Column) -> Column:
    """A file column of a scan as a path: percent escapes decoded, ``file:`` dropped, other schemes kept."""
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def extension(path: Column) -> Column:
    """Lower-cased suffix of the base name (``''`` when none)."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_supported(path: Column) -> Column:
    return extension(path).isin(*SUPPORTED_EXTENSIONS)


def glob_regex(glob: str, ignore_case: bool = False) -> str:
    """Shell glob (``* ? [seq] [!seq]``) as an anchored regex, same in Java and RE2.

    Case-sensitive by default, as file names on Linux; ``ignore_case`` matches
    ``X.PDF`` with ``*.pdf``.
    """
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            # Bracket rules of fnmatch: "!" negates, a "]" right after "[" or "[!" is literal.
            j = i + 1
            if j < len(glob) and glob[j] == "!":
                j += 1
            if j < len(glob) and glob[j] == "]":
                j += 1
            k = glob.find("]", j)
            if k < 0:
                out.append(r"\[")
            else:
                body = glob[i + 1:k]
                neg = body.startswith("!")
                if neg:
                    body = body[1:]
                out.append(_bracket(body, neg))
                i = k
        elif c.isalnum() or c == "_":
            out.append(c)
        else:
            out.append("\\" + c)
        i += 1
    return ("(?si)^" if ignore_case else "(?s)^") + "".join(out) + "$"


def _bracket(body: str, neg: bool) -> str:
    """A glob bracket body as a class, with fnmatch's meaning.

    ``x-y`` is a range and a reversed one matches nothing; ``-`` first or last
    is literal; characters Java reads specially inside a class (nested ``[``,
    ``&&``, ``^``, ``]``, ``\\``, ``-``) are escaped.
    """

    def esc(ch):
        return "\\" + ch if ch in "\\[]^&-" else ch

    items, j = [], 0
    while j < len(body):
        if j + 2 < len(body) and body[j + 1] == "-":
            lo, hi = body[j], body[j + 2]
            if lo <= hi:
                items.append(esc(lo) + "-" + esc(hi))
            j += 3
        else:
            items.append(esc(body[j]))
            j += 1
    if not items:  # only reversed ranges: nothing (negated: any character); no look-around, so RE2 reads it too
        return r"[\s\S]" if neg else r"[^\s\S]"
    return "[" + ("^" if neg else "") + "".join(items) + "]"


def matches_any(name: Column, globs, ignore_case: bool = False) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | name.rlike(glob_regex(g, ignore_case))
    return out


def file_status(name: Column, path: Column, include_globs=DEFAULT_INCLUDE_GLOBS, exclude_globs=(),
                ignore_case: bool = False) -> Column:
    """``supported`` when included, not excluded (exclusion wins) and of a supported type; else ``skipped``."""
    ok = ~matches_any(name, exclude_globs, ignore_case) & matches_any(name, include_globs, ignore_case) \
        & is_supported(path)
    return F.when(ok, F.lit("supported")).otherwise(F.lit("skipped"))


def output_path(path: Column, input_base: str, output_base: str) -> Column:
    """Mirror the path under ``output_base``; a path outside ``input_base`` keeps only its name.

    Plain string operations (no regex), so bases may hold regex characters.
    """
    ib, ob = input_base.rstrip("/"), output_base.rstrip("/")
    inside = path.startswith(ib + "/")
    return F.when(inside, F.concat(F.lit(ob), path.substr(F.lit(len(ib) + 1), F.length(path)))).otherwise(
        F.concat(F.lit(ob + "/"), base_name(path)))


def local_path(c: Column) -> Column:
    """A listed path (never escaped) without ``file:``."""
    return F.regexp_replace(c, "^file:/+", "/")


# ---------------------------------------------------------------- inventory
def inventory(spark: SparkSession, folder: str, recursive: bool = False, include_globs=DEFAULT_INCLUDE_GLOBS,
              exclude_globs=(), ignore_case: bool = False) -> DataFrame:
    """Every file under ``folder``: ``(path, rel_path, name, length, status)``, sorted by path.

    Folders are listed by tasks (``listing.walk``); no file is opened.
    """
    root = qualified(spark, folder)
    files = walk(spark, root, recursive)
    rel = F.substr("path", F.lit(len(root.rstrip("/")) + 2))
    files = files.select("path", rel.alias("rel_path"), base_name(F.col("path")).alias("name"), "length")
    return files.select("*", file_status(F.col("name"), F.col("path"), include_globs, exclude_globs, ignore_case).alias("status")) \
        .orderBy("path")


def fingerprints(spark: SparkSession, paths) -> DataFrame:
    """SHA-256 of each file's bytes: ``(path, length, sha256)``; files of any length, read in pieces, in parallel.

    ``paths`` is a path or several, folders (with all below them) and globs too.
    """
    return file_hashes(walk(spark, paths).select("path"))


def row_fingerprint(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


# ---------------------------------------------------------------- run report
def save_report(files: DataFrame, summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report folder: ``files/`` (JSON lines, written in parallel) and ``summary/`` (one row)."""
    files.write.mode(mode).json(f"{path}/files")
    summary.coalesce(1).write.mode(mode).json(f"{path}/summary")


def load_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.schema(FILE_RESULT_TYPE).json(f"{path}/files")
    summary = spark.read.schema(SUMMARY_TYPE).json(f"{path}/summary")
    return files, summary


# ---------------------------------------------------------------- page text
def read_text_pages(spark: SparkSession, paths, page_break: str = "\f") -> DataFrame:
    """Text files as documents: ``(doc, page_number, text)``, pages split at ``page_break``.

    Extracted PDF text marks page ends with a form feed.  Each file is one
    row while it is split (a document is read by one task; files in parallel).
    """
    from scrub.functions.arrays import explode_kept

    whole = spark.read.text(paths if isinstance(paths, (list, tuple)) else [paths], wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:", "").alias("doc"),
        F.split(F.col("value"), _regex_literal(page_break), -1).alias("pages"),
    )
    pages = explode_kept(whole, ["doc"], F.col("pages"), "text", pos="pos")
    return pages.select("doc", (F.col("pos") + 1).cast("int").alias("page_number"), "text")


def _regex_literal(s: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in s)
