"""Listing, hashes and headers of files, in tasks."""

import hashlib
import os
import resource
import tempfile

import pytest

from scrub.sources.files import fingerprints, inventory
from scrub.sources.listing import _digest, file_headers, first_record, walk


def _put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def _tree():
    d = tempfile.mkdtemp(prefix="scrub-walk-")
    for k in range(40):
        _put(f"{d}/f{k % 5}/g{k % 3}/n{k}.csv", b"a,b\n" * k)
    _put(d + "/top.csv", b"x")
    _put(d + "/f1/.hidden/x.csv", b"x")
    _put(d + "/f1/_work/x.csv", b"x")
    _put(d + "/f1/k=_v/x y+%41.csv", b"xyz")
    os.makedirs(d + "/f2/empty")
    os.symlink(d, d + "/f2/loop")
    return d


def _expected(d):
    out = {}
    for at, folders, names in os.walk(d):
        folders[:] = [f for f in folders if not f.startswith((".", "_"))]
        out.update({f"{at}/{n}": os.path.getsize(f"{at}/{n}") for n in names})
    return out


def test_walk_lists_what_a_plain_walk_does(spark):
    d = _tree()
    want = _expected(d)
    assert {r.path: r.length for r in walk(spark, d).collect()} == want and len(want) == 42
    assert [r.path for r in walk(spark, d, recursive=False).collect()] == [d + "/top.csv"]
    # overlapping paths list a file once
    assert walk(spark, [d, d + "/f1", d + "/top.csv"]).count() == 42


def test_walk_takes_globs_as_the_readers_do(spark):
    d = _tree()
    for glob in (f"{d}/f[12]/*/n?.csv", f"{d}/*/g1", f"{d}/{{f0,f3}}/g*/*.csv", f"{d}/nothing*/x"):
        got = sorted(r.path for r in walk(spark, glob, recursive=False).collect())
        if "nothing" in glob:
            assert got == []
        else:
            read = spark.read.format("binaryFile").load(glob)
            assert got == sorted({f[len("file:"):].replace("///", "/") for f in read.inputFiles()}) and got


def test_inventory_is_in_order_and_a_missing_folder_is_an_error(spark):
    d = _tree()
    rows = inventory(spark, "file:" + d, recursive=True).collect()
    assert [r.path for r in rows] == sorted(_expected(d))
    assert all(r.path == f"{d}/{r.rel_path}" and r.name == os.path.basename(r.path) for r in rows)
    with pytest.raises(Exception, match="No such file"):
        inventory(spark, d + "/absent").collect()


def test_many_files_in_one_folder(spark):
    d = tempfile.mkdtemp(prefix="scrub-walk-")
    for k in range(10_000):
        open(f"{d}/{k}.csv", "w").close()
    files = inventory(spark, d)
    assert files.count() == 10_000
    # The plan holds no path: the driver has no list of files.
    assert "9999.csv" not in files._jdf.queryExecution().toString()


def test_hashes_are_those_of_the_bytes(spark):
    d = tempfile.mkdtemp(prefix="scrub-hash-")
    data = {"e": b"", "one": b"\x00", "exact": b"q" * (1 << 20), "more.gz": bytes(range(256)) * 9000}
    for n, b in data.items():
        _put(f"{d}/{n}", b)
    got = {os.path.basename(r.path): (r.length, r.sha256) for r in fingerprints(spark, d).collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in data.items()}


def test_a_file_beyond_two_gib_is_hashed_in_little_memory(spark):
    d = tempfile.mkdtemp(prefix="scrub-hash-")
    size = 3 * (1 << 30)
    with open(d + "/big", "wb") as f:
        f.truncate(size)  # a hole: no disk is taken
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (path, length, digest), = _digest(d + "/big")
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KiB
    row, = fingerprints(spark, d + "/big").collect()
    assert (row.length, row.sha256) == (size, digest) == (length, digest)
    os.truncate(d + "/big", 0)


def test_headers_as_a_csv_reader_gives_them(spark):
    d = tempfile.mkdtemp(prefix="scrub-head-")
    bodies = {
        "plain": b"a,b\n1,2\n", "crlf": b"a,b\r\n1,2\r\n", "blank": b"\n\r\n\na,b\n", "broken": b'"a\nb",c\n1,2\n', "bom": b"\xef\xbb\xbfa,b\n",
        "empty": b"", "only_blank": b"\n\n", "no_end": b'a,"b""c"', "latin": b"\xe9,b\n",
    }
    for n, b in bodies.items():
        _put(f"{d}/{n}", b)
    got = {os.path.basename(r.path): r.header for r in file_headers(walk(spark, d).select("path")).collect()}
    assert got == {"plain": ["a", "b"], "crlf": ["a", "b"], "blank": ["a", "b"], "broken": ["a\nb", "c"], "bom": ["a", "b"],
                   "empty": None, "only_blank": None, "no_end": ["a", 'b"c'], "latin": ["�", "b"]}


def test_only_the_head_is_read():
    read = []

    def lines():
        for k in range(1000):
            read.append(k)
            yield "x,y\n"

    assert first_record(lines()) == ["x", "y"] and read == [0]
