"""Splits of ragged, quoted files against Python's csv reader over the whole text."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablesense.sources import delimited as S


def whole(data, sep=","):
    return list(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline=""), delimiter=sep))


def scanned(spark, path, split=None, sep=","):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
        rows = S.scan_delimited(spark, f"file://{path}", sep).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({(r["record_no"], r["row_no"]) for r in rows}) == len(rows)
    return [r["cells"] for r in sorted(rows, key=lambda r: (r["record_no"], r["row_no"]))]


CELLS = ["", "a", '"q"', "two\nlines", "two\r\nlines", 'say ""hi""', "x,y", "é", "long " * 9, "\n\n\n", '"']


def random_file(seed, rows=120):
    rng = random.Random(seed)
    out = io.StringIO(newline="")
    for _ in range(rows):
        row = [rng.choice(CELLS) for _ in range(rng.randrange(0, 5))]
        if rng.random() < 0.15:
            out.write(rng.choice(["", "bare \"quote\" here,x", "\"closed\" and more,y", "\"\",\"\""]) + rng.choice(["\n", "\r\n"]))
        else:
            csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerow(row)
    return out.getvalue().encode()


@pytest.mark.parametrize("split", ["37b", "150b", "2000b", None])
def test_random_files_in_splits(spark, tmp_path, split):
    for seed in (1, 2):
        data = random_file(seed)
        path = tmp_path / f"{seed}.csv"
        path.write_bytes(data)
        assert scanned(spark, path, split) == whole(data)


ODD = {
    "a record over many splits": b'h1,h2\n"' + b"line\n" * 60 + b'",end\nlast,row\n',
    "nothing closes it": b'a,b\n1,2\n3,"open\nand,on\nto the end',
    "no end of line at the end": b"a,b\n1,2",
    "a byte order mark": b'\xef\xbb\xbf"a",b\n1,2\n',
    "bytes that aren't UTF-8": b"a,b\n\xff\xfe,2\n",
    "bare carriage returns": b"a,b\r1,2\r3,4\r\n5,6\n",
    "empty lines": b"\n\na\n\n",
    "blanks before a quote": b'a, "b\nc", d\n',
    "one line": b"a",
    "other quotes": b"a,'b\nc'\n",
}


@pytest.mark.parametrize("name", ODD)
def test_odd_files(spark, tmp_path, name):
    path = tmp_path / "odd.csv"
    path.write_bytes(ODD[name])
    assert scanned(spark, path, "20b") == scanned(spark, path) == whole(ODD[name])


def test_tabs_and_empty_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_bytes(b'a\t"b\tc"\n1,2\t3\n')
    assert scanned(spark, tmp_path / "t.tsv", sep="\t") == [["a", "b\tc"], ["1,2", "3"]]
    (tmp_path / "empty.csv").write_bytes(b"")
    assert scanned(spark, tmp_path / "empty.csv") == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(['"', ",", "a", '""', "\r", " "]), max_size=14), st.lists(st.sampled_from(['"', ",", "b", '""', " "]), max_size=10))
def test_states_are_those_of_the_csv_reader(first, second):
    """Where the first line ends outside of quotes, and only there, its rows and the second line's are those of both."""
    read = lambda text: list(csv.reader(io.StringIO(text, newline="")))
    a, b = "".join(first) + "\n", "".join(second) + "\n"
    assert (read(a) + read(b) == read(a + b)) == (not S.ends_inside(a[:-1].encode(), False, b","))


def test_preview_and_table(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_bytes(b'a,b\n1\n2,"x\ny",3,4\n\n' + b"9,9\n" * 50)
    (got,) = S.preview_delimited(spark, f"file://{path}", 3).collect()
    assert got["columns"] == ["a", "b"] and got["rows"] == [["1"], ["2", "x\ny", "3", "4"], []] and got["row_count"] == 53
    table = S.ragged_table(spark, f"file://{path}").where("a <> '9'")
    assert sorted(map(tuple, table.collect())) == [("1", "", []), ("2", "x\ny", ["3", "4"])]
