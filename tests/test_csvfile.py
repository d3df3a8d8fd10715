"""CSV files in splits of any size, columns of any names, labels as Python writes them."""

import csv
import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.errors import DataError
from quillon.sources import csvfile
from quillon.sources.labelled import float_text, from_columns, numbered, read_csv


@pytest.fixture
def splits(spark):
    """Sets the size of splits, in bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def size(n):
        for name, value in zip(names, (n, 0, 1)):
            spark.conf.set(name, str(value))

    yield size
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def wrote(tmp_path, text, name="x.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def found(spark, path):
    got = csvfile.records(spark, path)
    rows = sorted((r["row_idx"], r["fields"]) for r in got.frame.collect())
    assert [i for i, _ in rows] == list(range(len(rows)))
    return [got.header] + [f for _, f in rows]


def parsed(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r and not (len(r) == 1 and not r[0].strip())]


@pytest.mark.parametrize("size", [61, 333, 1 << 20])
def test_records_across_split_ends(spark, tmp_path, splits, size):
    rng = random.Random(size)
    cells = ["", "1", "plain", "a b", '"q"', 'say ""x"" now', '"a,b"', '"two\nlines"', '"crlf\r\nwithin"', '"end ""quote"""', '""', '""""""', 'in"side', 'x""', '"closed"tail', '"closed"ta"il', "é\U0001f642", '"\n\n\n"', f'"{"long " * 30}\n{"text," * 20}"']
    rows = [",".join(rng.choice(cells) for _ in range(3)) for _ in range(60)]
    lines = [rows[0]]
    for row in rows[1:]:
        lines += [""] * (rng.random() < 0.1) + ["  "] * (rng.random() < 0.05) + [row]
    for end in ("\n", "\r\n"):
        text = "h1,\"h\n2\",h3" + end + end.join(lines) + rng.choice(["", end])
        path = wrote(tmp_path, text, f"x{len(end)}.csv")
        splits(size)
        assert found(spark, path) == parsed(text)


@pytest.mark.parametrize("size", [37, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_plain_lines(spark, tmp_path, splits, size, end):
    lines = ["", "a,b", *(f"{i},{'x' * (i % 9)}" for i in range(80)), "", " \t", "7,", ",", ",8"]
    splits(size)
    assert found(spark, wrote(tmp_path, end.join(lines))) == parsed("\n".join(lines))


def test_numbers_need_no_copy_and_hold_under_other_splits(spark, tmp_path, splits):
    path = wrote(tmp_path, "x,class\n" + "\n".join(f"{i},c{i % 3}" for i in range(3000)))
    splits(1000)
    data = read_csv(spark, path)
    assert data.frame.rdd.getNumPartitions() > 5
    assert all(r["features"][0] == r["row_idx"] for r in data.frame.collect())
    assert "quillon" not in data.frame._jdf.queryExecution().executedPlan().toString().replace(path, "")  # reads the file alone
    splits(700)  # splits that were not counted are told from those that were
    try:
        assert all(r["features"][0] == r["row_idx"] for r in data.frame.select("row_idx", "features").collect())
    except Exception as error:  # noqa: BLE001
        assert "splits were dealt" in str(error)


def test_refusals(spark, tmp_path):
    for text in ('a,class\n"open,x\n', 'a,class\r1,"x"\r2,"y"\r', "", "\n \n"):
        with pytest.raises(Exception) as error:
            csvfile.records(spark, wrote(tmp_path, text)).frame.collect()
        assert isinstance(error.value, DataError) or "DataError" in str(error.value)


def test_quoted_values(spark, tmp_path):
    text = '﻿a,"b,2",class\n1,"2.5","a ""q"" b"\n"3",NA,"two\nlines"\n"NA",4,"a,b"\n'
    data = read_csv(spark, wrote(tmp_path, text))
    assert data.feature_names == ["a", "b,2"] and data.classes == ['a "q" b', "a,b", "two\nlines"]
    rows = [[None if math.isnan(x) else x for x in r["features"]] for r in data.frame.orderBy("row_idx").collect()]
    assert rows == [[1, 2.5], [3, None], [None, 4]]


CLASHING = ["row_idx", "_at", "_part", "A", "a", "label", "label_s", "features", "c1", "c0", "_before", "value", "block", "a b`c.d", "class"]


def test_columns_of_any_name(spark, tmp_path):
    rows = [[i * 100 + j for j in range(14)] + ["xy"[i % 2]] for i in range(6)]
    names = ",".join(f'"{n}"' if "." in n else n for n in CLASHING)
    data = read_csv(spark, wrote(tmp_path, names + "\n" + "\n".join(",".join(map(str, r)) for r in rows)), drop_cols=["A"])
    want = [[float(x) for j, x in enumerate(r[:14]) if CLASHING[j] != "A"] for r in rows]
    assert data.feature_names == [c for c in CLASHING[:14] if c != "A"]
    assert [r["features"] for r in data.frame.orderBy("row_idx").collect()] == want
    table = spark.createDataFrame([tuple(r) for r in rows]).toDF(*CLASHING).coalesce(1)
    whole = [[float(x) for x in r[:14]] for r in rows]
    for frame in (from_columns(table, "class"), from_columns(table, "class", features=CLASHING[:14])):
        assert [r["features"] for r in frame.frame.orderBy("row_idx").collect()] == whole and frame.classes == ["x", "y"]
    keyed = from_columns(table, "class", "row_idx", features=["a", "row_idx"])
    assert {r["row_idx"]: r["features"] for r in keyed.frame.collect()} == {r[0]: [r[4], r[0]] for r in rows}
    for bad in (lambda: from_columns(table, "b"), lambda: from_columns(table, "class", features=["B"]), lambda: from_columns(spark.createDataFrame([(1, 2)]).toDF("A", "A"), "A"), lambda: numbered(table)):
        with pytest.raises(DataError):
            bad()


def test_export_of_clashing_columns(spark, tmp_path):
    from quillon.plans import experiment

    path = wrote(tmp_path, "row_idx,A,a,class\n" + "\n".join(f"{i},{i * 2},{i * 3},{'xy'[i % 2]}" for i in range(10)))
    place = experiment.validate(spark, {"io": {"dataset": path, "drop_cols": ["A"]}, "validation": {"type": "kfold", "params": {"n_splits": 2, "shuffle": False}, "export": {"csv": True}}}, str(tmp_path))
    assert (place / "partitions/fold_0/test.csv").read_text().splitlines() == ["row_idx,a,class", "0,0,x", "1,3,y", "4,12,x", "5,15,y", "8,24,x", "9,27,y"]


def test_labels_as_python_writes_them(spark):
    rng = np.random.default_rng(1)
    exact = [0.0, -0.0, 1.0, -1.5, 1e-05, 0.0001, 0.00012345, 10000000.5, 1e15, 1e16, 1.5e16, 123456789012345680.0, 1e17, 1e22, 1e23, 9.999999999999999e22, 2e-44, 2.2204460492503131e-16, 5e-324, 1.7976931348623157e308, 1e-7, 100.0, 2.0**-44, 0.1 + 0.2, 1e100, math.inf, -math.inf, math.nan]
    numbers = exact + [float(x) for x in rng.standard_normal(500) * 10.0 ** rng.integers(-30, 30, 500)] + [float(x) for x in np.frombuffer(rng.bytes(8 * 1500))]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = {r["i"]: r["s"] for r in table.select("i", float_text(F.col("x"), table.schema["x"].dataType).alias("s")).collect()}
    assert [got[i] for i in range(len(numbers))] == [str(x) for x in numbers]
    singles = [np.float32(x) for x in (0.1, 1e-5, 3.4e38, 1.17549435e-38, -2.5)]
    table = spark.createDataFrame([(i, float(x)) for i, x in enumerate(singles)], "i int, x float")
    got = [r["s"] for r in table.orderBy("i").select(float_text(F.col("x"), table.schema["x"].dataType).alias("s")).collect()]
    assert got == [str(x) for x in singles]
