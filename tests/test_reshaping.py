"""Reshaped specifications against pandas."""

import numpy as np
import pandas as pd
import pytest

from tablesense.plans.checks import check, repaired
from tablesense.plans.spec import Filter, Measure, Melt, Pivot, QuerySpec, Windowed, compile_spec

ROWS = [("a", 3, 1.0), ("a", 1, 5.0), ("a", 2, None), ("b", 2, 2.0), ("b", 1, 2.0), ("b", 3, 9.0), ("b", 4, None), ("c", 1, None)]
FRAME = pd.DataFrame(ROWS, columns=["k", "at", "v"]).sort_values(["k", "at"])
OWN = {"partition": ("k",), "order": (("at", False),)}


@pytest.fixture
def sources(spark):
    return {"t": spark.createDataFrame(ROWS, "k string, at int, v double").repartition(3)}


def column(sources, w, by=("k", "at")):
    rows = compile_spec(QuerySpec("t", windows=(w,), order=tuple((c, False) for c in by)), sources).toPandas()
    return rows[w.name].astype(float).tolist()


def same(got, want):
    assert np.allclose(got, want.astype(float).tolist(), equal_nan=True), (got, want.tolist())


@pytest.mark.parametrize(("rows", "least"), [(2, 1), (2, 2), (3, 1), (3, 3)])
def test_rolling(sources, rows, least):
    for function in ("avg", "sum", "max"):
        rolled = FRAME.groupby("k").v.rolling(rows, min_periods=least).agg({"avg": "mean"}.get(function, function)).reset_index(level=0, drop=True)
        same(column(sources, Windowed("r", function, "v", rows=rows, least=least, **OWN)), rolled)


def test_running_and_shifted(sources):
    g = FRAME.groupby("k").v
    same(column(sources, Windowed("r", "sum", "v", least=1, **OWN)), g.expanding(1).sum().reset_index(level=0, drop=True))
    for n in (1, 2, -1):
        same(column(sources, Windowed("r", "shift", "v", rows=n, **OWN)), g.shift(n))
    same(column(sources, Windowed("r", "avg", "v", partition=("k",))), g.transform("mean"))


def test_ranks(sources):
    g = FRAME[FRAME.v.notna()].groupby("k").v
    for function, method in (("rank", "min"), ("dense_rank", "dense")):
        spec = QuerySpec("t", filters=(Filter("v", "not_null"),), windows=(Windowed("r", function, partition=("k",), order=(("v", False),)),), order=(("k", False), ("at", False)))
        same(compile_spec(spec, sources).toPandas()["r"].tolist(), g.rank(method=method))


def test_pivot_and_melt_are_each_other_s_inverse(spark, sources):
    wide = compile_spec(QuerySpec("t", pivot=Pivot(("k",), "at", "v", "max", (1, 2, 3))), sources)
    assert sorted(map(tuple, wide.fillna(-1.0).collect())) == [("a", 5.0, -1.0, 1.0), ("b", 2.0, 2.0, 9.0), ("c", -1.0, -1.0, -1.0)]
    filled = compile_spec(QuerySpec("t", pivot=Pivot(("k",), "at", "v", "sum", (1, 9), fill=0)), sources)
    assert sorted(map(tuple, filled.collect())) == [("a", 5.0, 0.0), ("b", 2.0, 0.0), ("c", 0.0, 0.0)]
    long = compile_spec(QuerySpec("w", melt=Melt(("k",), ("1", "2", "3"), "at", "v"), filters=(Filter("v", "not_null"),)), {"w": wide})
    assert sorted(map(tuple, long.collect())) == sorted((k, str(at), v) for k, at, v in ROWS if v is not None and at < 4)
    mixed = compile_spec(QuerySpec("t", melt=Melt((), ("k", "at")), groups=("variable",), measures=(Measure("n", "count"), Measure("d", "count_distinct", "value"))), sources)
    assert sorted(map(tuple, mixed.collect())) == [("at", 8, 4), ("k", 8, 3)]


def test_wrong_columns_are_found_and_mended(sources):
    spec = QuerySpec("t", windows=(Windowed("r", "sum", "V_", partition=("k",), order=(("at", False),)),))
    assert [i.code for i in check(spec, sources)] == ["no_such_column"]
    assert repaired(spec, sources)[0].windows[0].column == "v"
    assert check(QuerySpec("t", pivot=Pivot(("k",), "at", "nothing_alike", "sum", (1,))), sources)
