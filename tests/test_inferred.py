"""CSV types found from cells, against pandas."""

import os
import tempfile

import pandas as pd
import pytest

from riskspark.sources import inferred as IN

CELLS = {
    "whole": ["1", "-2", "+3", " 4"],
    "whole_blank": ["1", "", "3", "4"],
    "number": ["1", "2.5", "-.5", "1e3"],
    "number_na": ["NaN", "2.5", "N/A", "inf"],
    "truth": ["True", "false", "TRUE", "False"],
    "truth_blank": ["True", "", "False", "True"],
    "mixed": ["1", "2.5", "x", ""],
    "none": ["", "NA", "null", "nan"],
    "huge": ["123456789012345678901234", "1", "2", "3"],
    "text": ['two\nlines, "quoted"', "Ünï", " spaces ", "1d"],
}
KIND = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "str": "string", "string": "string"}


def _write(text):
    path = os.path.join(tempfile.mkdtemp(prefix="riskspark-inferred-"), "x.csv")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


@pytest.fixture(scope="module")
def path():
    quoted = lambda s: '"' + s.replace('"', '""') + '"'
    lines = [",".join(CELLS)] + [",".join(quoted(v[i]) if v[i] else "" for v in CELLS.values()) for i in range(4)]
    return _write("\n".join(lines) + "\n")


def test_kinds_and_values_agree_with_pandas(spark, path):
    want = pd.read_csv(path)
    kinds = {r["column"]: r["kind"] for r in IN.column_kinds(IN.read_raw(spark, path)).collect()}
    assert kinds == {c: KIND[str(t)] for c, t in want.dtypes.items()}
    got = IN.read_inferred(spark, path)
    assert dict(got.dtypes) == kinds
    rows = got.collect()
    assert len(rows) == len(want)
    for c in CELLS:
        for a, b in zip([r[c] for r in rows], want[c]):
            assert (a is None and pd.isna(b)) or str(a) == str(b) or a == b, (c, a, b)


def test_nullable_whole_numbers_and_counts(spark, path):
    raw = IN.read_raw(spark, path)
    found = {r["column"]: r for r in IN.column_kinds(raw, keep_int=True).collect()}
    assert found["whole_blank"].kind == "bigint" and found["whole_blank"].n_missing == 1
    assert found["none"].n_missing == 4 and {r.n_rows for r in found.values()} == {4}
    assert [r.whole_blank for r in IN.read_inferred(spark, path, keep_int=True).collect()] == [1, None, 3, 4]


def test_rows_of_the_wrong_width_are_kept_apart(spark):
    path = _write('a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,"x\ny",12\n')
    got = IN.read_inferred(spark, path)
    assert dict(got.dtypes) == {"a": "bigint", "b": "string", "c": "bigint"}
    assert [tuple(r) for r in got.orderBy("a").collect()] == [(1, "2", 3), (10, "x\ny", 12)]
    assert sorted(r.line.strip() for r in IN.bad_rows(spark, path).collect()) == ["4,5", "6,7,8,9"]
    assert got.count() == 2 and got.select("b").count() == 2 and IN.bad_rows(spark, path).count() == 2


def test_header_only_and_odd_names(spark):
    path = _write("a.b,`c`,d\n")
    kinds = IN.column_kinds(IN.read_raw(spark, path)).collect()
    assert [(r["column"], r["kind"], r.n_rows) for r in kinds] == [("a.b", "string", 0), ("`c`", "string", 0), ("d", "string", 0)]
    path = _write("a.b,`c`\n1,2.5\n")
    assert [tuple(r) for r in IN.read_inferred(spark, path).collect()] == [(1, 2.5)]
