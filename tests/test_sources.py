"""Sources and sinks: CSV round trip, missing input, ragged union."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskspark.schemas import POSTS, MissingColumnsError, require_columns
from riskspark.sources import fixtures as FX
from riskspark.sources.tables import InputNotFoundError, read_csv, read_table, write_table
from tests.conftest import SF001


def test_csv_round_trip(spark):
    posts = FX.posts(spark, SF001)
    out = os.path.join(tempfile.mkdtemp(prefix="riskspark-csv-"), "posts")
    write_table(posts, out, fmt="csv")
    back = read_csv(spark, out, POSTS)
    key = ["post_id", "caption", "transcript", "neg", "risk_yuzdesi", "face_detected"]
    assert sorted(back.select(key).collect()) == sorted(posts.select(key).collect())


def test_missing_input_is_a_clear_error(spark):
    with pytest.raises(InputNotFoundError):
        read_table(spark, "/nonexistent/folder", "documents")


def test_required_columns(spark):
    df = spark.createDataFrame([(1, "a")], "video_url long, other string")
    with pytest.raises(MissingColumnsError, match="tag"):
        require_columns(df, ["video_url", "tag"])


def test_csv_nan_becomes_null(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="riskspark-csv-"), "x.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write('post_id,caption,neg\n1,"two\nlines ""quoted""",NaN\n2,b,0.5\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("post_id", T.LongType()), T.StructField("caption", T.StringType()),
                           T.StructField("neg", T.DoubleType())])
    rows = sorted(read_csv(spark, path, schema).collect())
    assert rows[0].caption == 'two\nlines "quoted"' and rows[0].neg is None
    assert rows[1].neg == 0.5


def test_spread_scan_is_explicit(spark):
    from riskspark.sources.tables import spread_scan

    one = read_table(spark, SF001, "documents").select("doc_id", "n_chars")  # one file, one row group
    assert spread_scan(one, "doc_id") is one    # no number: no shuffle added
    spread = spread_scan(one, "doc_id", 8)
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan
    sizes = [r[1] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < one.count()
    assert sorted(spread.collect()) == sorted(one.collect())
