"""Shared helpers."""

from pyspark.sql import functions as F

from quire.llm import common


def test_join_checked_both_ways(spark, monkeypatch):
    big = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4)], "k string, v int")
    small = spark.createDataFrame([("a", "x"), ("c", "y")], "k string, w string")
    for how in ("left", "left_semi", "inner"):
        got = []
        for most in (10, 0):
            monkeypatch.setattr(common, "SEND_ROWS", most)
            got.append(sorted(map(str, common.join_checked(big, small, "k", how, F.length("w")).select("k", "v").collect())))
        assert got[0] == got[1] and len(got[0]) == {"left": 4, "left_semi": 2, "inner": 2}[how]


def test_added_columns_replace_same_names(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1, "a", "old"), (2, None, "old")], "id int, t string, N string")
    adds = T.StructType([T.StructField("n", T.LongType())])
    got = common.map_rows(df, lambda t: [[len(r) for r in common.raw_texts(t)]], ["t"], adds)
    assert got.columns == ["id", "t", "n"] and [tuple(r) for r in got.orderBy("id").collect()] == [(1, "a", 1), (2, None, 0)]


def test_fold(spark):
    import zlib

    got = spark.createDataFrame([(5,), (None,), (123,)], "i long").select("i", common.fold(F.col("i"), 7).alias("f")).collect()
    assert {r.i: r.f for r in got} == {5: zlib.crc32(b"5") % 7, 123: zlib.crc32(b"123") % 7, None: 0}
