"""Property tests for the ordering core: on random frames, bucketed
numbering and chunked windows equal Spark's plain window functions."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from cyclewise.operators.ordering import engine_windows, rows_back, running_sum

rows_strategy = st.lists(
    st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 50), st.one_of(st.none(), st.floats(-100, 100, allow_nan=False))),
    min_size=1, max_size=60,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, buckets=st.integers(1, 20), chunk=st.integers(3, 8), segment=st.integers(1, 4))
def test_ordering_core_matches_native(spark, rows, buckets, chunk, segment):
    data = [(i, k, t, x) for i, (k, t, x) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, engine_id long, t long, x double")
    numbered = running_sum(df, "engine_id", ["t", "id"], None, "cycle", buckets=buckets, segment=segment)
    w = Window.partitionBy("engine_id").orderBy("t", "id")
    want = df.select("id", F.row_number().over(w).alias("rn"),
                     F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"))
    got = numbered.join(want, "id")
    assert got.count() == len(data) and got.where("cycle != rn").count() == 0

    summed = running_sum(df, "engine_id", ["t", "id"], "t", out="rs2", buckets=buckets, segment=segment).join(want, "id")
    assert summed.where("rs2 != rs").count() == 0

    out = engine_windows(numbered, lambda wc: [F.avg("x").over(rows_back(wc, 3)).alias("m3"),
                                               F.lag("x").over(wc).alias("lg")],
                         halo=2, chunk_rows=chunk, engine_aggs=[F.min_by("x", "cycle").alias("first")])
    wn = Window.partitionBy("engine_id").orderBy("cycle")
    ref = numbered.select("id", F.avg("x").over(wn.rowsBetween(-2, 0)).alias("m3b"), F.lag("x").over(wn).alias("lgb"),
                          F.first("x").over(wn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("fb"))
    j = out.join(ref, "id")
    assert j.count() == len(data)
    bad = j.where("NOT (round(m3, 9) <=> round(m3b, 9)) OR NOT (lg <=> lgb) OR NOT (first <=> fb)")
    assert bad.count() == 0
