import pyarrow as pa

from granary.llm import common


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(None, None)], "a long, b string")
    assert common._small(df, 100, 1 << 20)
    assert not common._small(df, 50, 1 << 20)  # rows
    assert not common._small(df, 100, 6000)  # bytes of the strings
    assert common._small(df.select("a"), 100, 6000) and not common._small(df.select("a"), 100, 1000)
    assert not common._small(df.selectExpr("array(a) AS a"), 100, 1 << 20)  # nested: of no known width
    assert common._small(df.limit(0), 100, 1 << 20)
    left = spark.range(60)
    for size in (1 << 20, 10):  # the same rows whichever way the join goes
        got = common.bounded_join(left, df.select("a"), left.id == df.a, "left_semi", size=size)
        assert got.count() == 50
        assert ("BroadcastHashJoin" in got._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in got._jdf.queryExecution().logical().toString()) == (size > 10)


def test_workers_drop_what_other_operators_kept():
    table = {"x": 1}
    common.KEPT.append(table)
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
        assert [b.num_rows for b in common.give_back(lambda batches: batches)(iter([batch, batch]))] == [1, 1]
        assert not table
    finally:
        common.KEPT.remove(table)


def test_free_names():
    class Table:
        columns = ["_ID", "__id", "n"]

    assert common.fresh(Table, "_id", "_n", "_n") == ["___id", "_n", "__n"]
