"""MapReduce jobs with many keys, nulls, NaN and groups that go over batches."""

import math

from tarnworks.operators.mapreduce import MapReduceJob, MapReducePipeline


def test_reducer_costs_no_frame_per_key(spark):
    records = spark.range(300_000).selectExpr("id AS key", "id % 150000 AS value")
    job = MapReduceJob(lambda _, v: [(str(v), 1)], lambda k, values: [(k, len(values))])
    got = job.run(records)
    assert "FlatMapGroupsIn" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.collect()
    assert [r.key for r in rows] == sorted(str(i) for i in range(150_000)) and {r.value for r in rows} == {2}
    assert job.stats() == {"input_records": 300_000, "shuffled_records": 300_000, "output_records": 150_000}


def test_nulls_and_nan_of_groups_over_batches(spark):
    name, size = "spark.sql.execution.arrow.maxRecordsPerBatch", 3
    spark.conf.set(name, size)
    try:
        # a null beside a number leaves that an integer, whose last digits a float would lose
        big = 2**60
        records = spark.range(24).selectExpr("id AS key", f"CASE WHEN id % 4 > 0 THEN {big} + id % 4 END AS value")
        count = lambda k, values: [(k, len(values))]
        got = MapReduceJob(lambda _, v: [(v, 1)], count, "key long, value long").run(records)
        assert [tuple(r) for r in got.collect()] == [(None, 6), (big + 1, 6), (big + 2, 6), (big + 3, 6)]
        got = MapReduceJob(lambda k, _: [([1.5, math.nan, 0.0, -0.0][k % 4], 1)], count, "key double, value long").run(records).collect()
        assert [r.value for r in got] == [12, 6, 6] and got[0].key == 0 and got[1].key == 1.5 and math.isnan(got[2].key)
    finally:
        spark.conf.unset(name)


def test_faulty_keys_are_left_out_and_jobs_follow_each_other(spark):
    def reducer(k, values):
        if k == "3":
            raise ValueError(k)
        return [(k, sum(values))]

    records = spark.range(40).selectExpr("id AS key", "id % 5 AS value")
    first = MapReduceJob(lambda _, v: [(v, 1)], reducer, fault_tolerant=True)  # numbers become strings, as the schema says
    second = MapReduceJob(lambda k, n: [(f"{n} times", int(k))], lambda k, values: [(k, sum(values))])
    assert [tuple(r) for r in MapReducePipeline().add_stage(first).add_stage(second).run(records).collect()] == [("8 times", 7)]
    assert first.stats()["output_records"] == 4
