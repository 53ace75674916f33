"""A stream is judged by the rules of a batch; a session judges what has changed."""

import pytest
from pyspark.sql import functions as F

from pactum.operators import model as M
from pactum.streaming import revalidate as R

RECORD = M.Record("Item", {"n": M.Member("required", M.rng(0, 100)), "twice": M.Member("derived", None, lambda m: m["n"] * 2)}, [M.Assert("small", lambda m: m["twice"] <= 150)])


def test_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame([(i, 10 * i) for i in range(15)], "key long, n long").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    where = F.concat(F.lit("items["), F.col("key").cast("string"), F.lit("]"))
    seen = []
    q = R.validate_stream(stream, RECORD, where, lambda values, reports, n: seen.append((sorted(values.collect()), sorted((r.key, r.code) for r in reports.collect()))), str(tmp_path / "cp"), keep=["key"])
    q.processAllAvailable()
    q.stop()
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert sorted(x for values, _ in seen for x in values) == sorted(RECORD.evaluate(batch, where, ["key"]).collect())
    assert sorted(x for _, reports in seen for x in reports) == sorted((r.key, r.code) for r in RECORD.diagnostics(batch, where, keep=["key"]).collect())


def test_session(spark):
    where = F.concat(F.lit("items["), F.col("key").cast("string"), F.lit("]"))
    s = R.Session(RECORD, spark.createDataFrame([(1, 10), (2, 90), (3, 500)], "key long, n long"), "key", where)
    show = lambda d: sorted((r.key, r.code) for r in d.collect())
    before = s.validate()
    assert show(before) == [(2, "E6001"), (3, "E4001")]
    changes = spark.createDataFrame([(2, 20), (4, 80)], "key long, n long")
    s.upsert(changes)
    assert show(s.revalidate(before, changes)) == show(s.validate()) == [(3, "E4001"), (4, "E6001")]
    assert sorted((r.key, r.change) for r in s.diff().collect()) == [(2, "+"), (2, "-"), (4, "+")]
    s.remove(spark.createDataFrame([(3,)], "key long"))
    assert show(s.validate()) == [(4, "E6001")]
    s.undo()
    s.undo()
    assert show(s.validate()) == show(before)
    s.redo()
    assert s.evaluate().count() == 4


def _session(spark, rows):
    return R.Session(RECORD, spark.createDataFrame(rows, "key long, n long"), "key", F.concat(F.lit("items["), F.col("key").cast("string"), F.lit("]")))


def test_edits_that_do_not_fit_are_refused(spark):
    s = _session(spark, [(1, 10), (2, 90)])
    one = lambda *rows: spark.createDataFrame(list(rows), "key long, n long")
    for edit, rows in ((s.create, one((1, 5))), (s.update, one((7, 5))), (s.remove, one((7, 5))), (s.create, one((8, 1), (8, 2))), (s.create, one((None, 1)))):
        with pytest.raises(R.SessionError):
            edit(rows)
    assert s.history() == [] and s.at == 0
    s.create(one((3, 30)))
    s.update(one((3, 31), (1, 11)))
    s.remove(one((2, 0)))
    s.create(one((2, 22)))
    rows = lambda: sorted(map(tuple, s.now.collect()))
    assert rows() == [(1, 11), (2, 22), (3, 31)]
    s.undo(2)
    assert rows() == [(1, 11), (2, 90), (3, 31)]
    assert s.history() == [("create", 1, True), ("update", 2, True), ("remove", 1, False), ("create", 1, False)]
    s.bind(one((9, 9)))
    assert rows() == [(9, 9)] and [x[0] for x in s.history()] == ["create", "update", "bind"]
    s.create(spark.createDataFrame([], "key long, n long"))
    assert rows() == [(9, 9)]
    s.reset()
    assert rows() == [(1, 10), (2, 90)] and s.history()[-1] == ("reset", 0, True)
    s.undo()
    assert rows() == [(9, 9)]


def test_plans_do_not_grow_with_edits(spark):
    s = _session(spark, [(i, i) for i in range(10)])
    sizes = []
    for i in range(4):
        s.update(spark.createDataFrame([(i, 50 + i)], "key long, n long"))
        sizes.append(s.now._jdf.queryExecution().optimizedPlan().toString().count("Join"))
    assert len(set(sizes)) == 1


def test_partial_evaluation_and_trace(spark):
    s = _session(spark, [(1, 10), (2, 500)])
    assert sorted(map(tuple, s.evaluate(["twice"]).collect())) == [(1, 20), (2, None)]
    got = sorted(tuple(r) for r in s.trace("twice").collect())
    assert got == [(1, 0, 0, "twice", "derived", "20", False), (1, 1, 1, "n", "required", "10", False), (2, 0, 0, "twice", "derived", None, True), (2, 1, 1, "n", "required", None, True)]
