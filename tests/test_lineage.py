import threading

import pytest

from codeloom import lineage


def test_cut_keeps_rows_and_schema(spark):
    df = spark.sql("SELECT id, struct(id AS a, array(id, NULL) AS `b c`) AS s, CAST('x' AS BINARY) AS b, NULL AS nothing, map('k', id) AS m, CAST(NULL AS STRING) AS `dotted.name` FROM range(5)")
    out = lineage.cut(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes  # all may be null
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert lineage.cut(df.where("false")).collect() == [] and lineage.cut(spark.range(0)).schema["id"].dataType == spark.range(0).schema["id"].dataType


def test_cut_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    out = lineage.cut(spark.range(100).mapInArrow(run, "id long"))
    assert out.count() == out.distinct().count() == 100 and seen.value == 100


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context._jsc

            @staticmethod
            def getCheckpointDir():
                return Context._jsc

            @staticmethod
            def isEmpty():
                return True

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.folder(Session)


def test_steps_that_need_nothing_of_one_another_run_at_once(spark):
    meet = threading.Barrier(2, timeout=60)  # broken, if one step waits for the end of the other

    def step(n):
        meet.wait()
        return spark.range(n).count()

    assert lineage.together(spark, lambda: step(3), lambda: step(5)) == [3, 5]
    with pytest.raises(ZeroDivisionError):
        lineage.together(spark, lambda: 1 / 0, lambda: spark.range(2).count())


def test_differences_count_as_except_all_does(spark):
    from codeloom.code_queries import differences

    frame = lambda rows: spark.createDataFrame(rows, "k string, v array<float>")
    ours = frame([("a", [1.0]), ("a", [1.0]), ("b", None), (None, []), ("c", [2.0])])
    theirs = frame([("a", [1.0]), ("b", None), ("b", None), (None, []), ("c", [2.5])])
    assert tuple(differences(ours, theirs).first()) == (theirs.exceptAll(ours).count(), ours.exceptAll(theirs).count()) == (2, 2)
    assert tuple(differences(frame([]), frame([])).first()) == (0, 0)
