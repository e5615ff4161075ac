"""Tables between steps."""

import os
import time

import pytest

from skyweave.sources.shared import SHUFFLES_GO, settled, shared_folder, written


def _tables(spark):
    return set(os.listdir(shared_folder(spark).removeprefix("file://")))


def test_settled_keeps_its_result_only(spark):
    written(spark.range(1))
    before = _tables(spark)

    def inner():
        return written(spark.range(10)).where("id < 5")

    def outer():
        a = settled(spark, inner)
        return a.join(written(spark.range(3)), "id")

    out = settled(spark, outer)
    assert len(_tables(spark) - before) == 1 and before <= _tables(spark)
    assert sorted(r.id for r in out.collect()) == [0, 1, 2]
    kept = written(spark.range(2))
    assert kept.count() == 2


def test_settled_after_a_failure(spark):
    with pytest.raises(ZeroDivisionError):
        settled(spark, lambda: 1 / 0)
    before = _tables(spark)
    written(spark.range(1))
    settled(spark, lambda: spark.range(1))
    assert len(_tables(spark) - before) == 2


def _shuffle_files(spark):
    tops = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {x for top in tops for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}


def test_written_leaves_no_shuffle_files(spark):
    rows = spark.range(10_000).selectExpr("id", "id % 7 AS k")
    before, conf = _shuffle_files(spark), spark.conf.get(SHUFFLES_GO, "false")
    df = rows.repartition(3, "k").join(rows.groupBy("k").count(), "k")
    out = written(df)
    for _ in range(50):  # they go in the background
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert out.count() == df.count() == 10_000  # and can be made again
    assert spark.conf.get(SHUFFLES_GO, "false") == conf
