"""Tables in the shared folder and their removal."""

import os
from threading import Thread

import pytest

from clonoform.sources.staging import remove_tables, settle, stage, staging_scope, temporary_tables


def gone(path):
    return not os.path.exists(path.removeprefix("file:"))


def test_scopes_know_their_own_tables(spark):
    with staging_scope() as outer:
        stage(spark.range(3), "a")
        with staging_scope() as inner:
            stage(spark.range(3), "b")
        other = []
        thread = Thread(target=lambda: other.append(stage(spark.range(4), "c")))
        thread.start()
        thread.join()
    assert [p.rsplit("/", 1)[-1][:2] for p in outer] == ["a-"] and [p.rsplit("/", 1)[-1][:2] for p in inner] == ["b-"]
    remove_tables(spark, outer)
    assert gone(outer[0]) and not gone(inner[0]) and other[0].count() == 4


def test_settle_leaves_what_others_staged(spark):
    before = stage(spark.range(5), "before")

    def step():
        return stage(before, "between").selectExpr("id + 1 as id")

    out, own = settle(step, "settled")
    assert sorted(r[0] for r in out.collect()) == [1, 2, 3, 4, 5] and before.count() == 5
    assert len(own) == 1 and not gone(own[0])


def test_temporary_tables_go(spark):
    with pytest.raises(ZeroDivisionError), temporary_tables(spark), staging_scope() as kept:
        stage(spark.range(2), "kept")
        1 / 0
    assert not gone(kept[0])
    with temporary_tables(spark):
        df = stage(spark.range(2), "gone")
        assert df.count() == 2
    assert gone(df.inputFiles()[0])
