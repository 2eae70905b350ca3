"""Scratch tables: what is freed, and when."""

import os

from graphloom.scratch import Scratch, freed


def test_tables_are_freed_at_the_end_and_no_others(spark):
    outer = Scratch(spark, "outer")
    kept = outer.cut(spark.range(3))
    with freed(spark):
        inner = Scratch(spark, "inner")
        df, state = inner.cut_state(spark.range(5), "id")
        assert df.count() == 5 and state == inner.cut_state(spark.range(5).repartition(3), "id")[1]
        assert state != inner.cut_state(spark.range(1, 6), "id")[1]
    assert not os.path.exists(inner.base.removeprefix("file://")) and kept.count() == 3
    parts = outer.cut(spark.range(6).selectExpr("id", "id % 2 as p"), partition_by="p")
    assert {r.id for r in parts.where("p = 1").collect()} == {1, 3, 5}


def test_a_swap_that_was_cut_short_is_finished(spark, tmp_path):
    from graphloom.sources.files import read_table
    from graphloom.sources.sinks import overwrite

    root = str(tmp_path)
    overwrite(spark.range(2), root, "t")
    spark.range(5).write.parquet(f"{root}/t.new-1")
    assert read_table(spark, root, "t").count() == 2
    os.rename(f"{root}/t", f"{root}/t.old-1")
    assert read_table(spark, root, "t").count() == 5
    os.rename(f"{root}/t", f"{root}/t.new-2")
    os.remove(f"{root}/t.new-2/_SUCCESS")
    assert read_table(spark, root, "t").count() == 2
