"""States and changes that share their buckets."""

import re

import pytest
from pyspark.sql import functions as F

from casetrail.sinks import layers
from casetrail.sinks.layers import LayeredTable

SCHEMA = "item_id string, version long, deleted boolean, size long"


@pytest.fixture
def table(spark, tmp_path):
    return LayeredTable(spark, str(tmp_path / "table"), SCHEMA, buckets=4)


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_reading_the_state_takes_no_shuffle(spark, table):
    table.start(spark.range(100).selectExpr("string(id) item_id", "id version", "false deleted", "id size"))
    for number in range(3):
        table.append(spark.range(50, 150).selectExpr("string(id) item_id", f"id + {number} version", "id % 7 = 0 deleted", "id size"), number)
    plan = plan_of(table.state())
    assert "Exchange" not in plan and "Bucketed: true" in plan
    # The files of a bucket are read together, whatever layer they are of.
    assert table.state().rdd.getNumPartitions() <= 4
    folder = table.spark.read.parquet(f"{table.root}/layer=5")
    assert folder.select(F.input_file_name()).distinct().count() == 4


def test_changes_are_the_only_rows_that_move(spark, table, monkeypatch):
    moved = []
    write = LayeredTable._write
    monkeypatch.setattr(LayeredTable, "_write", lambda self, rows, layer: (moved.append((layer, plan_of(rows))), write(self, rows, layer))[1])
    table.start(changes(spark, ("a", 1, False, 1)))
    table.append(changes(spark, ("a", 2, True, 1)), 0)
    table.compact(0)
    counts = {layer: len(re.findall(r"Exchange hashpartitioning", plan)) for layer, plan in moved}
    assert counts == {0: 1, 1: 1, 2: 0}


def test_a_deleted_key_stays_deleted_after_the_state_is_written(spark, table, rows):
    table.append(changes(spark, ("a", 5, True, None), ("b", 1, False, 2), (None, 1, False, 3)), 0)
    table.compact(0)
    table.append(changes(spark, ("a", 4, False, 9), ("b", 3, None, 7), ("c", None, False, 1)), 1)
    assert rows(table.state(), "item_id", "version", "size") == [("b", 3, 7), ("c", None, 1), (None, 1, 3)]
    table.compact(1)
    assert rows(table.state(), "item_id", "version", "size") == [("b", 3, 7), ("c", None, 1), (None, 1, 3)]
    assert rows(table.latest().where("item_id = 'a'"), "version", "deleted") == [(5, True)]


def test_uncommitted_layers_do_not_count_and_replays_replace(spark, table, tmp_path, rows):
    table.start(changes(spark, ("a", 1, False, 1)))
    table.append(changes(spark, ("a", 2, False, 2)), 0)
    table.append(changes(spark, ("a", 2, False, 3), ("b", 1, False, 1)), 0)
    assert rows(table.state(), "item_id", "size") == [("a", 3), ("b", 1)]
    # A write that failed leaves files without a marker.
    table.append(changes(spark, ("a", 9, True, 0)), 1)
    (tmp_path / "table" / "layer=3" / "_SUCCESS").unlink()
    assert table.layers() == [0, 1]
    assert rows(table.state(), "item_id", "size") == [("a", 3), ("b", 1)]
    # A state that is written again is not read from itself.
    table.append(changes(spark, ("a", 3, False, 4)), 1)
    table.compact(1)
    table.compact(1)
    assert rows(table.state(), "item_id", "size") == [("a", 4), ("b", 1)]


def test_older_layers_go_when_the_next_state_is_there(spark, table, monkeypatch):
    monkeypatch.setattr(layers, "COMPACT_AFTER", 2)
    table.start(changes(spark, ("a", 1, False, 1)))
    for number in range(4):
        table.append(changes(spark, ("a", number + 2, False, number)), number)
        if table.due():
            table.compact(number)
    # Two rounds make a state; the state before the last, and its changes, are kept for readers.
    assert table.layers() == [4, 5, 7, 8]
    assert [tuple(r) for r in table.state().select("version", "size").collect()] == [(5, 3)]


def test_empty_tables(spark, table):
    assert table.state().count() == 0
    table.start(changes(spark).limit(0))
    table.append(changes(spark).limit(0), 0)
    table.compact(0)
    assert table.state().count() == 0
