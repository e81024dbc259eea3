"""Driver contract: entry() runs on sf0.001; names of queries and SQL agree."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_smoke(spark):
    df = _entry().entry(spark)
    assert df.count() > 0


def test_oracle_keys_subset_of_queries():
    m = _entry()
    assert set(m.oracle_sql()) <= set(m.queries())
    assert len(m.queries()) >= 100


def test_scratch_tables_can_be_cleared(spark):
    from roadlens.session import clear_scratch, scratch_path, scratch_table

    t = scratch_table(spark.range(3), "gone")
    assert t.count() == 3
    clear_scratch(spark)
    assert not os.path.exists(scratch_path(spark, "").removeprefix("file:"))
    assert scratch_table(spark.range(4), "again").count() == 4
