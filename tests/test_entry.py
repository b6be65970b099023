import importlib
import sys

import __spark_entry__


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p1_found", "p3_found", "p4_found", "search_end_to_end"} <= set(queries)


def test_without_the_llm_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "cutloom.llm", None)
    entry = importlib.reload(__spark_entry__)
    assert "p2_found" not in entry.queries() and "p3_found" in entry.queries()
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "position", "kind", "cut_start_s", "cut_end_s"] and df.count() > 0
