"""Driver contract: entry() and the query/oracle registries."""

import importlib.util
import os
import re

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    e = _entry()
    df = e.entry(spark)
    assert df.columns == ["task", "split", "label", "n", "class_weight"]
    rows = df.collect()
    assert len(rows) > 0
    assert sum(r["n"] for r in rows) > 0


def test_registries_consistent():
    e = _entry()
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    own = {k for k in q if not re.match(r"op\d+_|pipeline$", k)}
    assert own == own & set(o)
