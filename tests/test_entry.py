"""The driver contract, and that nothing outside needs the training-data operators."""

import os
import re

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract():
    found, sql = entry.queries(), entry.oracle_sql()
    assert "hybrid_rrf" in found and set(sql) <= set(found)
    assert all(callable(f) for f in found.values())


def test_nothing_outside_imports_the_training_operators():
    for base, _, names in os.walk(os.path.join(ROOT, "basalt")):
        if os.path.basename(base) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert not re.search(r"basalt\.llm|from \.+llm", open(os.path.join(base, n)).read()), n


def test_entry_runs(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        df = entry.entry(spark)
        assert df.columns == ["id", "score"] and df.count() == 10
