import re
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
    assert e.plans.QUERIES.keys() <= q.keys()


def test_nothing_outside_needs_the_llm_folder():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_flagship(spark):
    df = e.entry(spark)
    assert df.columns == ["source_key", "new", "updated", "closed"] and df.count() == 4
