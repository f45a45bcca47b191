"""Every registered query of the code-audit part against its SQL oracle, on the smallest tables."""

from __future__ import annotations

import pytest

from auditspark.jobs import MODULES

QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLE = {n: q for m in MODULES for n, q in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(name, spark, sf_dir, duck, same_rows):
    same_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "clone_pairs" in entry.queries()
