"""Every query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from strandlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
SLOW = {"tree_monophyly", "tree_common_ancestors", "tree_clades", "otu_names", "otu_lumping", "otu_components", "document_trigrams"}


def rows(frame, columns):
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    cell = lambda x: x if x is None or isinstance(x, (str, bool)) else round(float(x), 5) + 0.0 if hasattr(x, "__float__") else str(x)
    return sorted(repr(tuple(map(cell, r))) for r in plain.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(registry.queries()) - set(registry.WITHOUT_SQL) == set(registry.oracle_sql())
    assert registry.FLAGSHIP in registry.queries()


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - SLOW))
def test_query_matches_sql(name, spark, sf_dir, duck):
    want = duck.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
