"""Every registered query against its DuckDB SQL on a small scale; queries without SQL by their properties."""

import duckdb
import pandas as pd
import pytest

from spindrift import catalog

SF = "/root/testdata/sf0.001"


def rows(df):
    """Rows as sorted tuples of plain values, numbers as rounded floats, dates and nested values as text."""

    def plain(x):
        if x is None or x is pd.NA or (not hasattr(x, "__len__") and x != x):
            return None
        x = x.item() if hasattr(x, "item") and getattr(x, "ndim", 0) == 0 else x
        return round(float(x), 6) + 0.0 if isinstance(x, int | float) and not isinstance(x, bool) else x if isinstance(x, bool | str) else str(x)

    made = [tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(made, key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs_the_same_twice(spark, name):
    one, two = (catalog.QUERIES[name](spark, SF).toPandas() for _ in range(2))
    assert len(one) > 0 and rows(one.round(4)) == rows(two.round(4))


def test_samples_are_subsets_and_shuffles_permutations(spark):
    shuffled = catalog.QUERIES["shuffle_table_rows"](spark, SF).toPandas()
    assert sorted(shuffled.position) == list(range(1, len(shuffled) + 1)) and shuffled.o_orderkey.is_unique
    kept = catalog.QUERIES["text_random_lines"](spark, SF).toPandas()
    assert 0.2 < len(kept) / len(shuffled) < 0.4 and set(kept.o_orderkey) <= set(shuffled.o_orderkey)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
