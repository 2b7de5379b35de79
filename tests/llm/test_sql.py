"""Corpus queries that SQL can say give the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from filelake.llm import registry

TABLES = "documents embeddings pages conversations".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_corpus_query_matches_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want, got = duck.execute(registry.ORACLES[name]).fetchdf(), registry.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda df: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, int | float) else str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)
