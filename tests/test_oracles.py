"""Every query that SQL can say gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from filelake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(df):
    def text(v):
        if pd.isna(v):
            return ""
        return str(int(v)) if hasattr(v, "__int__") and not isinstance(v, str) and float(v) == int(v) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(text(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    assert rows(catalogue.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(catalogue.ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_readers_of_short_files_behind_heads(spark, tmp_path):
    # short files with the head of PNG, of which two lines look like a text's own
    docs = spark.createDataFrame([(3, "a,1\nb,2\nc"), (307, "one line"), (611, ""), (4, "x,y\nz")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = rows(catalogue.QUERIES["register_reader"](spark, str(tmp_path)).toPandas())
    assert got == rows(c.execute(catalogue.ORACLES["register_reader"]).fetchdf()) and len(got[1]) == 4
