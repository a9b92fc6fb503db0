"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from quietframe.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    ours, theirs = registry.queries()[name](spark, DIR).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs)
    keys = [c for c in columns if ours[c].dtype.kind in "iOb"] or columns
    a, b = (x[columns].sort_values(keys).reset_index(drop=True) for x in (ours, theirs))
    for c in columns:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    out = registry.queries()[name](spark, DIR).toPandas()
    assert len(out) and not out.isna().any().any()


def test_similar_bins_cover_all_frames(spark):
    rows = registry.spectra(spark, DIR).count()
    assert registry.queries()["q_similar_bins"](spark, DIR).count() == rows


def test_partitions_do_not_matter(spark):
    a = registry.queries()["q_denoise_1d"](spark, DIR).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = registry.queries()["q_denoise_1d"](spark, DIR).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    by = ["stream_id", "pos"]
    pd.testing.assert_frame_equal(a.sort_values(by).reset_index(drop=True), b.sort_values(by).reset_index(drop=True))
