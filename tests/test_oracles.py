"""Every registered catalog query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quarry.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SLOW = {"kmeans_ivf_recall", "artifacts_of_index"}  # model training: the engine tests cover them


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[: -len('.parquet')]} AS SELECT * FROM '{path}'")
    return connection


def plain(x):
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return "nan" if math.isnan(x) else round(float(x), 6)
    return x


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_query_equals_its_sql(spark, tables, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    answer = tables.execute(catalog.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)
