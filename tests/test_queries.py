"""Every core query with SQL of its own is held against DuckDB."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from vecspark.functions.distance import quantize
from vecspark.operators.knn import knn_batch
from vecspark.queries import ORACLE_SQL, QUERIES, built, vectors


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def canonical(df):
    cols = sorted(df.columns)
    said = df[cols].map(lambda x: repr(round(float(x), 5) + 0.0) if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x))
    return cols, sorted(map(tuple, said.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    assert canonical(QUERIES[name](spark, sf_dir).toPandas()) == canonical(duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize(("options", "k", "effort", "exact", "least"), [("type=IVF,dim=64,nlist=16", 5, 8, "L2", 0.95), ("type=HNSW,dim=64,M=16,ef=100", 5, 100, "L2", 0.95), ("type=HNSW_BV,dim=64,M=16,ef=100", 10, 100, "HAMMING", 0.95)])
def test_recall(spark, sf_dir, options, k, effort, exact, least):
    """Every vector is a query here."""
    df = vectors(spark, sf_dir)
    ask = df.selectExpr("id AS qid", "vec AS searchvec")
    _, index, _ = built(spark, sf_dir, options)
    got = index.search_batch(ask, k, effort).collect()
    flat = lambda x, c: x.withColumn(c, quantize(F.col(c))) if exact == "HAMMING" else x
    want = knn_batch(flat(df, "vec"), flat(ask, "searchvec"), k, exact).collect()
    assert len({(r.qid, r.id) for r in got}) == len(got) == len(want)
    last = {r.qid: r.distance for r in want if r["rank"] == k}  # a row as near as the last one counts, whatever its id
    assert sum(r.distance <= last[r.qid] + 1e-5 for r in got) >= least * len(want)


def test_whole_vectors_are_parsed_and_displayed(spark, sf_dir):
    rows = QUERIES["construct_parse"](spark, sf_dir).groupBy("id", "form").count().collect()
    assert {r["count"] for r in rows} == {64} and len(rows) == 4 * len({r.id for r in rows})
    assert all(r.text.count(",") == 63 for r in QUERIES["display_prec"](spark, sf_dir).collect())


def test_entry_imports_and_names():
    import __spark_entry__ as e

    assert set(ORACLE_SQL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
