"""The registered queries: names, SQL twins at sf0.001, and results of the right shape."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from labeldist.llm.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op3": {"query_id", "rank", "vec_id", "score"}, "op4": {"vec_id", "n_links", "component_id", "kept"},
    "op5": {"doc_id", "n_shingles", "component_id"}, "op7": {"doc_id", "held_out", "score", "predicted"},
    "op8": {"doc_id", "size", "source_size", "target", "taken"}, "op9": {"doc_id", "held_out", "lang_pred", "score"},
    "op11": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"}}


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())


def values(rows, cols):
    order = sorted(cols)
    return sorted((tuple(r[cols.index(c)] for c in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_equals_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[key](spark, SF)
    res = con.execute(ORACLE[key])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert values([tuple(r) for r in df.collect()], df.columns) == values(res.fetchall(), cols)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_every_row_and_finite_numbers(spark, key):
    df = QUERIES[key](spark, SF)
    assert COLUMNS.get(key.split("_")[0], set()) <= set(df.columns)
    rows = [r.asDict() for r in df.collect()]
    table, key_col = ("embeddings", "vec_id") if "vec_id" in df.columns else ("documents", "doc_id")
    assert {r[key_col] for r in rows} == {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key_col).collect()}
    assert all(math.isfinite(v) for r in rows for v in r.values() if isinstance(v, float))
