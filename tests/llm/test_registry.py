"""The registered corpus queries: SQL where there is some, all of them run."""

import duckdb
import pytest

import __spark_entry__ as E
from wardstat.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that SQL cannot express; each has a brute-force test of its own.
NO_SQL = {"op2_toxicity", "op3_language", "op4_fingerprints", "op5_pieces", "op6_token_files", "op8_licences", "op9_decontaminate",
          "op10_near_dups", "op11_alignment"}


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))
    assert set(QUERIES) - set(ORACLE) == NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in got.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_rows_only_queries_run(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert QUERIES[name](spark, SF).count() == docs
