"""The registered queries beside their SQL, and the pipeline beside plain Python."""

import duckdb
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from scenestream.llm.catalog import load
from tests.conftest import SF
from tools.check import TABLES, rows_of

from . import brute


@pytest.mark.parametrize("name", sorted(load().ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(load().ORACLES[name])
    names = [d[0] for d in cur.description]
    df = load().QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_one_query_for_each_operator():
    names = set(entry_module.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns
        old, new = {r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in after.collect()}
        assert after.count() == len(new) and set(new) <= set(old)
        if name == "near_dedup":
            assert set(new) == set(brute.similar_groups([(i, r["text"]) for i, r in old.items()]).values())
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(new) == {i for i, r in old.items() if not brute.windows(r["text"], items)[1]}
        if name == "secrets":
            assert set(new) == set(old)
            assert all((new[i]["text"] == r["text"]) or brute.secrets(r["text"]) or "[" in new[i]["text"] for i, r in old.items())
            assert not any(brute.secrets(r["text"]) for r in new.values())
        before = after
    mixed = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    kept = {r["doc_id"] for r in before.collect()}
    assert {r["doc_id"] for r in mixed} <= kept and all(1 <= r["copy"] <= 3 for r in mixed)
