"""The driver's entry points, and a sample of queries beside their SQL."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests.conftest import SF
from tools.check import TABLES, rows_of

SAMPLE = [
    "alert_search", "alert_rollup", "alert_kpis", "segment_hits", "pose_fallen", "labels_render", "annotation_errors",
    "match_boxes", "class_metrics", "map50_95", "match_events", "eval_tripwire", "train_val_split", "model_lineage",
    "rule_tripwire_untracked", "rule_proximity", "area_counts", "camera_gaps", "nms", "unmatched_extra",
]


def test_names_need_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 110"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry_module.__file__.rsplit("/", 1)[0])


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = entry_module.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())
