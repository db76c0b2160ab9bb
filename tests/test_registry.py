"""Every registered query against its checking SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as registry  # noqa: E402
import check  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = registry.queries()[name](spark, SF_DIR).toPandas()
    want = db.sql(registry.oracle_sql()[name]).df()
    assert sorted(got) == sorted(want)
    assert check.frame_rows(got) == check.frame_rows(want)
    assert len(got) > 0


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_model_query_gives_rows(spark, name):
    frame = registry.queries()[name](spark, SF_DIR)
    assert frame.count() > 0
    if "y_prob" in frame.columns:
        assert frame.where("y_prob < 0 OR y_prob > 1 OR y_prob IS NULL").count() == 0


def test_the_next_price_gives_the_label_away(spark):
    """With the next price among the features the area is nearly 1; without it there is little skill."""
    from pricetide.catalog import queries as q
    from pricetide.operators import metrics as mt
    from pricetide.operators import model as md

    rows = q._model_rows(q.StandIns(spark, "/root/testdata/sf0.01"))
    areas = {}
    for features in (md.LEAKY_FEATURES, md.FEATURES):
        model = md.train_classifier(rows.where("split = 'train'"), features, q.BOOST)
        scored = md.score(model, rows.where("split = 'test'")).withColumnRenamed(md.LABEL, "y_true")
        areas[len(features)] = mt.roc_auc(scored).first().roc_auc
    assert areas[6] > 0.99 and 0.5 < areas[5] < 0.8


def test_entry(spark):
    result = registry.entry(spark)
    assert result.columns == ["brand", "records", "change_rate"]
    assert result.agg({"records": "sum"}).first()[0] == 1000


def test_oracles_are_for_registered_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_slice_of_models_has_only_what_they_need(spark, monkeypatch):
    from pricetide.catalog import queries
    from pricetide.catalog.standins import StandIns

    kept, write = {}, queries.written
    monkeypatch.setattr(queries, "written", lambda df, name: kept.setdefault(name, df.columns) and write(df, name))
    rows = queries._model_rows(StandIns(spark, SF_DIR))
    assert kept["slice"] == kept["encoded"] == rows.columns
