"""Registered queries against their SQL twins."""

import json

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from liftlens.plans.queries import QUERIES

@pytest.fixture(scope="module")
def db(small_dir):
    return connect(small_dir)


def test_every_query_but_the_document_has_a_twin():
    assert set(QUERIES) - set(oracle_sql()) == {"result_export"}


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) & set(QUERIES)))
def test_query_equals_its_twin(spark, db, small_dir, name):
    assert differences(db, queries()[name](spark, small_dir), oracle_sql()[name]) == ""


def test_entry_returns_the_evaluation(spark):
    rows = entry(spark).collect()
    assert sorted(r.hypothesis_id for r in rows) == ["H1", "H2", "H3", "H4", "H5"]


def test_document_holds_every_part(spark, small_dir):
    document = json.loads(queries()["result_export"](spark, small_dir).first().document)
    assert [h["hypothesis_id"] for h in document["hypotheses"]] == ["H1", "H2", "H3", "H4", "H5"]
    assert len(document["ctr_curve"]) == 13 and len(document["ablation"]) == 9 and len(document["placebo"]) == 4
    assert document["data_period"] == {"start": "2024-01-01", "end": "2024-01-30"}
    assert document["ctr_model"] == {"model_version": "ctr-bins-v1", "train_end_exclusive": "2024-01-17", "available_until": "2024-01-27"}
    series = document["series"][0]
    assert (series["metric"], series["lower_is_better"], series["ramp_weeks"]) == ("position", True, 1) and series["metric_label"]
    assert len(series["weeks"]) == len(series["values"])
    assert document["hypotheses"][4]["ci_low"] is None
