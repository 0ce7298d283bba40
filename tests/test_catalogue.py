"""Every registered query against its DuckDB oracle (sf0.001), plus entry() and
held-out accuracy bounds for the classifier queries (sf0.01)."""

import os

import pytest

import __spark_entry__ as entry_mod
from quire.plans import catalogue, catalogue_ml
from tests.conftest import SF_CHECK, SF_SMALL
from tests.oracle_check import compare, duck

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver test data absent")

ORACLE = catalogue.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    # the learned encoder has no SQL form; test_lsa.py holds it against numpy
    assert set(catalogue.QUERIES) - set(ORACLE) == {"lsa_embed"} and set(ORACLE) <= set(catalogue.QUERIES)
    assert set(ORACLE) <= set(entry_mod.oracle_sql()) and set(catalogue.QUERIES) <= set(entry_mod.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = entry_mod.queries()[name](spark, SF_SMALL)
    status, a, b, msg = compare(df, con, ORACLE[name])
    assert status == "OK", (name, a, b, msg)


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["categories", "year", "n"]
    assert df.count() >= 0


def test_classifier_learns(spark):
    m = catalogue_ml.ovr_scores(spark, SF_CHECK)[0].first()
    assert m.top1 > 0.8 and m.top3 >= m.top1 and m.n > 0 and m.n_unseen == 0
    assert m.perplexity < 4.0                       # 4 classes: uniform guess = 4


def test_ablation_learns(spark):
    sets = {"abstracts": ["abstract_emb"], "all": ["title_emb", "abstract_emb", "cocitation"]}
    rows = {r.feature_set: r for r in catalogue_ml.ablation_scores(spark, SF_CHECK, sets)[0].collect()}
    assert set(rows) == set(sets)
    assert all(r.top1 > 0.8 and r.perplexity < 4.0 and r.n == 200 for r in rows.values())


def test_summary_pipeline(spark):
    rows = catalogue_ml.confusion_table(spark, SF_CHECK).collect()
    labels = {r.actual for r in rows}
    assert labels == {"de", "en", "es", "fr"}
    assert len(rows) == 16                                    # dense 4 x 4, zeros included
    diag = sum(r.cnt for r in rows if r.actual == r.predicted)
    assert diag / sum(r.cnt for r in rows) > 0.8
    assert all(r.cell == "" for r in rows if r.cnt == 0)


def test_two_feeds_live_side_by_side(spark):
    one = entry_mod.queries()["feed_entries"](spark, SF_SMALL)
    two = entry_mod.queries()["feed_batch"](spark, SF_SMALL)
    n = one.count()
    assert two.count() < n == one.count()


def test_a_run_leaves_nothing(spark):
    from quire.session import path_exists, stored_stages
    with stored_stages(spark) as run:
        entry_mod.queries()["index_roundtrip"](spark, SF_SMALL).collect()
        paths = list(run)
        assert len(paths) >= 2
    assert not any(path_exists(spark, p) for p in paths)
