"""The queries on boosted fits ask for whole presets; nothing is fitted here."""

from unittest.mock import MagicMock

import pytest

from parityframe.operators import learners as ml
from parityframe.plans import flows, q_flows
from parityframe.plans import q_learners as ql
from parityframe.plans.catalog import QUERIES

PRESET = ml.PRESETS["boost_a"]


class Asked(Exception):
    """What a query asked of the estimator that it first builds."""


@pytest.fixture
def asked(monkeypatch):
    """Tables are stand-ins, and building a booster raises Asked."""
    def boosted(preset=None, **params):
        raise Asked(ml.PRESETS.get(preset, {}) | params)
    monkeypatch.setattr(ql, "prepared", lambda spark, sf: (MagicMock(), MagicMock()))
    monkeypatch.setattr(ml, "logistic", MagicMock())
    monkeypatch.setattr(ml, "boosted", boosted)

    def first(build, *args, **kw):
        with pytest.raises(Asked) as e:
            build(*args, **kw)
        return e.value.args[0]
    return first


def _call(monkeypatch, owner, name, query):
    """The arguments with which a query calls an operator."""
    seen = MagicMock(side_effect=Asked)
    monkeypatch.setattr(owner, name, seen)
    with pytest.raises(Asked):
        query(None, None)
    return seen.call_args


def test_flow_mitigation_is_whole(asked, monkeypatch):
    monkeypatch.setattr(q_flows, "raw_orders", MagicMock())
    call = _call(monkeypatch, flows, "full_mitigation", q_flows.q_flow_mitigation)
    make = call.args[3]
    assert call.kwargs.get("depths", ml.ELBOW_DEPTHS) == ml.ELBOW_DEPTHS
    assert asked(make, 0) == PRESET
    assert asked(make, 0, maxDepth=9) == PRESET | {"maxDepth": 9}


def test_flow_leaderboard_is_whole(asked, monkeypatch):
    monkeypatch.setattr(q_flows, "raw_orders", MagicMock())
    call = _call(monkeypatch, flows, "full_leaderboard", q_flows.q_flow_leaderboard)
    assert asked(call.args[2]["boosted"], 0) == PRESET


def test_early_stop_and_elimination_have_the_depth(asked, monkeypatch):
    assert asked(ql.q_early_stop_model, None, None) == PRESET
    call = _call(monkeypatch, ml, "rfecv", ql.q_rfecv_trees)
    assert asked(call.args[0], 0)["maxDepth"] == PRESET["maxDepth"]


@pytest.mark.parametrize("name", ["gbt_scores", "importance_gain", "importance_weight", "eval_history", "eval_history_chosen",
                                  "early_stop_model", "model_overfit", "model_leaderboard", "model_fairness_audit"])
def test_single_fits_are_whole(asked, name):
    assert asked(QUERIES[name], None, None) == PRESET


def test_grid_elbow_and_elimination_are_whole(asked, monkeypatch):
    make, grid, _ = _call(monkeypatch, ml, "grid_search", ql.q_grid_search).args
    assert grid == ml.GRID_18 and asked(make, 0, maxIter=300, maxDepth=8) == PRESET | {"maxIter": 300, "maxDepth": 8}
    make, depths, _ = _call(monkeypatch, ml, "depth_elbow", ql.q_depth_elbow).args
    assert depths == ml.ELBOW_DEPTHS and asked(make, 9) == PRESET | {"maxDepth": 9}
    assert asked(_call(monkeypatch, ml, "rfecv", ql.q_rfecv_trees).args[0], 0) == PRESET


def test_eval_history_has_both_names():
    assert QUERIES["eval_history_leaves"] is QUERIES["eval_history"]
