"""Model queries run with the operators' own defaults."""

import inspect
from unittest.mock import MagicMock

import pytest

from lanlore.learn import classify
from lanlore.queries import QUERIES

from .conftest import SF

FITS = ("random_forest", "boosted", "second_booster", "tuned_forest", "tuned_booster")
GIVEN = {"df", "features", "key", "label"}


@pytest.mark.parametrize(
    "name", ["mod2_forest", "mod3_tuned_forest", "mod3_tuned_booster", "mod4_boosted", "mod5_second_booster", "mod6_ensemble", "mod7_importances", "ord2_top_features", "e2e_hybrid_scoring"]
)
def test_no_default_is_cut(spark, monkeypatch, name):
    calls = []

    def recording(real):
        def fit(*args, **params):
            calls.append(set(inspect.signature(real).bind(*args, **params).arguments))
            return (MagicMock(), {"maxDepth": 5}) if real.__name__.startswith("tuned") else MagicMock()

        return fit

    for fit in FITS:
        monkeypatch.setattr(classify, fit, recording(getattr(classify, fit)))
    monkeypatch.setattr(classify, "Ensemble", MagicMock())
    monkeypatch.setattr("lanlore.operators.summary.top_features", MagicMock())
    monkeypatch.setattr("lanlore.plans.scoring.score_batch", MagicMock())
    QUERIES[name](spark, SF)
    assert calls and all(c <= GIVEN for c in calls)
