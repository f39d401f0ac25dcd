"""Registered fits do the whole job of their operators: no parameter lowers trees, folds or floors. Independent fits run side by side."""

import inspect
import threading

from marketloom.operators import calibration, models
from marketloom.plans import pricing, registry


def asked(monkeypatch, spark, name, operator, answer):
    """The arguments that a query gives its operator, defaults filled in."""
    found, signature = {}, inspect.signature(getattr(calibration, operator))

    def noted(*args, **more):
        bound = signature.bind(*args, **more)
        bound.apply_defaults()
        found.update(bound.arguments)
        return answer

    monkeypatch.setattr(pricing.c, operator, noted)
    monkeypatch.setattr(pricing, "training", lambda t: None)
    registry.QUERIES[name](spark, "")
    return found


def test_stopped_trees_may_grow_to_the_full_number(spark, monkeypatch):
    got = asked(monkeypatch, spark, "m07_stopped_trees", "stopped_trees", ([60, 61, 62], 61))
    assert (got["folds"], got["most"], got["least"]) == (3, 200, 50)


def test_backtest_has_all_folds_and_trees(spark, monkeypatch):
    got = asked(monkeypatch, spark, "m21_backtest", "backtest", None)
    assert (got["splits"], got["trees"]) == (5, calibration.LEAST_TREES) == (5, 50)


def test_fits_run_side_by_side(spark):
    met = threading.Barrier(2, timeout=60)
    assert models.side_by_side(spark, [lambda k=k: (met.wait(), spark.range(k).count())[1] for k in (5, 7)]) == [5, 7]
