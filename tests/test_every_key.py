"""Keys that have no SQL to compare with: they build and run on the smallest tables (with small trees, fitted once)."""

import pytest

from roadlens.operators import models
from roadlens.plans import model_reports
from roadlens.plans.registry import load_all

from .conftest import SF_SMALL

KEYS = sorted(k for k, e in load_all().items() if not e.sql)


@pytest.fixture(scope="module", autouse=True)
def small_trees():
    fit, held = models.fit_gbt, dict(model_reports._fits)
    models.fit_gbt = lambda *a, **k: fit(*a, max_iter=3, max_depth=3)
    model_reports._fits.clear()
    yield
    models.fit_gbt = fit
    model_reports._fits.clear()
    model_reports._fits.update(held)


@pytest.mark.parametrize("key", KEYS)
def test_key_runs(spark, key):
    df = load_all()[key].build(spark, SF_SMALL)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
