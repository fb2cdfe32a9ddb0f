"""Every catalog query against its SQL on the smallest tables."""

import pytest

from runscope.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_run_estimates_are_bounds(spark, sf_dir):
    x = catalog.QUERIES["f20_run_estimates"](spark, sf_dir)
    assert x.where("not (lower <= seconds_remaining and seconds_remaining <= upper and confidence between 0 and 1)").count() == 0
    assert {r["method"] for r in x.select("method").distinct().collect()} <= {"complete", "bootstrap", "weighted"}
