"""duration_route gives every incident's duration, by the survival median of the whole population where its end is missing."""

from roadlens.plans.registry import load_all

from .conftest import SF_SMALL


def test_every_route_has_its_duration(spark):
    rows = load_all()["duration_route"].build(spark, SF_SMALL).collect()
    summary = {r.grp: r.median_duration for r in load_all()["km_median"].build(spark, SF_SMALL).collect()}
    assert {r.route for r in rows} == {"model", "survival", "historical"}
    assert {r.duration for r in rows if r.route == "survival"} == {summary["__population__"]}
    assert {r.duration for r in rows if r.route == "historical"} <= {45.0, 70.0, 120.0, 60.0, 90.0}
    assert all(r.duration is not None for r in rows)
