"""Registered queries without a SQL twin read all of their input and draw as often as the study."""

from catalog import QUERIES
from catalog.exposure_queries import exp
from copresence.plans import flows


def test_person_series_of_every_day_type(tables):
    keys = ["uid", "weekday", "holiday"]
    got = [tuple(r[k] for k in keys) for r in QUERIES["person_series_class"](tables).collect()]
    want = {tuple(r) for r in exp(tables).select(*keys).distinct().collect()}
    assert len(got) == len(want) and set(got) == want
    assert len({k[1:] for k in want}) > 1


def test_exposure_under_null_averages_50_replicates(tables, monkeypatch):
    seen = []
    plan = flows.null_from_visits

    def kept(*args):
        seen.append(plan(*args))
        return seen[-1]

    monkeypatch.setattr(flows, "null_from_visits", kept)
    QUERIES["exposure_under_null"](tables)
    (_, met, _), = seen
    assert {r["sim"] for r in met.select("sim").distinct().collect()} == set(range(1, 51))
