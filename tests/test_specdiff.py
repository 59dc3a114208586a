"""One pair of snapshots for each rule, each with a twin that must stay silent."""

import json

import pytest

from faultline import cases
from faultline.operators import specdiff
from faultline.sources import specs


CASES = cases.SPECS


@pytest.fixture(scope="module")
def records(spark):
    sides = [spark.createDataFrame([(name, json.dumps(case[k])) for name, *case in CASES] + [("broken", "{"), ("nothing", None)], "spec_id string, spec string") for k in (0, 1)]
    found = {}
    for r in specdiff.diff(*(specs.facts(s) for s in sides)).collect():
        found.setdefault(r.spec_id, []).append((r.kind, r.breaking, r.anchor, r.detail))
    return found


@pytest.mark.parametrize("name,want", [(c[0], c[3]) for c in CASES])
def test_rule(records, name, want):
    assert sorted(records.get(name, [])) == sorted(want)


def test_change_rows(spark):
    r = spark.createDataFrame([("k", True, "GET /x", "d"), ("w", False, "GET /y", None), (None, True, "z", "")], "kind string, breaking boolean, anchor string, detail string")
    rows = specdiff.to_changes(r, "acme", "1-to-2", "2024-01-01").collect()
    assert [(x.title, x.change_type) for x in rows] == [("k: GET /x d", "breaking"), ("w: GET /y", "additive")]
