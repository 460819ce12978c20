"""Ancestry by pointer doubling: pointers are shuffled, common ones handled apart, missing parents stay roots."""
from barloom.operators import history as H
from barloom.sources import stage as stage_module


def test_pointers_are_not_broadcast_whole(spark, monkeypatch):
    rows = [(0, None)] + [(i, 0) for i in range(1, 700)] + [(1000, None)] + [(i, i - 1) for i in range(1001, 1050)] + [(2000, 9999)]
    plans, stage = [], stage_module.stage

    def told(d):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        return stage(d)
    monkeypatch.setattr(stage_module, "stage", told)
    got = {r.id: (r.root, r.depth) for r in H.ancestry(spark.createDataFrame(rows, "id long, parent_id long")).collect()}
    want = {0: (0, 0), **{i: (0, 1) for i in range(1, 700)}, **{i: (1000, i - 1000) for i in range(1000, 1050)}, 2000: (9999, 1)}
    assert got == want
    rounds = [p for p in plans if "_up2" in p]
    assert rounds and all("SortMergeJoin" in p for p in rounds)
