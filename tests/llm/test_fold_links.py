"""Components of links: right, and in few shuffles, for each of which the driver keeps plans and the figures of all tasks."""

from __future__ import annotations

import random

import pytest

from panelith.llm import neardup


def _links(spark, pairs):
    return spark.createDataFrame([(bytes([a >> 8, a & 255]), bytes([b >> 8, b & 255])) for a, b in pairs], "a binary, b binary")


def _jobs(spark, work):
    name = f"fold-{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = {int.from_bytes(r.id, "big"): int.from_bytes(r.root, "big") for r in work().collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def _roots(pairs):
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


@pytest.mark.parametrize("shape", ["chain", "random", "hub"])
def test_components(spark, shape):
    r = random.Random(3)
    pairs = {"chain": [(i + 1, i) for i in range(60)], "random": [(r.randrange(300), r.randrange(300)) for _ in range(170)], "hub": [(i, 500) for i in range(200)] + [(i, 7) for i in range(100, 300)] + [(900, 901)]}[shape]
    pairs = [p for p in pairs if p[0] != p[1]]
    got, _ = _jobs(spark, lambda: neardup._fold_links(_links(spark, pairs + pairs[:5])))
    assert got == _roots(pairs)


def test_stars_take_no_round(spark):
    """Links from the smallest member to all others are an answer already."""
    stars = [(c, c + i) for c in range(0, 400, 20) for i in range(1, 20)]
    got, jobs = _jobs(spark, lambda: neardup._fold_links(_links(spark, stars)))
    assert got == _roots(stars) and jobs <= 8, jobs

