import functools
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from emberline import queries
from emberline.operators import events as E
from emberline.operators.linking import linked_in_blocks
from tests.test_spatial import metres

COLUMNS = "id long, lat double, lon double, acq_date date, frp double, daynight string"


def detections(spark, rows):
    return spark.createDataFrame([(k, a, b, None if d is None else date(2024, 1, 1) + timedelta(days=d), float(k), "N") for k, (a, b, d) in enumerate(rows)], COLUMNS)


def reached(rows, eps_days):
    near = lambda a, b: metres(*a[:2], *b[:2]) <= 750 and abs(a[2] - b[2]) <= eps_days
    want, found = list(range(len(rows))), [(a, b) for a in range(len(rows)) for b in range(a) if near(rows[a], rows[b])]
    changed = True
    while changed:
        changed = False
        for a, b in found:
            if want[a] != want[b]:
                want[a] = want[b] = min(want[a], want[b])
                changed = True
    return want


@pytest.mark.parametrize("eps_days", [0, 1, 3])
def test_components_across_blocks_and_chunks(spark, monkeypatch, eps_days):
    """Chains over borders of blocks in all directions, chunks of some rows, a dense site and all pairs judged by their outermost places first."""
    rng = random.Random(eps_days)
    spread = [(21 + rng.random() * 0.3, 72 + rng.random() * 0.3, rng.randrange(5)) for _ in range(500)]
    chain = [(22 + 0.004 * k, 71.5 + 0.004 * k, k // 2) for k in range(90)] + [(20.5, 71.0, k) for k in range(80)] + [(-0.5 + 0.004 * k, -0.5 + 0.004 * k, 7) for k in range(250)]
    site = [(22.7 + rng.random() * 0.01, 70 + rng.random() * 0.01, rng.randrange(4)) for _ in range(300)]
    rows = spread + chain + site
    rng.shuffle(rows)
    monkeypatch.setattr(E, "linked_in_blocks", functools.partial(linked_in_blocks, chunk_rows=40, chunk_pairs=50, few=4))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 15)
    try:
        got = {r["id"]: r["component"] for r in E.event_components(detections(spark, rows), eps_days=eps_days).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == dict(enumerate(reached(rows, eps_days)))


def test_few_rows_are_copied(spark):
    """A row goes to its block and, near a border, to the one before it; not to all cells around it."""
    rng = random.Random(31)
    det = detections(spark, [(21 + rng.random() * 2, 70 + rng.random() * 2, rng.randrange(100)) for _ in range(3000)])
    assert linked_in_blocks(det, 750.0, 1).count() <= 1.3 * 3000


def test_rows_without_place_or_day_are_alone(spark):
    rows = [(21.0, 72.0, 0), (None, 72.0, 0), (21.0, None, 0), (21.0, 72.0, None), (float("nan"), 72.0, 0), (float("nan"), 72.0, 0), (21.0, float("inf"), 0), (21.0, 72.0, 1)]
    linked = E.linked_rows(detections(spark, rows))
    assert {r["id"]: r["component"] for r in linked.collect()} == {**{k: k for k in range(8)}, 7: 0}
    assert linked.columns == [*detections(spark, rows).columns, "component"] and linked.filter("daynight is null or frp is null").count() == 0
    assert E.event_components(detections(spark, rows).limit(0)).count() == 0


def test_summaries_of_linked_rows_are_those_of_members(spark, small):
    det = queries.det(spark, small)
    members = E.event_members(det, E.event_components(det))
    rows, names = queries.members_of(spark, small)
    for summary in (lambda *a: E.event_table(*a, F.lit(date(2024, 12, 27))), E.event_behavior, E.frp_trend):
        assert sorted(summary(rows, names).collect()) == sorted(summary(det, members).collect())
