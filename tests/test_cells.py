"""Comparables found within cells, cut into parts too, against joining every pair; similarities rounded as decimals are."""

import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

from hearthframe.operators import comparables as C
from hearthframe.operators import nearest
from tests.test_core import frame
from tests.test_search_bounds import ranked, sales


def test_cut_cells_equal_joining_every_pair(spark, monkeypatch):
    rows = frame(spark, sales(random.Random(9), 500)).dropDuplicates(["mls_number", "sold_date"])
    monkeypatch.setattr(C, "FEW_CANDIDATES", 1 << 40)
    whole = ranked(C.find_comparables(C.as_subjects(rows), C.as_candidates(rows))[1])
    for name, value in (("FEW_CANDIDATES", 3), ("CELL_SUBJECTS", 40), ("CELL_CANDIDATES", 60)):
        monkeypatch.setattr(C, name, value)
    comps = C.find_comparables(C.as_subjects(rows), C.as_candidates(rows))[1]
    assert ranked(comps) == whole and len(whole) > 2_000
    # what leaves the cells is ranked already: before, every scored pair was sorted by its subject
    assert "FlatMapCoGroupsInArrow" in comps._jdf.queryExecution().optimizedPlan().toString()


def test_hundredths_round_as_decimals():
    r = random.Random(4)
    x = [r.random() * 100 for _ in range(3000)] + [k / 100 + d for k in range(0, 9000, 7) for d in (0.005, 0.0049995, 0.00499949999, 0.0050005)]
    want = [int(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP).quantize(Decimal("0.01"), ROUND_HALF_UP) * 100) for v in x]
    assert nearest.hundredths(np.array(x)).tolist() == want
