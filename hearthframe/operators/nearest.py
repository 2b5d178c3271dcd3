"""The best comparables of subjects within cells of one type, place and bin of dates, searched block by block in numpy.

Spark deals out the cells and bounds them; a task holds one cell. Similarities are those of comparables.similarity() to the
last decimal: the same double operations in the same order, then two decimal roundings.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Subjects scored at once, candidates they are scored with at once, and candidates of a bin of sizes.
BLOCK, SLICE, BIN = 64, 2_048, 512
EQUAL = ("style", "garage", "basement")
#: Above all that a rounding to hundredths adds.
SLACK = 0.011


def hundredths(total: np.ndarray) -> np.ndarray:
    """Doubles (of which negative ones stay below 0) as hundredths, rounded half up at the sixth decimal and then at the second."""
    millionths = np.floor(total * 1e6 + 0.5).astype(np.int64)
    out = (millionths + 5_000) // 10_000
    for at in zip(*np.nonzero((total >= 0) & np.isin(millionths % 10_000, (4_999, 5_000))), strict=True):  # where the last bit may tell
        exact = Decimal(repr(float(total[at]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)
        out[at] = int(exact.quantize(Decimal("0.01"), ROUND_HALF_UP) * 100)
    return out


def _codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal values; a null is -1 on the left and -2 on the right, so that nulls equal nothing."""
    both = pa.chunked_array([*left.chunks, *right.chunks], left.type).combine_chunks()
    indices = both.dictionary_encode()
    indices = (indices.combine_chunks() if isinstance(indices, pa.ChunkedArray) else indices).indices
    out = pc.fill_null(indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    a, b = out[: len(left)], out[len(left) :].copy()
    b[b < 0] = -2
    return a, b


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return pc.cast(column, pa.float64()).to_numpy()  # nulls are not numbers


def search(weights: dict[str, int], days: int, k: int) -> Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A function of the tables of a cell's subjects and candidates that gives (subject, candidate, hundredths, rank from 1) of each subject's k best.

    Both need _day, _size, _beds, _baths, _age, style, garage, basement, neighbourhood, area and number, candidates also _until.
    """

    def fade(gap: np.ndarray, zero: float) -> np.ndarray:
        out = 1.0 - gap / zero
        np.maximum(out, 0.0, out=out)
        out[np.isnan(out)] = 0.0
        return out

    def run(subjects: pa.Table, candidates: pa.Table):
        none = np.zeros(0, np.int64)
        n = candidates.num_rows
        if not subjects.num_rows or not n:
            return none, none, none, none
        names = ("_day", "_size", "_beds", "_baths", "_age")
        s = {x: _numbers(subjects[x]) for x in names}
        c = {x: _numbers(candidates[x]) for x in (*names, "_until")}
        c["_until"] = np.where(np.isnan(c["_until"]), np.inf, c["_until"])
        for x in (*EQUAL, "neighbourhood", "area", "number"):
            s[x], c[x] = _codes(subjects[x], candidates[x])
        place = candidates.select(["number"]).append_column("day", pa.array(-c["_day"]))
        rank = np.empty(n, np.int64)  # the later sale first, then the number by its bytes
        rank[pc.sort_indices(place, sort_keys=[("day", "ascending"), ("number", "ascending")]).to_numpy()] = np.arange(n)

        lacks = lambda x: np.isnan(s[x]).all() or np.isnan(c[x]).all()
        rest = sum(weights[w] for x, w in (("_beds", "bedrooms"), ("_baths", "bathrooms"), ("_age", "year_built")) if not lacks(x))
        rest += sum(weights[x] for x in EQUAL if np.isin(s[x], c[x]).any()) + weights["geography"]

        by_size = np.argsort(c["_size"], kind="stable")
        bins = []
        for part in np.array_split(by_size, max(1, n // BIN)):
            low, high = c["_size"][part[0]], c["_size"][part[-1]]
            part = part[np.argsort(c["_day"][part], kind="stable")]
            bins.append((low, high, c["_day"][part], part, {x: v[part] for x, v in c.items()}, rank[part]))
        lows = np.array([b[0] for b in bins])
        own = np.clip(np.searchsorted(lows, s["_size"], "right") - 1, 0, len(bins) - 1)
        order = np.lexsort((s["_size"] if len(bins) == 1 else s["_day"], own))
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        found = []
        for same in np.split(order, cuts):
            for at in range(0, len(same), BLOCK):
                found.append(block(same[at : at + BLOCK], s, bins, int(own[same[0]]), rest, n))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def block(rows: np.ndarray, s: dict, bins: list, own: int, rest: float, n: int):
        mine = {x: v[rows][:, None] for x, v in s.items()}
        first, last, small, large = mine["_day"].min(), mine["_day"].max(), mine["_size"].min(), mine["_size"].max()
        keys, whose = np.full((len(rows), k), -1, np.int64), np.zeros((len(rows), k), np.int64)

        def oldest(low: float, high: float) -> float | None:
            """The first day from which a candidate of these sizes can still be among the best of a subject; None if it cannot."""
            worst = keys.min()
            if worst < 0:
                return first - days
            gap = max(0.0, low - large, small - high)
            size = max(0.0, 1.0 - gap / (large if low > large else small) / 0.5)  # the subject that comes nearest
            spare = rest + weights["living_area"] * size + weights["recency"] - (worst // (n + 1)) / 100 + SLACK
            return None if spare < 0 else first - min(days, 730 * spare / weights["recency"] + 1)

        def visit(i: int) -> bool:
            low, high, day, part, theirs, rank = bins[i]
            if (since := oldest(low, high)) is None:
                return False
            stop = int(np.searchsorted(day, last, "right"))
            while stop > (start := int(np.searchsorted(day, since, "left"))):
                start = max(start, stop - SLICE)
                score(slice(start, stop), part, theirs, rank)
                stop = start
                if (since := oldest(low, high)) is None:
                    break
            return True

        def score(at: slice, part: np.ndarray, theirs: dict, rank: np.ndarray) -> None:
            t = {x: v[at][None, :] for x, v in theirs.items()}
            back = mine["_day"] - t["_day"]
            ok = (back >= 0) & (back <= days) & (t["_until"] > mine["_day"]) & (t["number"] != mine["number"])
            total = 0.0 + float(weights["geography"]) * np.where(t["neighbourhood"] == mine["neighbourhood"], 1.0, np.where(t["area"] == mine["area"], 0.5, 0.0))
            total += float(weights["living_area"]) * fade(np.abs(t["_size"] - mine["_size"]) / mine["_size"], 0.5)
            total += float(weights["recency"]) * fade(back, 730.0)
            total += float(weights["bedrooms"]) * fade(np.abs(t["_beds"] - mine["_beds"]), 3.0)
            total += float(weights["bathrooms"]) * fade(np.abs(t["_baths"] - mine["_baths"]), 3.0)
            total += float(weights["year_built"]) * fade(np.abs(mine["_age"] - t["_age"]), 50.0)
            for x in EQUAL:
                total += float(weights[x]) * (t[x] == mine[x])
            # those that may reach the worst one kept
            ok &= total >= np.where(keys.min(axis=1) < 0, -1.0, keys.min(axis=1) // (n + 1) / 100 - SLACK)[:, None]
            i, j = np.nonzero(ok)
            if not len(i):
                return
            new = hundredths(total[i, j]) * (n + 1) + (n - rank[at][j])
            i, new, who = np.concatenate([np.repeat(np.arange(len(rows)), k), i]), np.concatenate([keys.ravel(), new]), np.concatenate([whose.ravel(), part[at][j]])
            best = np.lexsort((-new, i))
            i, new, who = i[best], new[best], who[best]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            keep = nth < k
            keys[i[keep], nth[keep]], whose[i[keep], nth[keep]] = new[keep], who[keep]

        visit(own)
        for step in (-1, 1):
            i = own + step
            while 0 <= i < len(bins) and visit(i):
                i += step
        i, nth = np.nonzero(keys >= 0)
        return rows[i], whose[i, nth], keys[i, nth] // (n + 1), nth + 1

    return run
