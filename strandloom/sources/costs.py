"""Cost models: position-dependent costs and quality mangles, read on the driver (they are settings of a run)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S
from ..functions.mangle import run_script
from ..operators.align import Cost, Grid, Region


class _Words:
    def __init__(self, words: list[str]):
        self.words, self.at = words, 0

    def word(self) -> str:
        if self.at >= len(self.words):
            raise ValueError("a cost specification ends early")
        self.at += 1
        return self.words[self.at - 1]

    def number(self) -> int:
        return int(self.word())


def _cost(w: _Words) -> Cost:
    open_, extend, close, n = (w.number() for _ in range(4))
    chars = tuple(w.number() for _ in range(n))
    return Cost(open_, extend, close, chars, tuple(tuple(w.number() for _ in range(n)) for _ in range(n)))


def parse_costs(text: str) -> dict[str, list[Region]]:
    """Regions by reference: a name, the default cost, a count of regions (four bounds, a cost each), and ``|``; -1 is unbounded."""
    out: dict[str, list[Region]] = {}
    for block in text.split("|")[:-1]:
        w = _Words(block.split())
        name = w.word()
        regions = [Region(None, None, None, None, _cost(w))]
        for _ in range(w.number()):
            bounds = [None if x < 0 else x for x in (w.number() for _ in range(4))]
            regions.append(Region(*bounds, _cost(w)))
        out[name] = regions
    return out


@dataclass(frozen=True)
class Mangle:
    """Scripts for bases of quality (ASCII) ``low`` to ``high``."""

    low: int
    high: int
    pairs: tuple[tuple[int, int, tuple[tuple[str, int], ...]], ...] = ()
    open: tuple[tuple[str, int], ...] = ()
    extend: tuple[tuple[str, int], ...] = ()
    close: tuple[tuple[str, int], ...] = ()

    def apply(self, cost: Cost) -> Cost:
        """The cost with the scripts applied; pairs name the reference byte, then the read byte."""
        mm = [list(r) for r in cost.mm]
        place = {c: i for i, c in enumerate(cost.chars)}
        for a, b, ops in self.pairs:
            if a in place and b in place:
                mm[place[a]][place[b]] = run_script(mm[place[a]][place[b]], list(ops))
        new = [run_script(getattr(cost, k), list(getattr(self, k))) for k in ("open", "extend", "close")]
        return Cost(*new, cost.chars, tuple(tuple(r) for r in mm))


@dataclass(frozen=True)
class MangleSet:
    """Mangles for reference places low..high-1 (None: wherever no other set is)."""

    low: int | None
    high: int | None
    mangles: tuple[Mangle, ...]

    def find(self, quality: int) -> int | None:
        return next((i for i, m in enumerate(self.mangles) if m.low <= quality <= m.high), None)


def rebase_mangles(sets: list[MangleSet], start: int, end: int) -> list[MangleSet]:
    """The sets that touch reference places start..end-1, cut to them and moved so that ``start`` is 0; the default stays."""
    own = [s for s in sets if s.low is None or (s.low < end and s.high > start)]
    return [s if s.low is None else MangleSet(max(s.low - start, 0), min(s.high, end) - start, s.mangles) for s in own]


def _ops(words: list[str]) -> tuple[tuple[str, int], ...]:
    text = " ".join(words)
    found = re.findall(r"([-+*/=])\s*(-?\d+)", text)
    if re.sub(r"([-+*/=])\s*(-?\d+)", "", text).strip():
        raise ValueError(f"malformed operations {text!r}")
    return tuple((op, int(n)) for op, n in found)


def parse_mangles(text: str) -> dict[str, list[MangleSet]]:
    """Mangle sets by reference: ``r NAME`` ... ``R``, in it mangles ``q low [high]`` ... ``Q`` and position sections ``p low high`` ... ``P``."""
    out: dict[str, list[MangleSet]] = {}
    name, sets, section, mangle = None, [], None, None
    for raw in text.replace("\r", "").split("\n"):
        words = raw.split()
        if not words:
            continue
        key = words[0]
        if key == "r":
            name, sets, section = words[1], [(None, None, [])], None
        elif key == "R":
            out[name] = [MangleSet(lo, hi, tuple(ms)) for lo, hi, ms in sets]
            name = None
        elif key in "pP" and len(words) == 3:
            section = (int(words[1]), int(words[2]), [])
            sets.append(section)
        elif key in "pP":
            section = None
        elif key == "q":
            mangle = {"low": int(words[1]), "high": int(words[-1]), "pairs": []}
        elif key == "Q":
            (section or sets[0])[2].append(Mangle(**{**mangle, "pairs": tuple(mangle["pairs"])}))
            mangle = None
        elif key == "~":
            mangle["pairs"].append((int(words[1]), int(words[2]), _ops(words[3:])))
        elif key in ("Go", "Gx", "Gc"):
            mangle[{"Go": "open", "Gx": "extend", "Gc": "close"}[key]] = _ops(words[1:])
        else:
            raise ValueError(f"unknown line {raw!r}")
    if name is not None:
        raise ValueError(f"the mangles of {name} do not end")
    return out


def mangle_grid(grid: Grid, sets: list[MangleSet], start: int, qualities: str) -> Grid:
    """The grid of a window that begins at reference place ``start`` with the mangles of each read base; places before and after the read keep their costs."""
    index, costs = grid.index.copy(), list(grid.costs)
    known: dict[tuple[int, int, int], int] = {}
    for x in range(index.shape[0]):
        place = start + x - 2
        k = next((k for k, s in reversed(list(enumerate(sets))) if s.low is not None and s.low <= place < s.high), 0)
        if not sets:
            break
        for y, q in enumerate(qualities):
            m = sets[k].find(ord(q))
            if m is None:
                continue
            key = (int(grid.index[x, y + 2]), k, m)
            if key not in known:
                known[key] = len(costs)
                costs.append(sets[k].mangles[m].apply(grid.costs[key[0]]))
            index[x, y + 2] = known[key]
    return Grid(index, costs)


def _whole(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def read_costs(spark: SparkSession, path: str) -> dict[str, list[Region]]:
    return parse_costs(_whole(spark, path))


def read_mangles(spark: SparkSession, path: str) -> dict[str, list[MangleSet]]:
    return parse_mangles(_whole(spark, path))


def cost_table(spark: SparkSession, costs: dict[str, list[Region]]) -> DataFrame:
    """The regions as rows."""
    rows = [(n, i, r.start_a, r.end_a, r.start_b, r.end_b, r.priority, r.cost.open, r.cost.extend, r.cost.close, list(r.cost.chars), [list(x) for x in r.cost.mm]) for n, rs in costs.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, S.COST_REGION)


def mangle_table(spark: SparkSession, mangles: dict[str, list[MangleSet]]) -> DataFrame:
    """The scripts as rows, one for each pair or gap cost."""
    rows = []
    for name, sets in mangles.items():
        for k, s in enumerate(sets):
            for m in s.mangles:
                for a, b, ops in m.pairs:
                    rows.append((name, s.low, s.high, k, m.low, m.high, "~", a, b, [(o, n) for o, n in ops]))
                for target, ops in (("Go", m.open), ("Gx", m.extend), ("Gc", m.close)):
                    if ops:
                        rows.append((name, s.low, s.high, k, m.low, m.high, target, None, None, [(o, n) for o, n in ops]))
    return spark.createDataFrame(rows, S.MANGLE)


def generate_costs(lengths: list[tuple[str, int]], regions: list[tuple[str, int, int]], chars: str = "ACGT", default: tuple[int, int, int, int] = (1, -6, -5, -5), inside: tuple[int, int, int, int] = (1, -6, -4, 0)) -> str:
    """A cost file: for each reference the default cost and the cost inside its regions; each cost is (match, mismatch, open, extend), the close cost is the open cost."""
    def spec(c: tuple[int, int, int, int]) -> str:
        match, miss, open_, extend = c
        mm = " ".join(str(match if a == b else miss) for a in chars for b in chars)
        return f"{open_} {extend} {open_} {len(chars)} {' '.join(str(ord(x)) for x in chars)} {mm}"

    out = []
    for name, length in lengths:
        own = [(s, min(e, length)) for c, s, e in regions if c == name and s < length]
        out.append("\n".join([name, spec(default), str(len(own)), *[f"{s} {e} -1 -1 {spec(inside)}" for s, e in own], "|"]))
    return "\n".join(out) + "\n"
