"""Counter-based randomness: a draw is a hash of what it is for, so it does not depend on
partitions, retries or the order of rows. Spark, numpy and SQL compute the same one.

A draw takes 32-bit integers in two lanes. A lane takes in one counter after the other, each
by one turn: multiply by an odd number, exclusive or with a mask, then add the upper half to
the whole: high and low bits reach each other, and differences don't survive. All numbers stay below 2^63, so that nothing overflows
in a signed 64-bit column, and the last value is used once in each turn, so that an
expression grows with the number of turns only. The lanes' exclusive or is the draw; counters
of up to 64 bits are folded differently in each.

``u`` is in (0, 1] with 32 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 4294967296.0
LOW = 0xFFFFFFFF
#: Fixed odd multipliers below 2^31 of the two lanes: for counters, in order, and for the last turns.
COUNTERS = ((0x7FEB352D, 0x5BD1E995, 0x2C1B3C6D, 0x1B873593, 0x297A2D39, 0x45D9F3B), (0x21F0AAAD, 0x735A2D97, 0x3243F6A9, 0x165667B1, 0x6C8E9CF5, 0x4CF5AD43))
LAST = ((0x46CA68B1, 0x38B34AE5, 0x2545F491), (0x5A0A7F2B, 0x68E31DA5, 0x369DEA0F))
#: The mask of every turn.
MASK = 0x9E3779B9
#: Multipliers of a counter's upper 32 bits, and what seeds are mixed with.
UPPER = (0x3C6EF373, 0x1F83D9AB)
BEGIN = (0x6A09E667, 0x510E527F)


def _turned(x: int, by: int) -> int:
    z = x * by & LOW ^ MASK
    return z + (z >> 16) & LOW


def _begun(seed: int, lane: int) -> int:
    """A lane that has taken in the seed."""
    return _turned(_turned((seed + (seed >> 32) * UPPER[lane] & LOW) ^ BEGIN[lane], COUNTERS[lane][0]), COUNTERS[lane][1])


# ---------------------------------------------------------------- as Columns

def _column_turn(x: str, by: int) -> str:
    return f"(shiftright((({x} * {by}L) & {LOW}L ^ {MASK}L) * 65537L, 16) & {LOW}L)"


def _column_folded(c, lane: int) -> str:
    if isinstance(c, int):
        return f"{c + (c >> 32) * UPPER[lane] & LOW}L"
    c = f"coalesce(CAST({c} AS BIGINT), 0L)"  # where nothing can be null, the generated code isn't nested
    return f"((({c} & {LOW}L) + (shiftright({c}, 32) & {LOW}L) * {UPPER[lane]}L) & {LOW}L)"


def draw(seed: int, *of: int | str) -> Column:
    """A 32-bit integer for the given counters, integers or SQL expressions of them, five at most.
    It is parsed as one text: built of Columns, each part would be a call to the JVM."""
    lanes = []
    for lane in (0, 1):
        h = f"{_begun(seed, lane)}L"
        for c, by in zip(of, COUNTERS[lane], strict=False):
            h = _column_turn(f"({h} ^ {_column_folded(c, lane)})", by)
        for by in LAST[lane]:
            h = _column_turn(h, by)
        lanes.append(h)
    return F.expr(f"{lanes[0]} ^ {lanes[1]}")


def uniform(seed: int, *of: int | str) -> Column:
    return (draw(seed, *of) + 1) / F.lit(SCALE)


def pick(u: Column, n: Column | int) -> Column:
    """An index in 0 .. n-1; null where n is 0."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n > 0, F.least(F.floor(u * n), n.cast("long") - 1)).cast("int")


# -------------------------------------------------------------------- as SQL

def _sql_turn(x: str, by: int) -> str:
    return f"(xor({x} * {by} & {LOW}, {MASK}) * 65537 >> 16 & {LOW})"


def sql_draw(seed: int, *of) -> str:
    """The same draw in DuckDB SQL, of counters that are literals or expressions below 2^32."""
    lanes = []
    for lane in (0, 1):
        h = str(_begun(seed, lane))
        for c, by in zip(of, COUNTERS[lane], strict=False):
            c = str(c + (c >> 32) * UPPER[lane] & LOW) if isinstance(c, int) else f"CAST({c} AS BIGINT)"
            h = _sql_turn(f"xor({h}, {c})", by)
        for by in LAST[lane]:
            h = _sql_turn(h, by)
        lanes.append(h)
    return f"xor({lanes[0]}, {lanes[1]})"


def sql_uniform(seed: int, *of) -> str:
    return f"(({sql_draw(seed, *of)} + 1) / 4294967296.0)"


def sql_pick(u: str, n: str) -> str:
    return f"CAST(least(floor({u} * {n}), {n} - 1) AS INTEGER)"


# ------------------------------------------------------------- inside a task

def _turn_array(h: np.ndarray, by: int) -> np.ndarray:
    """In place, on 32-bit unsigned integers, which wrap."""
    h *= np.uint32(by)
    h ^= np.uint32(MASK)
    h += h >> np.uint32(16)
    return h


def _folded_array(c, lane: int) -> np.ndarray:
    if isinstance(c, (int, np.integer)):
        c = int(c)
        return np.uint32(c + (c >> 32) * UPPER[lane] & LOW)
    c = c.astype(np.int64, copy=False)
    upper = (c >> 32).astype(np.uint32)
    found = c.astype(np.uint32)
    if upper.any():
        found += upper * np.uint32(UPPER[lane])
    return found


class Draws:
    """Draws for rows of samples. What the samples alone decide is kept as long as the array
    of samples is the same."""

    def __init__(self, seed: int):
        self.seed, self.of, self.held = seed, None, None

    def integers(self, sample: np.ndarray, *of) -> np.ndarray:
        if self.of is not sample:
            self.of = sample
            self.held = [_turn_array(np.uint32(_begun(self.seed, lane)) ^ _folded_array(sample, lane), COUNTERS[lane][0]) for lane in (0, 1)]
        lanes = []
        for lane in (0, 1):
            h = self.held[lane].copy()
            for c, by in zip(of, COUNTERS[lane][1:], strict=False):
                h ^= _folded_array(c, lane)
                _turn_array(h, by)
            for by in LAST[lane]:
                _turn_array(h, by)
            lanes.append(h)
        return (lanes[0] ^ lanes[1]).astype(np.int64)

    def __call__(self, sample: np.ndarray, *of) -> np.ndarray:
        """As ``uniform``."""
        return (self.integers(sample, *of) + 1) / SCALE


def place(u: np.ndarray, n) -> np.ndarray:
    """As ``pick``, for n of at least 1."""
    return np.minimum((u * n).astype(np.int64), np.asarray(n) - 1)
