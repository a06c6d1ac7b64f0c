"""Random numbers as BIGINT arithmetic: independent of partitioning, the same in any SQL engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def long(x: int) -> Column:
    return F.lit(x).cast("long")


def mixed(key: Column, salt: int | Column) -> Column:
    """A number in 0..PRIME-1 from an integer key. The square keeps salts from being dependent."""
    s = long(salt) if isinstance(salt, int) else salt.cast("long")
    a = (F.pmod(key.cast("long"), long(PRIME)) * 48271 + s * 69621 + 12345) % PRIME
    b = (a * a) % PRIME
    return (b * 16807 + s * 7919 + 1) % PRIME


def uniform(key: Column, salt: int | Column) -> Column:
    """``mixed`` scaled to [0, 1)."""
    return mixed(key, salt) / F.lit(float(PRIME))


def mixed_numbers(key: np.ndarray, salt: int) -> np.ndarray:
    """``mixed`` of an array of integer keys."""
    a = (key.astype(np.int64) % PRIME * 48271 + salt * 69621 + 12345) % PRIME
    return (a * a % PRIME * 16807 + salt * 7919 + 1) % PRIME


def numbers(key: np.ndarray, salt: int) -> np.ndarray:
    """``uniform`` of an array of integer keys."""
    return mixed_numbers(key, salt) / PRIME


class Draws:
    """Numbers in [0, 1) for one run: ``uniform`` of run * STRIDE + 0, 1, 2 ... in plain Python.

    A run of more than STRIDE draws goes on with the numbers of the next run.
    """

    STRIDE = 4096

    def __init__(self, seed: int, run: int):
        self.seed, self.at = seed, run * self.STRIDE

    def random(self) -> float:
        a = (self.at % PRIME * 48271 + self.seed * 69621 + 12345) % PRIME
        self.at += 1
        return (a * a % PRIME * 16807 + self.seed * 7919 + 1) % PRIME / PRIME


def uniform_sql(run: str, draw: str, salt: str | int) -> str:
    """What Draws(salt, run) gives as number ``draw``, in SQL."""
    return f"(({mixed_sql(f'({run})::BIGINT * {Draws.STRIDE} + {draw}', salt)}) / {PRIME}::DOUBLE)"


def mixed_sql(key: str, salt: str | int) -> str:
    """``mixed`` in SQL, for keys that are not negative."""
    a = f"((({key}) % {PRIME})::BIGINT * 48271 + ({salt})::BIGINT * 69621 + 12345) % {PRIME}"
    return f"(((({a}) * ({a})) % {PRIME}) * 16807 + ({salt})::BIGINT * 7919 + 1) % {PRIME}"
