"""A deterministic generator of numbers as column expressions: draw number ``i`` by itself, without those before it.

The generator multiplies its state by a constant modulo a prime, so its state after ``i`` draws is the seed times a power of the
constant. Tables of numbers are made in parallel and again the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The multiplier and the modulus.
FACTOR, PRIME = 16807, (1 << 31) - 1


def first_state(seed: int) -> int:
    """The state a seed stands for: its lower 31 bits, and 1 for the two states that would never change."""
    state = seed & PRIME
    return 1 if state in (0, PRIME) else state


def draw(i: Column | str, seed: int) -> Column:
    """Draw number ``i`` from 1 on, in 1..PRIME-1: products of the powers that the bits of ``i`` name, each below 2**62."""
    i = (F.col(i) if isinstance(i, str) else i).cast("long")
    power = FACTOR
    powers = []
    for _ in range(40):
        powers.append(power)
        power = power * power % PRIME
    turns = F.transform(F.array(*map(F.lit, powers)), lambda p, k: F.when(F.call_function("shiftright", i, k).bitwiseAND(1) == 1, p.cast("long")))
    return F.aggregate(F.filter(turns, lambda p: p.isNotNull()), F.lit(first_state(seed)).cast("long"), lambda state, p: state * p % PRIME)


def uniform(i: Column | str, seed: int, n: Column | int) -> Column:
    """Draw ``i`` as a number in 0..n-1."""
    return draw(i, seed) % n


def one_in(i: Column | str, seed: int, n: int) -> Column:
    """True for about one draw in ``n``."""
    return uniform(i, seed, n) == 0


def skewed(i: Column | str, seed: int, most: int) -> Column:
    """Small numbers mostly: pair ``i`` from 1 on of draws, the first giving how many bits, up to ``most``, the second has."""
    i = F.col(i) if isinstance(i, str) else i
    bits = uniform(2 * i - 1, seed, most + 1)
    return draw(2 * i, seed) % F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))
