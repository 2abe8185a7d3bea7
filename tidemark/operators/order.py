"""Orders of keys: a name and the expression whose natural order is meant."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Order:
    """An order of keys by ``sort_key(key)``, an expression that differs for keys that are not equal in it.

    The name goes with stored data: data sorted in one order must not be read in another (:func:`same_order`).
    """

    name: str
    sort_key: Callable[[Column], Column]

    def __call__(self, key: Column | str) -> Column:
        return self.sort_key(F.col(key) if isinstance(key, str) else key)


#: Keys as Spark compares them: numbers by value, text and binary by unsigned bytes.
BYTEWISE = Order("bytewise", lambda k: k)
#: Keys from the largest down; of whole numbers.
DESCENDING = Order("descending", lambda k: -k)
#: Text without regard to the case of ASCII letters; equal ones by their bytes.
CASELESS = Order("caseless", lambda k: F.struct(F.translate(k, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("folded"), k.alias("own")))


class OrderError(ValueError):
    """Data stored in one order are read in another."""


def same_order(stored: str, wanted: Order) -> Order:
    """``wanted``, if data stored under the order named ``stored`` can be read in it."""
    if stored != wanted.name:
        raise OrderError(f"stored in order {stored!r}, read in {wanted.name!r}")
    return wanted
