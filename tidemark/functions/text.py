"""Text helpers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MOST = "18446744073709551615"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def escape_bytes(data: Column | str) -> Column:
    """Printable ASCII as it is, any other byte as ``\\xNN``; a backslash is printable and stays."""
    latin = F.decode(_column(data).cast("binary"), "ISO-8859-1")  # a character for each byte
    runs = F.regexp_extract_all(latin, F.lit("[^ -~]+"), F.lit(0))
    shown = F.transform(runs, lambda run: F.regexp_replace(F.lower(F.hex(F.encode(run, "ISO-8859-1"))), "(..)", r"\\x$1"))
    parts = F.zip_with(F.split(latin, "[^ -~]+", -1), shown, lambda plain, other: F.concat(plain, F.coalesce(other, F.lit(""))))
    return F.when(F.rlike(latin, F.lit("[^ -~]")), F.array_join(parts, "")).otherwise(latin)


def number_text(v: Column | str) -> Column:
    return _column(v).cast("string")


def take_decimal(text: Column | str) -> Column:
    """``struct(value DECIMAL(20,0), rest)`` of the longest run of digits at the start.

    Null without a digit and for numbers above 2**64-1. Leading zeros count for nothing.
    """
    text = _column(text).cast("string")
    digits = F.regexp_extract(text, r"\A[0-9]+", 0)
    plain = F.regexp_replace(digits, r"\A0+(?=[0-9])", "")
    fits = (F.length(plain) < 20) | ((F.length(plain) == 20) & (plain <= _MOST))
    value = F.when((digits != "") & fits, plain).cast("decimal(20,0)")
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.substring(text, F.length(digits) + 1, F.length(text)).alias("rest")))


#: Kinds of result, with the words that stand before their messages.
STATUS = {"ok": "OK", "not_found": "NotFound", "corruption": "Corruption", "not_supported": "Not implemented", "invalid_argument": "Invalid argument", "io_error": "IO error"}


def status_text(kind: Column | str, message: Column | str, detail: Column | str | None = None) -> Column:
    """``Kind: message: detail``; for ``ok`` just OK; null parts are left out."""
    names = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    parts = [F.element_at(names, _column(kind)), _column(message)] + ([] if detail is None else [_column(detail)])
    return F.when(_column(kind) == "ok", F.lit("OK")).otherwise(F.concat_ws(": ", *parts))
