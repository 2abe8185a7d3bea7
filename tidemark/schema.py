"""The change log: immutable rows ``(k, seq, op, value)``, and checks of what they must obey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, IntegerType, LongType, StringType, StructField, StructType

#: Largest sequence number: 56 bits, so that eight more fit a 64-bit word.
MAX_SEQ = (1 << 56) - 1
DELETE, PUT = 0, 1
FOUND, DELETED, ABSENT = "FOUND", "DELETED", "ABSENT"


def change_log_type(key: DataType, value: DataType) -> StructType:
    """The schema of a change log for keys and values of any type; keys must be orderable."""
    return StructType([StructField("k", key, False), StructField("seq", LongType(), False), StructField("op", IntegerType(), False), StructField("value", value, True)])


LOG_RECORD = StructType([StructField("path", StringType()), StructField("record_offset", LongType()), StructField("payload", BinaryType())])
LOG_DROP = StructType([StructField("path", StringType()), StructField("at", LongType()), StructField("bytes", LongType()), StructField("reason", StringType())])


class ChangeLogError(ValueError):
    """A change log breaks its rules."""


def violations(log: DataFrame) -> DataFrame:
    """Rows that break a rule, with the rule: a null or out-of-range column, or a repeated ``(k, seq, op)``."""
    rule = (
        F.when(F.col("k").isNull(), "null key")
        .when(F.col("seq").isNull() | ~F.col("seq").between(0, MAX_SEQ), "sequence number out of range")
        .when(F.col("op").isNull() | ~F.col("op").isin(DELETE, PUT), "unknown operation")
    )
    bad = log.select("k", "seq", "op", rule.alias("rule")).where("rule is not null")
    twice = log.groupBy("k", "seq", "op").agg(F.count("*").alias("n")).where("n > 1").select("k", "seq", "op", F.lit("repeated version").alias("rule"))
    return bad.unionByName(twice)


def validate(log: DataFrame) -> DataFrame:
    """``log`` itself, or :class:`ChangeLogError` with one broken rule."""
    broken = violations(log).first()
    if broken:
        raise ChangeLogError(f"{broken['rule']}: k={broken['k']!r} seq={broken['seq']} op={broken['op']}")
    return log
