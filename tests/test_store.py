"""Snapshots and cursors against plain Python models."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changelog, cursor, snapshot
from tidemark.operators.order import CASELESS, DESCENDING, OrderError, same_order
from tidemark.schema import MAX_SEQ, ChangeLogError, validate

SCHEMA = "k long, seq long, op int, value string"


def lehmer(seed):
    while True:
        seed = seed * 16807 % (2**31 - 1)
        yield seed


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(30), s, rnd.choice([0, 1, 1]), f"v{s}") for s in range(400)]
    return spark.createDataFrame(rows, SCHEMA).cache(), rows


def model(rows, key, at):
    seen = [r for r in rows if r[0] == key and r[1] <= at]
    return max(seen, key=lambda r: r[1]) if seen else None


def test_get_and_multi_get(spark, log):
    df, rows = log
    lookups = [(i, k, s) for i, (k, s) in enumerate((k, s) for k in range(33) for s in (-1, 0, 57, 200, 399, MAX_SEQ))]
    asked = spark.createDataFrame([*lookups, (999, None, 5), (1000, 5, None)], "lookup_id long, k long, snapshot_seq long")
    got = {r.lookup_id: r for r in snapshot.multi_get(df, asked).collect()}
    assert got[999].status == got[1000].status == "ABSENT" and len(got) == len(lookups) + 2
    for i, k, s in lookups:
        want = model(rows, k, s)
        status = "ABSENT" if want is None else "FOUND" if want[2] else "DELETED"
        assert (got[i].status, got[i].seq, got[i].value) == (status, want and want[1], want and want[3])
    one = snapshot.get(df, 5, 200).first()
    assert (one.seq, one.status) == (model(rows, 5, 200)[1], "FOUND" if model(rows, 5, 200)[2] else "DELETED")
    assert snapshot.get(df, 77).first().status == "ABSENT"


def test_tombstone_of_sequence_zero(spark):
    df = spark.createDataFrame([(1, 0, 0, None), (2, 0, 1, "x")], SCHEMA)
    assert {r.k: r.status for r in snapshot.latest(df).collect()} == {1: "DELETED", 2: "FOUND"}
    assert [r.k for r in snapshot.snapshot_scan(df).collect()] == [2] and [r.k for r in snapshot.tombstones(df).collect()] == [1]


def test_compaction_keeps_what_snapshots_see(spark, log):
    df, rows = log
    kept = snapshot.compact(df, [100, 250])
    assert kept.count() < len(rows)
    for at in (100, 250, 399):
        want = {(r.k, r.value) for r in snapshot.snapshot_scan(df, at).collect()}
        assert {(r.k, r.value) for r in snapshot.snapshot_scan(kept, at).collect()} == want


def test_put_delete_and_validation(spark, log):
    df, _ = log
    more = changelog.put(df, spark.createDataFrame([(500, 1000, "new")], "k long, seq long, value string"))
    more = changelog.delete(more, spark.createDataFrame([(500, 1001)], "k long, seq long"))
    assert snapshot.get(validate(more), 500).first().status == "DELETED" and snapshot.get(more, 500, 1000).first().value == "new"
    for bad in ([(1, -1, 1, "")], [(1, MAX_SEQ + 1, 1, "")], [(None, 1, 1, "")], [(1, 1, 7, "")], [(1, 1, 1, "a"), (1, 1, 1, "b")]):
        with pytest.raises(ChangeLogError):
            validate(spark.createDataFrame(bad, SCHEMA))


def test_sorted_store(spark, log, tmp_path):
    df, rows = log
    changelog.write_sorted(df, str(tmp_path / "s"), 3)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s")).collect())) == sorted(rows)


def test_cursor_against_sorted_list(spark):
    draw = lehmer(1000)
    keys = sorted({next(draw) % 5000 for _ in range(2000)})
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    targets = spark.createDataFrame([(i, i) for i in range(5001)], "target_id long, target long")
    found = {r.target: r.found for r in cursor.seek_many(df, targets, 5).collect()}
    for t in range(5001):
        i = bisect.bisect_left(keys, t)
        assert found[t] == (keys[i] if i < len(keys) else None)
    beside = {r.k: (r.previous, r.following) for r in cursor.neighbours(df, 5).collect()}
    assert beside == {k: (keys[i - 1] if i else None, keys[i + 1] if i + 1 < len(keys) else None) for i, k in enumerate(keys)}
    present = cursor.contains(df, spark.createDataFrame([(i,) for i in range(5000)], "k long"))
    assert {r.k for r in present.collect() if r.present} == set(keys)
    assert [r.k for r in cursor.reverse_scan(df, 7).collect()] == keys[::-1][:7]
    assert [r.k for r in cursor.range_scan(df, 100, 300).orderBy("k").collect()] == [k for k in keys if 100 <= k < 300]
    assert cursor.first(df).first().k == keys[0] and cursor.last(df).first().k == keys[-1] and cursor.seek(df, 4999 + 10).count() == 0


def test_empty_and_failing_relations(spark):
    schema = spark.createDataFrame([], "k long").schema
    empty = cursor.empty_relation(spark, schema)
    assert cursor.seek(empty, 1).count() == cursor.neighbours(empty).count() == cursor.first(empty).count() == 0
    with pytest.raises(Exception, match="broken store"):
        cursor.failed_relation(spark, schema, "broken store").collect()


def test_binary_keys_order_by_unsigned_bytes(spark):
    keys = [b"", b"\x00", b"a", b"ab", b"\x7f", b"\x80", b"\xff\xff"]
    df = spark.createDataFrame([(bytearray(k), i, 1) for i, k in enumerate(keys)] + [(bytearray(b"a"), 9, 0)], "k binary, seq long, op int")
    assert [(bytes(r.k), r.seq) for r in cursor.scan(df).collect()] == sorted([(k, i) for i, k in enumerate(keys)] + [(b"a", 9)], key=lambda x: (x[0], -x[1]))
    assert [bytes(r.k) for r in cursor.prefix_scan(df, b"a").select("k").distinct().orderBy("k").collect()] == [b"a", b"ab"]


def test_entry_size(spark):
    from tidemark.functions import codec

    key, value = F.lit(bytearray(b"k" * 130)), F.lit(bytearray(b"v" * 20000))
    row = spark.range(1).select(F.length(codec.entry(key, F.lit(5), F.lit(1), value)), changelog.entry_size(F.length(key), F.length(value))).first()
    assert row[0] == row[1]


def test_seek_with_many_equal_and_null_targets(spark):
    df = spark.createDataFrame([(k,) for k in (1, 5, 5, 9, None)], "k long")
    targets = spark.createDataFrame([(i, 5) for i in range(200)] + [(900, 6), (901, 10), (902, None), (903, -3)], "target_id long, target long")
    found = {r.target_id: r.found for r in cursor.seek_many(df, targets, 3).collect()}
    assert len(found) == 204 and {found[i] for i in range(200)} == {5} and (found[900], found[901], found[902], found[903]) == (9, None, None, 1)


def test_seek_in_one_large_range(spark):
    """Linear in the rows of a range."""
    import time

    df, targets = spark.range(0, 400_000, 4).toDF("k"), spark.range(100_000).selectExpr("id AS target_id", "id * 4 - 3 AS target")
    began = time.perf_counter()
    assert cursor.seek_many(df, targets, 1).where("found = target + 3").count() == 100_000
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("keys", [["b", "A", "C", "a", "c", "B", ""], [b"\xff", b"\x00a", b"\x7f", b"", b"\x80"]])
def test_cursors_of_text_and_bytes(spark, keys):
    as_key = lambda k: bytearray(k) if isinstance(k, bytes) else k
    df = spark.createDataFrame([(as_key(k),) for k in keys], "k string" if isinstance(keys[0], str) else "k binary")
    plain = lambda k: bytes(k) if isinstance(k, bytearray) else k
    ordered = sorted(keys)
    beside = {plain(r.k): (plain(r.previous), plain(r.following)) for r in cursor.neighbours(df, 3).collect()}
    assert beside == {k: (ordered[i - 1] if i else None, ordered[i + 1] if i + 1 < len(ordered) else None) for i, k in enumerate(ordered)}


def test_other_orders(spark):
    """Every cursor in an order of its own."""
    keys = [3, 8, 1, 40, 22]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    down = sorted(keys, reverse=True)
    assert [r.k for r in cursor.scan(df.selectExpr("k", "1 AS seq", "1 AS op"), DESCENDING).collect()] == down
    assert [r.k for r in cursor.reverse_scan(df, 2, DESCENDING).collect()] == [1, 3]
    assert cursor.seek(df, 21, DESCENDING).first().k == 8 and cursor.first(df, DESCENDING).first().k == 40 and cursor.last(df, DESCENDING).first().k == 1
    assert {r.k for r in cursor.range_scan(df, 22, 3, DESCENDING).collect()} == {22, 8}
    targets = spark.createDataFrame([(i, i) for i in range(45)], "target_id long, target long")
    found = {r.target: r.found for r in cursor.seek_many(df, targets, 3, DESCENDING).collect()}
    assert found == {t: max((k for k in keys if k <= t), default=None) for t in range(45)}
    assert {r.k: (r.previous, r.following) for r in cursor.neighbours(df, 2, DESCENDING).collect()}[8] == (22, 3)

    words = ["b", "A", "C", "a", "c", "B", "Aa"]
    folded = sorted(words, key=lambda w: (w.lower(), w))
    names = spark.createDataFrame([(w,) for w in words], "k string")
    beside = {r.k: (r.previous, r.following) for r in cursor.neighbours(names, 3, CASELESS).collect()}
    assert beside == {k: (folded[i - 1] if i else None, folded[i + 1] if i + 1 < len(folded) else None) for i, k in enumerate(folded)}
    assert cursor.seek(names, "AB", CASELESS).first().k == "B"
    asked = spark.createDataFrame([(0, "AB"), (1, "d"), (2, "a")], "target_id long, target string")
    assert {r.target_id: r.found for r in cursor.seek_many(names, asked, 3, CASELESS).collect()} == {0: "B", 1: None, 2: "a"}


def test_order_names_are_checked():
    assert same_order("caseless", CASELESS) is CASELESS
    with pytest.raises(OrderError):
        same_order("bytewise", DESCENDING)


def test_clean_up_runs_whatever_happens(spark):
    ran = []

    def fail():
        ran.append("fail")
        raise OSError("gone")

    with pytest.raises(OSError, match="gone"):
        with cursor.cleaned_up(spark.range(3).cache(), fail, lambda: ran.append("after")) as df:
            assert df.count() == 3 and df.is_cached
    assert ran == ["fail", "after"] and not df.is_cached
    with pytest.raises(KeyError):
        with cursor.cleaned_up(spark.range(3), lambda: ran.append("error")):
            raise KeyError("own")
    assert ran[-1] == "error"


def test_snapshots_need_no_sort(spark):
    from tidemark.operators import snapshot

    df = spark.createDataFrame([(1, MAX_SEQ, 1, 0.5), (1, 2**55, 0, 1.5), (2, 2**55 - 1, 1, 2.5), (2, 2**55, 1, None)], "k long, seq long, op int, value double")
    assert {(r.k, r.seq, r.value) for r in snapshot.snapshot_scan(df).collect()} == {(1, MAX_SEQ, 0.5), (2, 2**55, None)}
    assert {(r.k, r.seq, r.status) for r in snapshot.latest(df, 2**55).collect()} == {(1, 2**55, "DELETED"), (2, 2**55, "FOUND")}
    plan = snapshot.latest(df)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and plan.count("HashAggregate") >= 2
