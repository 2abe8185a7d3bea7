import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import codec, hashing
from tidemark.operators import filters


def le32(i):
    return int(i).to_bytes(4, "little")


def matches(spark, probes, data):
    rows = spark.createDataFrame([(bytearray(p),) for p in probes], "key binary")
    return rows.select(filters.bloom_may_match("key", F.lit(bytearray(data))).alias("m")).where("m").count()


def plain_match(data, keys):
    """The probe in NumPy, for many keys."""
    bits = np.unpackbits(np.frombuffer(data[:-1], np.uint8), bitorder="little")
    h = hashing.hash32_many(keys)
    step = (h >> np.uint32(17)) | (h << np.uint32(15))
    at = (h[:, None] + step[:, None] * np.arange(data[-1], dtype=np.uint32)) % np.uint32(len(bits))
    return bits[at].all(axis=1)


def test_small_sets(spark):
    data = filters.bloom_bytes([b"hello", b"world"])
    assert matches(spark, [b"hello", b"world"], data) == 2 and matches(spark, [b"x", b"foo"], data) == 0
    assert matches(spark, [b"hello"], filters.bloom_bytes([])) == 0 and matches(spark, [b"a"], b"") == 0 and matches(spark, [b"a"], b"\x00" * 9 + b"\x1f") == 1


def test_no_miss_and_few_false_matches(spark):
    others = [le32(10**9 + i) for i in range(10_000)]
    good = poor = 0
    for n in [*range(1, 10), *range(10, 100, 10), *range(100, 1000, 100), *range(1000, 10_001, 1000)]:
        keys = [le32(i) for i in range(n)]
        data = filters.bloom_bytes(keys)
        assert len(data) <= n * 10 / 8 + 40 and plain_match(data, keys).all()
        rate = plain_match(data, others).mean()
        assert rate <= 0.02
        poor, good = (poor + 1, good) if rate > 0.0125 else (poor, good + 1)
    assert poor <= good / 5
    data = filters.bloom_bytes([le32(i) for i in range(300)])
    probes = [le32(i) for i in range(300)] + others[:2000]
    assert matches(spark, probes, data) == int(plain_match(data, probes).sum())


def exact(key, filter_):
    """The exact filter of the tests: four bytes of hash for each key."""
    words = F.transform(F.sequence(F.lit(0), (F.length(filter_) / 4 - 1).cast("int")), lambda i: codec.decode_fixed32(F.substring(filter_, i * 4 + 1, F.lit(4))))
    return F.array_contains(words, hashing.hash32(key, 1))


def exact_build(name):
    return F.aggregate(F.array_sort(F.collect_set(codec.fixed32(hashing.hash32(F.col(name), 1)))), F.lit(bytearray()).cast("binary"), lambda a, b: F.concat(a, b))


def test_blocks_of_filters(spark):
    rows = [(0, b"foo"), (2000, b"bar"), (3100, b"box"), (9000, b"box"), (9000, b"hello")]
    data = spark.createDataFrame([(o, bytearray(k)) for o, k in rows], "block_offset long, key binary")
    block = filters.serialize_filters(filters.block_filters(data, build=exact_build)).first().block
    truth = {0: {b"foo", b"bar"}, 2000: {b"foo", b"bar"}, 3100: {b"box"}, 4100: set(), 9000: {b"box", b"hello"}}
    probes = spark.createDataFrame([(o, bytearray(k)) for o in truth for k in (b"foo", b"bar", b"box", b"hello")] + [(99_000, bytearray(b"foo"))], "block_offset long, key binary")
    got = probes.select("block_offset", "key", filters.block_may_match("block_offset", "key", filters.parse_filters(F.lit(block)), exact).alias("may")).collect()
    for r in got:
        assert r.may == (r.block_offset == 99_000 or bytes(r.key) in truth[r.block_offset]), r


def test_empty_and_damaged_blocks(spark):
    none = spark.createDataFrame([], "block_offset long, key binary")
    empty = spark.range(1).select(filters.parse_filters(F.lit(bytearray(b"\x00\x00\x00\x00\x0b"))).alias("f"), filters.parse_filters(F.lit(bytearray(b"\x0b"))).alias("g"), filters.parse_filters(F.lit(bytearray(b"\xff\xff\x00\x00\x0b"))).alias("h"))
    assert filters.block_filters(none).count() == 0
    assert bytes(filters.serialize_filters(filters.block_filters(none)).first().block) == b"\x00\x00\x00\x00\x0b"
    for name in "fgh":
        assert empty.select(filters.block_may_match(F.lit(0).cast("long"), F.lit(bytearray(b"foo")), F.col(name))).first()[0] is True


def may(spark, block, offset, key=b"foo", match=exact):
    parsed = filters.parse_filters(F.lit(bytearray(block)))
    return spark.range(1).select(filters.block_may_match(F.lit(offset).cast("long"), F.lit(bytearray(key)), parsed, match)).first()[0]


def test_stored_span_and_damaged_limits(spark):
    """A block is read by the span it names; a filter that would reach past the offsets' place hides nothing."""
    foo = le32(hashing.hash32_many([b"foo"], 1)[0])
    box = le32(hashing.hash32_many([b"box"], 1)[0])

    def block(offsets, data=foo + box, bits=11, end=None):
        return data + b"".join(map(le32, offsets)) + le32(len(data) if end is None else end) + bytes([bits])

    for bits in (4, 11, 20):
        sound = block([0, 4], bits=bits)
        assert may(spark, sound, 0) and not may(spark, sound, 1 << bits) and may(spark, sound, (1 << bits) - 1) and not may(spark, sound, 2 * (1 << bits) - 1, b"foo")
        assert may(spark, sound, 1 << bits, b"box") and may(spark, sound, 2 << bits)
    assert not may(spark, block([0, 4]), 0, b"box")
    assert may(spark, block([0, 2000]), 0, b"box")  # the first filter's limit lies beyond the data
    assert may(spark, block([8, 4]), 0, b"box") and not may(spark, block([4, 4]), 0, b"foo")
    assert may(spark, block([0xFFFFFFF0, 4]), 0) and may(spark, block([0, 4], end=4000), 0) and may(spark, block([0, 4], bits=200), 1 << 40, b"foo")


def test_filter_rows(spark):
    rows = spark.createDataFrame([(i * 700, bytearray(le32(i))) for i in range(40)], "block_offset long, key binary")
    built = filters.block_filters(rows)
    back = filters.filter_rows(filters.serialize_filters(built))
    assert {r.filter_index: bytes(r.filter) for r in back.collect()} == {r.filter_index: bytes(r.filter) for r in built.collect()}
    assert filters.pruned_lookup(rows, back.select("filter_index", "filter"), rows).count() == 40


def test_filters_of_groups(spark):
    """Filters built many to a batch equal those built one by one, for any number of groups, and null keys count for nothing."""
    rows = [(g, bytearray(le32(g * 100 + i))) for g in range(40) for i in range(g % 7 + 1)] + [(3, None), (99, None)]
    df = spark.createDataFrame(rows, "g long, key binary")
    want = {}
    for g, k in rows:
        want.setdefault(g, []).extend([bytes(k)] if k is not None else [])
    got = {r.g: bytes(r["filter"]) for r in filters.bloom_filters(df.repartition(5), "g", "key").collect()}
    assert got == {g: filters.bloom_bytes(keys) for g, keys in want.items()}
    assert filters.bloom_filters(df.limit(0), "g", "key").count() == 0


def test_probes_of_large_groups(spark):
    """A group's filter, however large, goes to the task of its probes once; probes get the answers that they get one by one."""
    keys = spark.range(6000).select((F.col("id") % 3).alias("g"), codec.fixed32("id").alias("key"))
    asked = keys.unionByName(spark.range(6000, 6100).select(F.lit(3).cast("long").alias("g"), codec.fixed32("id").alias("key"))).unionByName(
        spark.range(10**6, 10**6 + 3000).select((F.col("id") % 3).alias("g"), codec.fixed32("id").alias("key"))
    )
    got = filters.probe_filters(asked.repartition(7), filters.bloom_filters(keys, "g", "key"), "g")
    want = {g: filters.bloom_bytes([le32(i) for i in range(g, 6000, 3)]) for g in range(3)}
    rows = [(r.g, bytes(r.key), r.may_match) for r in got.collect()]
    assert sorted((g, k) for g, k, _ in rows) == sorted((r.g, bytes(r.key)) for r in asked.collect())
    for g in range(4):
        mine = [(k, m) for h, k, m in rows if h == g]
        assert [m for _, m in mine] == (filters.bloom_matches([k for k, _ in mine], want[g]).tolist() if g in want else [True] * len(mine))


def test_filters_are_not_joined_to_probes(spark, tiny):
    from tidemark.plans import catalogue

    assert "Join" not in catalogue.bloom_probe_no_false_negative(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_serialized_in_one_walk(spark):
    built = spark.range(3).select(F.col("id").alias("filter_index"), codec.fixed32("id").alias("filter"))
    plan = filters.serialize_filters(built)._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "aggregate(" not in plan
