"""The record log: each damage once, then random damage against the plain reader."""

import random

import pytest

from tidemark.functions.hashing import crc32c_bytes, crc_mask_value
from tidemark.sources import recordlog as L

B, H = L.BLOCK, L.HEADER


def write(*payloads, start=0):
    return b"".join(L.frame(payloads, start))


def big(word, n):
    return (word * (n // len(word) + 1))[:n]


def fixed(data, at, n):
    """``data`` with the checksum of the record at ``at`` put right."""
    crc = crc_mask_value(crc32c_bytes(data[at + 6 : at + 7 + n]))
    return data[:at] + crc.to_bytes(4, "little") + data[at + 4 :]


def changed(data, at, value):
    return data[:at] + bytes([value & 255]) + data[at + 1 :]


def parallel(spark, logs, start=0):
    files = spark.createDataFrame([(str(i), bytearray(d)) for i, d in enumerate(logs)], "path string, content binary")
    records, drops = L.parse(files, start=start)
    out = [([], []) for _ in logs]
    for r in records.orderBy("path", "record_offset").collect():
        out[int(r.path)][0].append((r.record_offset, bytes(r.payload)))
    for d in drops.collect():
        out[int(d.path)][1].append((d.bytes, d.reason))
    return [(r, sorted(d)) for r, d in out]


FOO = write(b"foo")
CASES = [
    ("round trip", write(b"foo", b"bar", b"", b"xxxx"), 0, [b"foo", b"bar", b"", b"xxxx"], 0, ""),
    ("fragments", write(b"small", big(b"medium", 50_000), big(b"large", 100_000)), 0, [b"small", big(b"medium", 50_000), big(b"large", 100_000)], 0, ""),
    ("trailer of a header", write(big(b"foo", B - 2 * H), b"", b"bar"), 0, [big(b"foo", B - 2 * H), b"", b"bar"], 0, ""),
    ("short trailer", write(big(b"foo", B - 2 * H + 4), b"", b"bar"), 0, [big(b"foo", B - 2 * H + 4), b"", b"bar"], 0, ""),
    ("reopened", write(b"hello") + write(b"world", start=len(write(b"hello"))), 0, [b"hello", b"world"], 0, ""),
    ("bad type", fixed(changed(FOO, 6, FOO[6] + 100), 0, 3), 0, [], 3, "unknown record type"),
    ("type five", fixed(changed(FOO, 6, 5), 0, 3), 0, [], 3, "unknown record type 5"),
    ("cut tail", FOO[:-4], 0, [], 0, ""),
    ("bad length", changed(write(big(b"bar", B - H), b"foo"), 4, write(big(b"bar", B - H))[4] + 1), 0, [b"foo"], B, "bad record length"),
    ("bad length at the end", FOO[:-1], 0, [], 0, ""),
    ("checksum", changed(FOO, 0, FOO[0] + 10), 0, [], 10, "checksum mismatch"),
    ("stray middle", fixed(changed(FOO, 6, L.MIDDLE), 0, 3), 0, [], 3, "missing start"),
    ("stray last", fixed(changed(FOO, 6, L.LAST), 0, 3), 0, [], 3, "missing start"),
    ("unexpected full", fixed(changed(write(b"foo", b"bar"), 6, L.FIRST), 0, 3), 0, [b"bar"], 3, "partial record without end"),
    ("unexpected first", fixed(changed(write(b"foo", big(b"bar", 100_000)), 6, L.FIRST), 0, 3), 0, [big(b"bar", 100_000)], 3, "partial record without end"),
    ("missing last", write(big(b"bar", B))[:-14], 0, [], 0, ""),
    ("partial last", write(big(b"bar", B))[:-1], 0, [], 0, ""),
    ("skip into a record", write(big(b"foo", 3 * B), b"correct"), B, [b"correct"], 0, ""),
]


def test_damage(spark):
    for start in {c[2] for c in CASES}:
        cases = [c for c in CASES if c[2] == start]
        for (name, data, _, records, dropped, message), got in zip(cases, parallel(spark, [c[1] for c in cases], start)):
            plain = L.read_sequentially(data, start=start)
            assert ([p for _, p in plain[0]], sum(n for n, _ in plain[1])) == (records, dropped), name
            assert message in "".join(r for _, r in plain[1]), name
            assert got == (plain[0], sorted(plain[1])), name


def test_joined_records_are_not_made_up(spark):
    data = write(big(b"foo", B), big(b"bar", B), b"correct")
    data = data[:B] + b"x" * B + data[2 * B :]
    records, drops = L.read_sequentially(data)
    assert [p for _, p in records] == [b"correct"] and 2 * B <= sum(n for n, _ in drops) <= 2 * B + 100
    assert parallel(spark, [data])[0] == (records, sorted(drops))


SIZES = [10_000, 10_000, 2 * B - 1000, 1, 13_716, B - H]


@pytest.mark.parametrize(
    "start,first",
    [(0, 0), (1, 1), (10_000, 1), (10_007, 1), (10_008, 2), (20_014, 2), (20_015, 3), (B - 4, 3), (B + 1, 3), (2 * B + 1, 3), (2 * (H + 1000) + 2 * B - 1000 + 3 * H, 3), (3 * B - 3, 5), (None, 6), (-5, 6)],
)
def test_start_offsets(start, first):
    data = write(*(bytes([97 + i]) * n for i, n in enumerate(SIZES)))
    start = len(data) if start is None else len(data) - start if start < 0 else start
    assert [(p[0] - 97, len(p)) for _, p in L.read_sequentially(data, start=start)[0]] == [(i, SIZES[i]) for i in range(first, 6)]


def test_random_damage_and_offsets(spark):
    rnd = random.Random(7)
    logs = []
    for _ in range(60):
        data = bytearray(write(*(bytes([rnd.randrange(256)]) * rnd.choice([0, 1, 50, 3000, 40_000, 70_000]) for _ in range(rnd.randrange(1, 9)))))
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(data))
            kind = rnd.randrange(4)
            if kind == 0:
                data[at] ^= 1 << rnd.randrange(8)
            elif kind == 1:
                del data[at:]
                data = data or bytearray(b"\0")
            elif kind == 2:
                data[at : at + 9000] = bytes(len(data[at : at + 9000]))
            else:
                data = bytearray(fixed(changed(bytes(data), 6, rnd.randrange(1, 7)), 0, int.from_bytes(data[4:6], "little"))) if len(data) > 7 else data
        logs.append(bytes(data))
    for start in (0, 1, B - 3, B + 5, 2 * B):
        for data, got in zip(logs, parallel(spark, logs, start)):
            records, drops = L.read_sequentially(data, start=start)
            assert got == (records, sorted(drops)), start


def test_data_source(spark, tmp_path):
    L.register(spark)
    path = str(tmp_path / "log")
    rows = [(bytearray(big(b"word%d" % i, i * 1000)),) for i in range(1, 60)]
    spark.createDataFrame(rows, "payload binary").repartition(3).write.format("recordlog").mode("append").save(path)
    back = spark.read.format("recordlog").load(path)
    assert sorted(bytes(r.payload) for r in back.collect()) == sorted(bytes(r[0]) for r in rows)
    records, drops = L.read_log(spark, path)
    assert records.count() == 59 and drops.count() == 0
    stream = spark.readStream.format("recordlog").load(path)
    run = stream.writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("tail").count() == 59


def payloads_of(df):
    return [bytes(r.payload) for r in df.orderBy("path", "record_offset").collect()]


def test_log_grows_between_batches(spark, tmp_path):
    """Records written after a batch has fixed its end belong to the next batch, and to no other."""
    path = tmp_path / "grown"
    path.mkdir()
    file = str(path / "a.log")
    L.append_to_file(file, [b"one", b"two"])
    tail = L._Tail({"path": str(path)})
    first = tail.latestOffset()
    L.append_to_file(file, [b"three", big(b"four", 3 * B), b"five"])
    got = [bytes(r[2]) for p in tail.partitions({}, first) for r in tail.read(p)]
    assert got == [b"one", b"two"]
    second = tail.latestOffset()
    L.append_to_file(file, [b"six"])
    got = [bytes(r[2]) for p in tail.partitions(first, second) for r in tail.read(p)]
    assert got == [b"three", big(b"four", 3 * B), b"five"]
    got = [bytes(r[2]) for p in tail.partitions(second, tail.latestOffset()) for r in tail.read(p)]
    assert got == [b"six"]


def test_stream_takes_appended_records_once(spark, tmp_path):
    L.register(spark)
    path, seen = tmp_path / "logs", []
    path.mkdir()
    for k in range(3):
        L.append_to_file(str(path / "a.log"), [b"%d-%d" % (k, i) * 4000 for i in range(5)])
        run = spark.readStream.format("recordlog").load(str(path)).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        run.foreachBatch(lambda batch, _: seen.extend(bytes(r.payload) for r in batch.collect())).start().awaitTermination()
    assert sorted(seen) == sorted(b"%d-%d" % (k, i) * 4000 for k in range(3) for i in range(5))


def test_reopened_logs(spark):
    """A log written at once and one written in parts, reopened each time, have the same bytes."""
    payloads = [bytes([65 + i]) * n for i, n in enumerate((5, B - 30, 0, 1, 70_000, B - 2 * H, 3, 100))]
    rows = [(f"log {k}", i, bytearray(p)) for k in range(3) for i, p in enumerate(payloads)]
    schema, none = "path string, place long, payload binary", spark.createDataFrame([], "path string, content binary")
    logs = none
    for a, b in ((0, 1), (1, 4), (4, 4), (4, 8)):
        logs = L.extend_logs(logs, spark.createDataFrame([r for r in rows if a <= r[1] < b], schema))
    assert {r.path: bytes(r.content) for r in logs.collect()} == {f"log {k}": write(*payloads) for k in range(3)}


def test_logs_are_split_by_size(spark):
    payloads = [bytes([i]) * n for i, n in enumerate((10_000, 50_000, 200_000, 5, 40_000, 90_000))]
    df = spark.createDataFrame([(bytearray(p),) for p in payloads], "payload binary").coalesce(1)
    logs = L.encode_log(df, most=100_000).collect()
    assert [r.piece for r in logs] == list(range(len(logs))) and len(logs) > 3
    assert all(len(r.content) <= 100_000 or len(L.read_sequentially(bytes(r.content))[0]) == 1 for r in logs)
    assert [p for r in logs for _, p in L.read_sequentially(bytes(r.content))[0]] == payloads
    assert [bytes(r.content) for r in L.encode_log(df.limit(0)).collect()] in ([], [b""])


def test_only_offsets_and_sizes_are_sorted(spark):
    files = spark.createDataFrame([("a", bytearray(FOO))], "path string, content binary")
    records, drops = L.parse(files)
    for df in (records, drops):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any("data" in line or "bytes#" in line and "binary" in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window"))


def test_blocks_written_in_stretches(spark):
    """Logs as blocks, written in stretches side by side and reopened, have the bytes of logs written at once, and give back their records."""
    rnd = random.Random(5)
    payloads = [bytes([65 + i % 26]) * rnd.choice((0, 1, 5, 700, B - 30, B - 2 * H, B - H, 3 * B)) for i in range(60)]
    rows = [(f"log {k}", i, bytearray(p)) for k in range(3) for i, p in enumerate(payloads[k:])] + [("log 0", 99, None)]
    schema, logs = "path string, place long, payload binary", None
    for a, b in ((0, 25), (25, 25), (25, 100)):
        logs = L.extend_blocks(logs, spark.createDataFrame([r for r in rows if a <= r[1] < b], schema).repartition(3), stretch=B + 100)
    found = {}
    for r in sorted(logs.collect(), key=lambda r: (r.path, r.place)):
        assert r.place == len(found.get(r.path, b"")) and len(r.data) <= B
        found[r.path] = found.get(r.path, b"") + bytes(r.data)
    assert found == {f"log {k}": write(*payloads[k:]) for k in range(3)}
    for start in (0, 2 * B + 1000):
        records, drops = L.parse_blocks(logs, start=start)
        got = sorted((r.path, r.record_offset, bytes(r.payload)) for r in records.collect())
        plain = {p: L.read_sequentially(log, start=start) for p, log in found.items()}
        assert got == sorted((p, at, data) for p, (records, _) in plain.items() for at, data in records)
        assert sorted((r.path, r.bytes, r.reason) for r in drops.collect()) == sorted((p, n, why) for p, (_, drops) in plain.items() for n, why in drops)


def test_record_end():
    for at in (0, 1, B - 8, B - 7, B - 6, B - 1, B, 3 * B + 5):
        for n in (0, 1, B - 2 * H, B - H, B - H + 1, 2 * (B - H), 2 * (B - H) + 1, 70_000):
            start, end = L.record_end(at, n)
            assert end == at + len(next(L.frame([bytes(n)], at))) and start - at == (B - at % B if B - at % B < H else 0)


def test_content_is_not_copied_for_each_block(spark):
    """Blocks are cut of a row at once, so that no row of content goes beside each of its blocks."""
    files = spark.createDataFrame([("a", bytearray(FOO))], "path string, content binary")
    plan = L.log_blocks(files)._jdf.queryExecution().optimizedPlan()
    (generate,) = [n for n in (plan.apply(i) for i in range(20)) if n is not None and n.nodeName() == "Generate"]
    kept = generate.requiredChildOutput()
    assert [kept.apply(i).name() for i in range(kept.size())] == ["path"]
