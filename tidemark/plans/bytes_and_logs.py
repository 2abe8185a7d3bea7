"""Queries over serialized forms: filter blocks, logs with their damage, versioned keys at their edges, generated numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, draws, hashing, separators, text
from ..operators import filters
from ..operators.cursor import neighbours, seek_many
from ..operators.order import DESCENDING
from ..schema import MAX_SEQ, violations
from ..sources import recordlog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hexed(data):
    return F.lower(F.hex(data))


def _le(value: str, n: int) -> str:
    """SQL for ``n`` bytes of a number, least significant first, in hex."""
    return " || ".join(f"lower(lpad(to_hex(({value} >> {8 * i}) & 255), 2, '0'))" for i in range(n))


def _mixed(h: str) -> str:
    """SQL for a product with the hash's factor modulo 2**32."""
    return f"((({h} & 65535) * {hashing.HASH_FACTOR} + (((({h} >> 16) * {hashing.HASH_FACTOR}) & 65535) << 16)) & 4294967295)"


# Hashes and filters


def _word(i: str) -> str:
    return "(" + " + ".join(f"(ascii(substr(p_name, CAST({i} + {j + 1} AS INTEGER), 1)) << {8 * j})" for j in range(4)) + ")"


@query(f"""WITH k AS (SELECT p_partkey, substr(p_name, 1, 1 + CAST(p_partkey % 9 AS INTEGER)) AS p_name FROM part),
n AS (SELECT p_partkey, p_name, length(p_name) AS n FROM k),
w AS (SELECT p_partkey, p_name, n, list_reduce(list_prepend(xor({hashing.BLOOM_SEED}, {_mixed('n')}), list_transform(range(0, n // 4), lambda i: CAST({_word('i * 4')} AS BIGINT))),
  lambda a, x: xor({_mixed('((a + x) & 4294967295)')}, {_mixed('((a + x) & 4294967295)')} >> 16)) AS h FROM n),
r AS (SELECT p_partkey, n, h, ({' + '.join(f"CASE WHEN n % 4 > {j} THEN ascii(substr(p_name, CAST(n - n % 4 + {j + 1} AS INTEGER), 1)) << {8 * j} ELSE 0 END" for j in range(3))}) AS rest FROM w)
SELECT p_partkey, CASE WHEN n % 4 = 0 THEN h ELSE xor({_mixed('((h + rest) & 4294967295)')}, {_mixed('((h + rest) & 4294967295)')} >> 24) END AS hash FROM r""")
def hash32_text_key(spark, sf_dir):
    """Keys of one to nine bytes, so of each length modulo 4."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_name", F.lit(1), (F.col("p_partkey") % 9 + 1).cast("int")).alias("k"))
    return parts.select("p_partkey", hashing.hash32("k").alias("hash"))


@query(f"""WITH a AS (SELECT o_orderkey AS k, o_orderkey % 64 AS bucket, {_mixed('((xor(' + str(hashing.BLOOM_SEED) + ', ' + str(4 * hashing.HASH_FACTOR & 0xFFFFFFFF) + ') + o_orderkey) & 4294967295)')} AS t FROM orders),
h AS (SELECT bucket, xor(t, t >> 16) AS h FROM a),
s AS (SELECT bucket, (greatest(count(*) * 10, 64) + 7) // 8 AS bytes FROM h GROUP BY bucket),
p AS (SELECT DISTINCT h.bucket, ((h + j * (((h >> 17) | (h << 15)) & 4294967295)) & 4294967295) % (bytes * 8) AS pos FROM h JOIN s ON h.bucket = s.bucket, range(6) r(j)),
v AS (SELECT bucket, pos // 8 AS b, CAST(sum(1 << (pos % 8)) AS BIGINT) AS v FROM p GROUP BY bucket, pos // 8),
e AS (SELECT bucket, unnest(range(bytes)) AS b FROM s)
SELECT e.bucket, string_agg(lower(lpad(to_hex(coalesce(v, 0)), 2, '0')), '' ORDER BY e.b) || '06' AS filter FROM e LEFT JOIN v ON e.bucket = v.bucket AND e.b = v.b GROUP BY e.bucket""")
def bloom_build(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 64).alias("bucket"), codec.fixed32("o_orderkey").alias("key"))
    return rows.groupBy("bucket").agg(filters.bloom_filter()("key").alias("filter")).select("bucket", hexed(F.col("filter")).alias("filter"))


def key_list(key):
    """A filter without false matches, for tests: the keys themselves, of four bytes each, in order."""
    return F.aggregate(F.array_sort(F.collect_set(key)), F.lit(b""), lambda a, b: F.concat(a, b))


def in_key_list(key, listed):
    return F.exists(F.sequence(F.lit(0), (F.length(listed) / 4 - 1).cast("int")), lambda i: F.substring(listed, i * 4 + 1, F.lit(4)) == key)


def _even_blocks(spark, sf_dir):
    """Parts of even keys as if stored 100 bytes each, and their filter block in one row."""
    stored = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select((F.col("p_partkey") * 100).alias("block_offset"), codec.fixed32("p_partkey").alias("key"))
    return filters.serialize_filters(filters.block_filters(stored, build=lambda name: key_list(F.col(name))))


_LISTED = """b AS (SELECT p_partkey * 100 // 2048 AS i, p_partkey AS k FROM part WHERE p_partkey % 2 = 0),
f AS (SELECT r.i, count(k) AS n, coalesce(string_agg({le}, '' ORDER BY k & 255, (k >> 8) & 255, k >> 16), '') AS filter
  FROM (SELECT unnest(range((SELECT max(i) FROM b) + 1)) AS i) r LEFT JOIN b ON r.i = b.i GROUP BY r.i),
g AS (SELECT i, filter, CAST(4 * (sum(n) OVER (ORDER BY i) - n) AS BIGINT) AS start, CAST(4 * sum(n) OVER (ORDER BY i) AS BIGINT) AS stop FROM f)""".format(le=_le("k", 4))


@query(f"WITH {_LISTED} SELECT i AS filter_index, start, stop AS limit_, filter FROM g")
def filter_block_rows(spark, sf_dir):
    """A filter block written and read back: every filter with its bounds."""
    rows = filters.filter_rows(_even_blocks(spark, sf_dir))
    return rows.select("filter_index", "start", F.col("limit").alias("limit_"), hexed(F.col("filter")).alias("filter"))


@query(f"WITH {_LISTED} SELECT CAST(sum(stop - start) + 4 * count(*) + 5 AS BIGINT) AS bytes, string_agg(filter, '' ORDER BY i) || string_agg({_le('start', 4)}, '' ORDER BY i) || {_le('CAST(max(stop) AS BIGINT)', 4)} || '0b' AS block FROM g")
def filter_block_bytes(spark, sf_dir):
    return _even_blocks(spark, sf_dir).select(F.length("block").cast("long").alias("bytes"), hexed(F.col("block")).alias("block"))


@query("""SELECT p_partkey, p_partkey * 100 // 2048 > (SELECT max(p_partkey * 100 // 2048) FROM part WHERE p_partkey % 2 = 0) OR p_partkey % 2 = 0 AS may_match,
true AS damaged_may_match FROM part""")
def filter_block_match(spark, sf_dir):
    """Each part's own key probed at its own offset; and in a block cut short, which answers that anything may be held."""
    block = _even_blocks(spark, sf_dir)
    rows = filters.filter_rows(block).select("filter_index", "filter")
    probes = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 100).alias("block_offset"), codec.fixed32("p_partkey").alias("key"))
    asked = probes.withColumn("filter_index", F.floor(F.col("block_offset") / filters.SPAN).cast("long")).join(rows, "filter_index", "left")
    may = F.when(F.col("filter").isNull(), True).when(F.length("filter") == 0, False).otherwise(in_key_list(F.col("key"), F.col("filter")))
    damaged = filters.block_may_match("block_offset", "key", filters.parse_filters(F.lit(b"\xff\xff\x00\x00\x0b")), in_key_list)
    return asked.select("p_partkey", may.alias("may_match"), damaged.alias("damaged_may_match"))


# Keys at their edges

_NAMES = """n AS (SELECT DISTINCT p_name AS a FROM part), p AS (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM n),
d AS (SELECT a, b, list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, CAST(i AS INTEGER), 1) <> substr(b, CAST(i AS INTEGER), 1)), true) AS i FROM p WHERE b IS NOT NULL),
s AS (SELECT a, b, CASE WHEN i > 0 AND ascii(substr(a, i, 1)) + 1 < ascii(substr(b, i, 1)) THEN substr(a, 1, i - 1) || chr(ascii(substr(a, i, 1)) + 1) ELSE a END AS s FROM d)"""
_AT, _NEWEST = _le("CAST(100 * 256 + 1 AS BIGINT)", 8), "01ffffffffffffff"


@query(f"WITH {_NAMES} SELECT a AS start_key, lower(hex(encode(s))) || CASE WHEN length(s) < length(a) AND a < s THEN '{_NEWEST}' ELSE {_AT} END AS separator FROM s")
def internal_separator_keys(spark, sf_dir):
    """Between the versions at 100 of neighbouring names; what is shorter takes the version that sorts first."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("k")).distinct()
    pairs = neighbours(names).where("following is not null")
    at = lambda c: codec.internal_key(c, F.lit(100), F.lit(1))
    return pairs.select(F.col("k").alias("start_key"), hexed(separators.internal_separator(at("k"), at("following"))).alias("separator"))


@query(f"SELECT DISTINCT p_name AS k, lower(hex(encode(CASE WHEN length(p_name) > 1 THEN chr(ascii(p_name) + 1) ELSE p_name END))) || CASE WHEN length(p_name) > 1 THEN '{_NEWEST}' ELSE {_AT} END AS successor FROM part")
def internal_successor_keys(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("k")).distinct()
    return names.select("k", hexed(separators.internal_successor(codec.internal_key("k", F.lit(100), F.lit(1)))).alias("successor"))


@query(f"SELECT event_id, lower(lpad(to_hex(length(CAST(user_id AS VARCHAR)) + 8), 2, '0')) || lower(hex(encode(CAST(user_id AS VARCHAR)))) || {_le('(event_id * 256 + 1)', 8)} AS lookup FROM events")
def lookup_key_encode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", hexed(codec.lookup_key(F.col("user_id").cast("string"), "event_id")).alias("lookup"))


@query("""WITH k AS (SELECT o_orderkey AS k, substr(o_orderstatus || 'aaaaaaa', 1, CAST(o_orderkey % 8 AS INTEGER)) AS short FROM orders)
SELECT k, '(bad)' || short AS cut_short, '(bad)x\\x07' || repeat('\\x00', 7) AS unknown_kind FROM k""")
def debug_bad_key(spark, sf_dir):
    """Internal keys that don't parse: fewer than eight bytes, and a version of an unknown operation."""
    cut = F.substring(F.concat("o_orderstatus", F.lit("aaaaaaa")), F.lit(1), (F.col("o_orderkey") % 8).cast("int")).cast("binary")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), codec.debug_internal_key(cut).alias("cut_short"), codec.debug_internal_key(F.lit(b"x\x07" + bytes(7))).alias("unknown_kind")
    )


@query("SELECT o_orderkey AS k, CAST(o_orderkey * 1000003 AS VARCHAR) AS shown, CAST(o_orderkey * 1000003 AS VARCHAR) AS parsed FROM orders")
def number_text(spark, sf_dir):
    shown = text.number_text(F.col("o_orderkey") * 1_000_003)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), shown.alias("shown"), text.take_decimal(shown)["value"].cast("string").alias("parsed"))


@query("""WITH v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey < 128 THEN 1 WHEN o_orderkey < 16384 THEN 2 WHEN o_orderkey < 2097152 THEN 3 ELSE 4 END AS n FROM orders)
SELECT k, n = 1 AND k % 3 = 0 OR k % 3 > 0 AS fails_cut, true AS fails_long32, true AS fails_long64, true AS fails_prefix FROM (SELECT k, n FROM v)""")
def varint_failures(spark, sf_dir):
    """Varints cut short (for every third key by nothing at all, unless they have one byte), too long, and bytes shorter than their prefix says."""
    key = F.col("o_orderkey")
    whole = codec.varint(key)
    n = F.length(whole)
    cut = F.when(key % 3 > 0, F.substring(whole, F.lit(1), n - 1)).when(n == 1, F.lit(b"")).otherwise(whole)
    return table(spark, sf_dir, "orders").select(
        key.alias("k"), codec.decode_varint(cut, 64).isNull().alias("fails_cut"),
        codec.decode_varint(F.concat(F.lit(b"\x81\x82\x83\x84\x85"), whole), 32).isNull().alias("fails_long32"),
        codec.decode_varint(F.concat(F.lit(b"\x81\x82\x83\x84\x85\x81\x82\x83\x84\x85"), whole), 64).isNull().alias("fails_long64"),
        codec.take_length_prefixed(F.concat(codec.varint(n + 1), whole)).isNull().alias("fails_prefix"),
    )


@query("SELECT kind, shown FROM (VALUES ('ok', 'OK'), ('not_found', 'NotFound: m: d'), ('corruption', 'Corruption: m: d'), ('not_supported', 'Not implemented: m: d'), ('invalid_argument', 'Invalid argument: m: d'), ('io_error', 'IO error: m: d')) t(kind, shown)")
def status_kinds(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in text.STATUS], "kind string")
    return kinds.select("kind", text.status_text("kind", F.lit("m"), F.lit("d")).alias("shown"))


@query("SELECT l_orderkey AS k, l_linenumber AS seq, count(*) AS times FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def repeated_versions(spark, sf_dir):
    """Insertions that an ordered set would refuse: versions that are there already."""
    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("seq"), F.lit(1).alias("op"))
    broken = violations(log).where("rule = 'repeated version'").select("k", "seq")
    return log.join(broken, ["k", "seq"]).groupBy("k", F.col("seq").cast("int").alias("seq")).agg(F.count("*").alias("times"))


@query("SELECT p_partkey AS target_id, p_partkey * 9 AS target, coalesce((SELECT max(o_orderkey) FROM orders WHERE o_orderkey <= p_partkey * 9), -1) AS found FROM part")
def seek_in_descending_order(spark, sf_dir):
    """Keys in an order of their own, from the largest down."""
    targets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"), (F.col("p_partkey") * 9).alias("target"))
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return seek_many(keys, targets, order=DESCENDING).withColumn("found", F.coalesce("found", F.lit(-1)))


@query("SELECT c_custkey * 2 AS k FROM customer WHERE c_custkey * 2 NOT IN (SELECT o_custkey FROM orders)")
def absent_keys(spark, sf_dir):
    held = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("k")).join(held, "k", "left_anti")


@query("""WITH RECURSIVE r(i, s) AS (SELECT CAST(0 AS BIGINT), CAST(301 AS BIGINT) UNION ALL SELECT i + 1, s * 16807 % 2147483647 FROM r WHERE i < 2000),
e AS (SELECT i, s, lead(s) OVER (ORDER BY i) AS t FROM r)
SELECT i, s AS drawn, s % 5000 AS below_5000, s % 7 = 0 AS one_in_7, CASE WHEN i % 2 = 1 THEN t % (1 << (s % 11)) ELSE -1 END AS skewed_10 FROM e WHERE i BETWEEN 1 AND 1999""")
def drawn_numbers(spark, sf_dir):
    """Draws by number, of which no task needs those before them."""
    i = F.col("i")
    return spark.range(1, 2000).toDF("i").select(
        "i", draws.draw(i, 301).alias("drawn"), draws.uniform(i, 301, 5000).alias("below_5000"), draws.one_in(i, 301, 7).alias("one_in_7"),
        F.when(i % 2 == 1, draws.skewed(F.floor((i + 1) / 2), 301, 10)).otherwise(F.lit(-1)).alias("skewed_10"),
    )


# Logs

LOGS = 4
_B, _H = recordlog.BLOCK, recordlog.HEADER
#: A log's records with the places they take, by the format's rules alone.
_PLACES = f"""d AS (SELECT doc_id, text, doc_id % {LOGS} AS p, octet_length(encode(text)) AS n, row_number() OVER (PARTITION BY doc_id % {LOGS} ORDER BY doc_id) AS i FROM documents WHERE text IS NOT NULL),
r(p, i, start, stop) AS (SELECT DISTINCT p, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM d UNION ALL
  SELECT p, i, start, CASE WHEN n <= {_B - _H} - start % {_B} THEN start + {_H} + n
    ELSE (start // {_B} + (n - ({_B - _H} - start % {_B}) + {_B - _H - 1}) // {_B - _H}) * {_B} + {_H} + (n - ({_B - _H} - start % {_B}) - 1) % {_B - _H} + 1 END
  FROM (SELECT d.p, d.i, d.n, r.stop + CASE WHEN {_B} - r.stop % {_B} < {_H} THEN {_B} - r.stop % {_B} ELSE 0 END AS start FROM r JOIN d ON d.p = r.p AND d.i = r.i + 1)),
records AS (SELECT r.p, r.i, r.start, r.stop, d.n, d.text FROM r JOIN d ON d.p = r.p AND d.i = r.i)"""


def logs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ``LOGS`` logs, in order of their ids, by blocks ``(path, place, data)``; the second half is added to reopened logs."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select(F.concat(F.lit("log-"), (F.col("doc_id") % LOGS).cast("string")).alias("path"), F.col("doc_id").alias("place"), F.col("text").cast("binary").alias("payload"))
    late = F.col("place") >= (docs.agg(F.max("doc_id")).first()[0] or 0) // 2
    return recordlog.extend_blocks(recordlog.extend_blocks(None, rows.where(~late)), rows.where(late))


@query(f"WITH RECURSIVE {_PLACES} SELECT 'log-' || p AS path, start AS record_offset, md5(text) AS text_md5 FROM records")
def log_append_reopened(spark, sf_dir):
    """Logs written, reopened and added to: every record, where it begins, and its text."""
    records, _ = recordlog.parse_blocks(logs_of(spark, sf_dir))
    return records.select("path", "record_offset", F.md5("payload").alias("text_md5"))


START = 2 * _B + 1000


@query(f"WITH RECURSIVE {_PLACES} SELECT 'log-' || p AS path, start AS record_offset, md5(text) AS text_md5 FROM records WHERE start >= {START}")
def log_start_offset(spark, sf_dir):
    """Records that begin at or after an offset within the third block."""
    records, _ = recordlog.parse_blocks(logs_of(spark, sf_dir), start=START)
    return records.select("path", "record_offset", F.md5("payload").alias("text_md5"))


@query(f"""WITH RECURSIVE {_PLACES},
frag AS (SELECT p, i, b, (stop - 1) // {_B} AS last_b, CASE WHEN b = start // {_B} THEN least(n, {_B - _H} - start % {_B}) ELSE least({_B - _H}, n - ({_B - _H} - start % {_B}) - (b - start // {_B} - 1) * {_B - _H}) END AS size
  FROM (SELECT *, unnest(range(start // {_B}, (stop - 1) // {_B} + 1)) AS b FROM records)),
ends AS (SELECT p, max(stop) AS stop FROM records GROUP BY p),
hurt AS (SELECT p, b, least({_B}, stop - b * {_B}) AS bytes FROM (SELECT p, stop, unnest(range((stop - 1) // {_B} + 1)) AS b FROM ends) WHERE b % 5 = 2 AND stop - b * {_B} > 200),
broken AS (SELECT f.p, f.i, min(f.b) AS b FROM frag f JOIN hurt h ON f.p = h.p AND f.b = h.b GROUP BY f.p, f.i),
drops AS (SELECT '{recordlog.MISMATCH}' AS reason, bytes FROM hurt
  UNION ALL SELECT '{recordlog.BROKEN}', sum(f.size) FROM frag f JOIN broken k ON f.p = k.p AND f.i = k.i WHERE f.b < k.b GROUP BY f.p, f.i
  UNION ALL SELECT CASE WHEN f.b = f.last_b THEN '{recordlog.NO_START.format(2)}' ELSE '{recordlog.NO_START.format(1)}' END, f.size
    FROM frag f JOIN broken k ON f.p = k.p AND f.i = k.i WHERE f.b > k.b AND f.b % 5 <> 2)
SELECT reason, count(*) AS times, CAST(sum(bytes) AS BIGINT) AS bytes FROM drops GROUP BY reason""")
def log_corruption_report(spark, sf_dir):
    """Drops by reason of logs in which the first byte of data of every fifth block is changed."""
    hurt = (F.floor(F.col("place") / _B) % 5 == 2) & (F.length("data") > 200)
    changed = F.concat(F.substring("data", 1, _H), F.lit(b"\xff"), F.substring("data", _H + 2, _B))
    _, drops = recordlog.parse_blocks(logs_of(spark, sf_dir).withColumn("data", F.when(hurt, changed).otherwise(F.col("data"))))
    return drops.groupBy("reason").agg(F.count("*").alias("times"), F.sum("bytes").alias("bytes"))


@query(f"WITH RECURSIVE {_PLACES}, f AS (SELECT p, count(*) AS n, max(stop) AS bytes FROM records GROUP BY p) SELECT 'log-' || p AS path, n AS records, bytes AS end_ FROM f")
def log_sizes(spark, sf_dir):
    """What writing takes: the records and bytes of each log."""
    logs = logs_of(spark, sf_dir)
    records, _ = recordlog.parse_blocks(logs)
    n = records.groupBy("path").agg(F.count("*").alias("records"))
    ends = logs.groupBy("path").agg(F.max(F.col("place") + F.length("data")).alias("end_"))
    return ends.join(n, "path").select("path", "records", "end_")


assert MAX_SEQ == (1 << 56) - 1  # the version in the SQL of separators
