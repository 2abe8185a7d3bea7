"""Line dedup, decontamination and n-gram join, against SQL and brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers import assert_same

from tidemark.llm import common, decontam, line_dedup, ngram_join, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, tiny, name):
    assert_same(queries.queries()[name](spark, tiny), queries.oracle_sql()[name], tiny)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql_without_broadcasts(spark, tiny, name, monkeypatch):
    """Sides too large to broadcast are shuffled, with the same rows."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert_same(queries.queries()[name](spark, tiny), queries.oracle_sql()[name], tiny)


def test_join_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = near_copies(11)
    got = ngram_join.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 85)


def test_rare_sites_are_counted_exactly(spark):
    """Lines on as many sites as the threshold, one fewer and many more."""
    rows = [(100 * n + s, f"a line that is on {n} sites", f"site {s}") for n in (1, 4, 5, 6, 300) for s in range(n)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = line_dedup.line_spread(df).collect()
    assert sorted((r.keeper // 100, r.exact) for r in found if r.exact) == [(5, True), (6, True)] and len(found) == 3
    assert [r.sites for r in found if r.exact and r.keeper == 500] == [5]


def test_signatures_never_miss(spark):
    """A text that lacks the largest share of an item still allowed is always a candidate."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    items, docs = [], []
    for i in range(60):
        item = rnd.sample(words, rnd.choice([5, 6, 9, 24, 40, 100, 300]))
        n = max(len(item) - 4, 1)
        keep = -(-n * 8 // 10)
        part = item[: keep + 4]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(rnd.sample(words, 500) + part + rnd.sample(words, 500))))
        short = item[: keep + 3] if len(item) > 9 else ["nothing"]
        docs.append((1000 + i, " ".join(rnd.sample(words, 50) + ["xx"] + short + ["yy"])))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contained_items(a, b).collect()} >= {(i, i) for i in range(60)}
    assert not any(r.doc_id >= 1000 and len(items[r.item_id][1].split()) > 9 for r in decontam.contained_items(a, b).collect())


def test_native_plan(spark, tiny):
    for name in ("op3_decontamination", "op4_licenses"):
        plan = queries.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan), name


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(parent, a), find(parent, b)))
                parent[y] = x
    return {i: (len(sets[i]), find(parent, i)) for i in sets}


def near_copies(seed):
    """Chains and clusters of texts that differ by a few words each."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(800)]
    rows = []
    for _ in range(25):
        own = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 8, 12, 30, 90, 250]))]
        for _ in range(rnd.randrange(1, 9)):
            rows.append((len(rows), " ".join(own)))
            own = list(own)
            for _ in range(rnd.randrange(0, max(2, len(own) // 40 + 1))):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            if rnd.random() < 0.3:
                own = own[: max(1, len(own) - len(own) // 15)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("rules", [
    ngram_join.JoinRules(), ngram_join.JoinRules(n=5, percent=80, tile=900), ngram_join.JoinRules(n=2, percent=60, bitmap_words=1),
    ngram_join.JoinRules(sieve=0, tile=900), ngram_join.JoinRules(sieve=1500, tile=300),
])
def test_join_equals_brute_force(spark, rules):
    rows = near_copies(rules.n)
    got = ngram_join.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), rules=rules).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, rules.n, rules.percent)


def test_linked_sets_share_a_part():
    rules = ngram_join.JoinRules()
    rnd = random.Random(9)
    linked = 0
    for _ in range(2000):
        size = rnd.choice([1, 2, 3, 4, 5, 7, 9, 13, 20, 40, 100, 300])
        a = {rnd.getrandbits(64) for _ in range(size)}
        b = set(rnd.sample(sorted(a), max(1, size - rnd.randrange(0, size // 8 + 2)))) | {rnd.getrandbits(64) for _ in range(rnd.randrange(0, size // 10 + 2))}
        if rules.linked(len(a & b), len(a), len(b)):
            linked += 1
            keys = [set(ngram_join.part_keys(np.array(sorted(s), dtype=np.uint64), rules).tolist()) for s in (a, b)]
            assert keys[0] & keys[1]
    assert linked > 300


def test_bitmap_bound_is_an_upper_bound():
    rng = np.random.default_rng(2)
    rules = ngram_join.JoinRules(percent=30, bitmap_words=1)
    pool = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 60))) for _ in range(60)]
    tile = ngram_join.Tile(list(range(60)), sets, [-1] * 60, rules)
    for i in range(60):
        near = set(tile.candidates(i, np.arange(60)).tolist())
        assert {j for j in range(60) if tile.linked(i, j)} <= near


def test_components_both_ways(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 130)] + [(rnd.randrange(400, 900), rnd.randrange(400, 900)) for _ in range(200)] + [(-5, 7), (7, -9), (3, 3)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = sorted((find(parent, a), find(parent, b)))
        parent[y] = x
    want = {x: find(parent, x) for x in parent if x != 3}
    df = spark.createDataFrame(edges, "a long, b long")
    for bound in (10**6, 0):
        assert dict(map(tuple, common.components(df, one_task=bound).collect())) == want


def test_shingle_sets_equal_plain_sets(small):
    from tidemark.llm.textvec import shingle_hashes, word_hashes

    texts = [r.text for r in small.limit(50).collect()] + ["", "a", "a b", "a b c d", None, "A a\tA\x0ba", "é É é"]
    column = pa.array(texts)
    for cut in (column, column[3:40]):
        hashes, rows = word_hashes(cut)
        values, bounds = shingle_hashes(hashes, rows, 4, len(cut))
        assert [len(np.unique(values[a:b])) for a, b in zip(bounds[:-1], bounds[1:])] == [len(shingles(t, 4)) for t in cut.to_pylist()]


def test_materialized_tables_can_be_discarded(spark):
    common.discard(spark)
    df = common.materialize(spark.range(5), "five")
    files = df.inputFiles()
    assert df.count() == 5 and common.discard(spark) == 1 and common.discard(spark) == 0
    common.materialize(spark.range(1), "before")
    mark = common.written()
    kept = [common.materialize(spark.range(k), "kept") for k in (2, 3)][1]
    assert common.discard(spark, since=mark, keep=1) == 1 and kept.count() == 3 and common.written() == mark + 1 and common.discard(spark) == 2
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT|PATH"):
        spark.read.parquet(files[0]).count()
