import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing, tokens
from tidemark.llm.packing import Item, Limits, pack, split_item


@pytest.fixture(scope="module")
def full():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


LETTERS = "ab Z09\n\t  \r'sé ßıαй…$%\xa1\xa0  ’€ẞ\x0b\x0c\xad²½̀ͅ中😀    \n\nabcabc\x1c\x1f\x85\u2028\u3000\ufeff\u180e"


def test_ids_equal_the_file(full, small):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(15))) for _ in range(4000)] + [r.text for r in small.collect()[:80]]
    texts += ["don't 'tis we'll've  I'm''s 'sé x'S", "x" * 5000, "a  <|endoftext|>  b", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>é😀<|endoftext|>", "<|endoftext|", "x<|endoftext|>\ny" * 40]
    for size in (1, 7, 500):
        for at in range(0, len(texts), size):
            for t, ids in zip(texts[at : at + size], tokens.bpe_tokenizer().encode(pa.array(texts[at : at + size]))):
                assert ids.tolist() == full.encode(t, add_special_tokens=False).ids, repr(t)


CHARACTERS = " \n\t'strevldmABz09.,;-éß中\xa0\u2003"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.one_of(st.sampled_from(CHARACTERS), st.just("'"), st.characters(exclude_categories=["Cs"])), max_size=30)), max_size=5))
def test_any_texts_equal_the_file(full, texts):
    got = tokens.bpe_tokenizer().encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [full.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_known_stretches_are_bounded(full):
    own = tokens.BpeTokenizer(most=5)
    for t in ("one two three four five six seven", "two three eight nine ten", "one " * 50 + "y" * 300, "one two"):
        assert own.encode(pa.array([t]))[0].tolist() == full.encode(t, add_special_tokens=False).ids and len(own.hashes) <= 5


def test_special_token_has_its_own_id(spark):
    (row,) = packing.pack_documents(spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")).collect()
    assert list(row.ids) == [64, 220, 50256, 275, 0]


def test_items_that_fit_no_bin_are_refused():
    with pytest.raises(ValueError):
        pack([Item((0, 20), 0, np.arange(20, dtype=np.uint32))], Limits(tokens=10, segments=2, loss=10))
    for bad in ({"tokens": 0}, {"segments": 0}, {"loss": 0}):
        with pytest.raises(ValueError):
            Limits(**bad)


def test_limits_hold_together():
    rnd = random.Random(3)
    limits = Limits(tokens=100, segments=4, loss=40)
    items = []
    for i in range(300):
        n = rnd.randrange(1, 260)
        loss = np.array([rnd.random() < rnd.choice([0, 0.2, 0.9]) for _ in range(n)])
        items += split_item(Item((i, n), 0, np.arange(n, dtype=np.uint32), loss), limits)
    total = sum(len(x.ids) for x in items)
    bins = pack(items, limits)
    seen = defaultdict(list)
    for b in bins:
        size = np.sum([x.size for x in b], axis=0)
        assert (size <= [100, 4, 40]).all()
        for x in b:
            seen[x.owner].append((x.start, x.ids))
    assert sum(len(x.ids) for b in bins for x in b) == total
    for (_, n), parts in seen.items():
        assert np.concatenate([ids for _, ids in sorted(parts, key=lambda p: p[0])]).tolist() == list(range(n))


def test_largest_dot_product_goes_first():
    item = lambda i, n, loss: Item((i, n), 0, np.zeros(n, np.uint32), np.arange(n) < loss)
    limits = Limits(tokens=10, segments=3, loss=10)
    first = pack([item(0, 4, 0), item(1, 4, 4), item(2, 6, 1)], limits, least_cut=99)[0]
    assert [x.owner[0] for x in first] == [1, 2]  # 4 tokens with loss outweigh 6 without, then what fits


def test_documents(full, small):
    rows = packing.pack_documents(small, batch_pieces=50).collect()
    ids = defaultdict(dict)
    bins = defaultdict(list)
    for r in rows:
        ids[r.doc_id][r.start] = r.ids
        bins[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for r in small.collect():
        want = full.encode(r.text, add_special_tokens=False).ids + [0]
        assert [x for start in sorted(ids[r.doc_id]) for x in ids[r.doc_id][start]] == want
        assert {x.doc_tokens for x in rows if x.doc_id == r.doc_id} == {len(want)}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) * 1024 <= 1.03 * sum(r.length for r in rows) + 1024


def check_conversations(full, rows, packed, limits):
    """Every example whole, its loss where the roles say, no limit exceeded, no gap."""
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        ids = full.encode(text or "", add_special_tokens=False).ids + [0]
        want[conv] += [(i, role == "assistant") for i in ids]
    got, bins = defaultdict(list), defaultdict(list)
    for r in packed:
        got[r.conv_id].append((r.start, list(zip(r.ids, r.loss))))
        bins[r.sequence_id].append(r)
        assert r.length == len(r.ids) and r.example_tokens == len(want[r.conv_id])
    assert {k: [x for _, part in sorted(v, key=lambda p: p[0]) for x in part] for k, v in got.items()} == dict(want)
    for conv, parts in got.items():
        at = 0
        for start, part in sorted(parts, key=lambda p: p[0]):
            assert start == at, conv
            at += len(part)
    for b in bins.values():
        assert sum(r.length for r in b) <= limits.tokens and len(b) <= limits.segments and sum(sum(r.loss) for r in b) <= limits.loss
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length


def test_conversations(spark, tiny, full):
    df = spark.read.parquet(f"{tiny}/conversations.parquet")
    check_conversations(full, [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()], packing.pack_conversations(df).collect(), Limits(1024, 16, 768))


CONVERSATION = "conv_id long, turn long, role string, text string"


def test_conversation_edges(spark, full):
    """Nulls in every column, repeated turns, a long turn, clashing columns, one conversation with most rows, no rows."""
    rows = [(1, 2, "assistant", "yes it is"), (1, 1, "user", "is it"), (2, 1, None, "no role"), (3, 1, "assistant", None), (3, 2, "user", ""), (None, None, "assistant", "no id"), (None, 1, "user", "nor here")]
    rows += [(4, 1, "user", "same"), (4, 1, "user", "same"), (5, 1, "assistant", "very long " * 3000)] + [(9, i, ("user", "assistant")[i % 2], f"turn {i} of many") for i in range(400)]
    df = spark.createDataFrame(rows, CONVERSATION).selectExpr("*", "'x' AS id", "'x' AS part", "'x' AS own", "'x' AS ids", "'x' AS at", "'x' AS n")
    limits = Limits(tokens=64, segments=3, loss=40)
    check_conversations(full, rows, packing.pack_conversations(df, limits=limits).collect(), limits)
    assert packing.pack_conversations(spark.createDataFrame([], CONVERSATION)).count() == 0


def test_conversations_query(spark, tiny):
    from tidemark.llm import queries

    out = queries.queries()["instruction_packing"](spark, tiny).collect()
    sums = defaultdict(int)
    for r in out:
        sums[r.sequence_id] += r.n_loss
    assert out and max(sums.values()) <= 768 and any(n > 0 for n in sums.values())
