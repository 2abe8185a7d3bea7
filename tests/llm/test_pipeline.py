"""The pipeline's stages, each against brute force on its own input."""

import re

import corpus_pipeline
from cases import DOCS

STAGES = dict(corpus_pipeline.STAGES)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_stages_end_to_end(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        assert 0 < docs.count() <= count, name
        count = docs.count()
    ids = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tiny).collect()
    assert {r.doc_id for r in packed} == ids
    run = corpus_pipeline.run(spark, tiny).collect()
    key = lambda r: (r.doc_id, r.start)
    whole = lambda rows: {i: [x for r in sorted((r for r in rows if r.doc_id == i), key=key) for x in r.ids] for i in ids}
    assert whole(run) == whole(packed)


def test_quality_keeps_clean(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    kept = {r.doc_id for r in STAGES["quality classifier"](spark, docs, tiny).collect()}
    rows = labels.collect()
    good = [r.doc_id in kept for r in rows if r.quality]
    assert sum(good) >= 0.97 * len(good) and not all(r.doc_id in kept for r in rows if not r.quality)


def test_line_stage_drops_only_emptied(spark, tiny):
    line = "this very line is on every site of the corpus"
    rows = [(i, f"{line}\nown words {i}" if i % 2 else line, f"s{i}") for i in range(8)] + [(100, "", "s1"), (101, None, "s1")]
    out = {r.doc_id: r for r in STAGES["line dedup"](spark, docs_of(spark, rows), tiny).collect()}
    assert set(out) == {0, 1, 3, 5, 7, 100, 101}
    assert out[0].text == line and out[3].text == "own words 3" and out[3].n_chars == len("own words 3") and out[101].text is None


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_decontamination_stage(spark, tiny):
    items = [r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    rows = [(0, "nothing to see here at all my friend", "a"), (1, f"before it {items[0]} after it", "b"), (2, items[1].upper(), "c"), (3, " ".join(items[2].split()[:6]), "d")]
    kept = {r.doc_id for r in STAGES["benchmark decontamination"](spark, docs_of(spark, rows), tiny).collect()}
    assert kept == {0, 3}
    grams = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(max(len(w) - 4, 1))}
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    sets = [grams(t) for t in items]
    want = {r.doc_id for r in docs.collect() if not any(len(grams(r.text) & s) >= 0.8 * len(s) for s in sets)}
    assert {r.doc_id for r in STAGES["benchmark decontamination"](spark, docs, tiny).collect()} == want


def test_stages_bear_edges(spark, tiny, edges, nothing):
    """Nulls, empty, repeated and very long texts, clashing columns, and no rows, through each stage by itself and all in turn."""
    for docs in (edges, nothing, edges.select(*corpus_pipeline.COLUMNS)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, tiny)
            assert out.columns == list(corpus_pipeline.COLUMNS), name
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}, name
        docs = docs.select(*corpus_pipeline.COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, tiny)
        docs.count()
