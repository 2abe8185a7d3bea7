"""Every operator over rows that are empty, null, repeated, very long or named like its own columns, and over no rows."""

from collections import Counter

import pytest
from cases import DOCS, EDGES
from pyspark.sql import functions as F

from tidemark.llm import decontam, licenses, line_dedup, lm, media, ngram_join, packing, quality, secrets, toxicity

IDS = Counter(r[0] for r in EDGES)


def labelled(spark):
    rows = [(4, 1, 0), (5, 0, 1), (6, 1, 0), (None, 1, 1), (8, None, None), (5, 1, 0), (999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "same text here twice over and"), (2, None), (3, ""), (None, "some words"), (4, "word")], "item_id long, text string")


ROWWISE = {
    "secrets": lambda d, s: secrets.scan_secrets(d),
    "media": lambda d, s: media.read_media(media.media_columns(d)),
    "licenses": lambda d, s: licenses.scan_licenses(d),
    "quality": lambda d, s: quality.score_quality(d, quality.fit_quality(d, quality.grades(labelled(s)))),
    "toxicity": lambda d, s: toxicity.score_toxicity(d, toxicity.fit_lexicon(d, labelled(s))),
    "lm": lambda d, s: lm.score_texts(d, training=F.col("doc_id") != 4),
    "lines": lambda d, s: line_dedup.dedup_lines(d),
}


@pytest.mark.parametrize("name", sorted(ROWWISE))
def test_one_row_for_each_row(spark, edges, nothing, name):
    got = ROWWISE[name](edges, spark).select("doc_id").collect()
    assert Counter(r.doc_id for r in got) == IDS
    assert ROWWISE[name](nothing, spark).count() == 0


def test_equal_rows_get_equal_results(spark, edges):
    for name in ("secrets", "media", "licenses", "quality", "toxicity", "lm"):
        out = ROWWISE[name](edges, spark)
        rows = [tuple(map(str, r[1:])) for r in out.where("doc_id = 5").collect()]
        assert len(rows) == 2 and rows[0] == rows[1], name


def test_packing_edges(edges, nothing):
    rows = packing.pack_documents(edges).collect()
    assert set(r.doc_id for r in rows) == set(IDS) and packing.pack_documents(nothing).count() == 0
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]


def test_join_edges(edges, nothing):
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_texts(edges).collect()}
    assert set(rows) == set(IDS) - {None} and rows[1] == (0, 1) and rows[2] == (0, 2) and rows[3] == (0, 3) and rows[4] == (1, 4) and rows[5][1] == rows[6][1] == 5 and rows[8] == (1, 8)
    assert ngram_join.similar_texts(nothing).count() == 0
    kept = ngram_join.keep_one(edges)
    assert kept.columns == edges.columns and Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter({**IDS, 6: 0}) - Counter()


def test_decontamination_edges(spark, edges, nothing):
    found = {(r.doc_id, r.item_id) for r in decontam.contained_items(edges, items(spark)).collect()}
    assert found == {(5, 1), (6, 1), (4, 4)}
    assert decontam.contained_items(nothing, items(spark)).count() == decontam.contained_items(edges, items(spark).limit(0)).count() == 0
    kept = decontam.drop_contaminated(edges, items(spark))
    assert kept.columns == edges.columns and Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter({k: n for k, n in IDS.items() if k not in (4, 5, 6)})


def test_line_edges(spark):
    long = "a line that stands on very many sites of the corpus"
    rows = [(i, f"{long}\nown line number {i}\n{long}", "en", f"s{i % 7}", 0) for i in range(20)] + [(None, long, None, None, 0)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[0].text == f"{long}\nown line number 0" and (out[0].n_lines, out[0].n_removed) == (3, 1)
    assert out[5].text == "own line number 5" and out[5].n_removed == 2 and out[None].text == "" and out[None].n_removed == 1


def test_classifier_without_labels(spark, edges):
    none = labelled(spark).limit(0)
    model = quality.fit_quality(edges, quality.grades(none))
    assert model.grades == [0.0] and quality.score_quality(edges, model).where("tail <> 0").count() == 0
    lexicon = toxicity.fit_lexicon(edges, none)
    assert {t for t, _ in lexicon.terms} == set(toxicity.SEED)


REPORTS = {
    "secrets": lambda d, s: secrets.secrets_report(d),
    "media": lambda d, s: media.media_report(d),
    "licenses": lambda d, s: licenses.licenses_report(d),
    "quality": lambda d, s: quality.quality_report(d, labelled(s)),
    "lm": lambda d, s: lm.lm_report(d),
    "toxicity": lambda d, s: toxicity.toxicity_report(d, labelled(s)),
    "lines": lambda d, s: line_dedup.lines_report(d),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_of_edges(spark, edges, nothing, name):
    """The queries' own functions: a row for each row, equal rows for equal rows, none for none."""
    rows = REPORTS[name](edges, spark).collect()
    assert Counter(r.doc_id for r in rows) == IDS
    twice = [tuple(map(str, r)) for r in rows if r.doc_id == 5]
    assert twice[0] == twice[1]
    assert REPORTS[name](nothing, spark).count() == 0


def test_classifiers_without_any_label(spark, edges):
    none = labelled(spark).limit(0)
    assert {(r.tail, r.keep) for r in quality.quality_report(edges, none).collect()} == {(0.0, False)}
    assert Counter(r.doc_id for r in toxicity.toxicity_report(edges, none).collect()) == IDS


def test_quality_sample_is_the_same_each_time(spark, edges):
    """Repeated ids count once, with their first text, however rows are dealt."""
    rated = spark.createDataFrame([(1, 0.0), (4, 1.0), (5, 0.0), (5, 3.0), (6, 1.0), (7, 2.0), (None, 1.0), (8, None)], "doc_id long, rating double")
    models = [quality.fit_quality(d, rated) for d in (edges, edges.repartition(7, "text"), edges.union(edges))]
    for m in models[1:]:
        assert m.grades == models[0].grades and (m.weights == models[0].weights).all() and (m.cuts == models[0].cuts).all()


def test_filtering_stages_of_edges(spark, edges):
    kept = quality.keep_good(edges, labelled(spark))
    assert kept.columns == edges.columns and {r.doc_id for r in kept.select("doc_id").collect()} <= set(IDS)
    assert quality.keep_good(edges.limit(0), labelled(spark)).count() == 0


def test_rows_without_ids_lose_their_own_boilerplate(spark):
    """Rows without an id are told apart by their texts; none is a keeper beside a row that has an id."""
    shared = [f"shared line number {k} of the corpus" for k in range(3)]
    rows = [(i, "\n".join(shared), "en", f"s{i}", 0) for i in range(6)]
    rows += [(None, f"{shared[k]}\nwords of row {k} alone", "en", f"s{k}", 0) for k in range(3)] + [(None, "nothing shared in here at all", "en", "s1", 0)] * 2
    out = [r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect() if r.doc_id is None]
    assert sorted(r.text for r in out) == ["nothing shared in here at all"] * 2 + [f"words of row {k} alone" for k in range(3)]
    assert sorted(r.n_removed for r in out) == [0, 0, 1, 1, 1]
