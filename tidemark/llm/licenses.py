"""License scan with DataFrame functions only: ordered rules behind keywords, overlaps settled by containment and priority."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import ascii_lower
from .license_rules import Rule, rules

# What separates words, and the base phrases.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))

_SPAN = "struct<start:int,end:int,order:int,label:string,certainty:double>"
#: Folds that append to an array do so within stretches of this length, since an append copies the array.
_STRETCH = 256


def _stretches(array: Column) -> Column:
    """``array``, which is a variable or a column, as it is looked up for each, cut into arrays of ``_STRETCH`` items."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), F.lit(_STRETCH))
    return F.transform(starts, lambda i: F.slice(array, i, F.lit(_STRETCH)))


def _append(array: Column, item: Column) -> Column:
    return F.concat(array, F.array(item))


def _ends(sizes: Column) -> Column:
    """Running sums of an array of integers."""
    none = F.array().cast("array<int>")
    within = lambda part: F.aggregate(part, none, lambda sums, n: _append(sums, n + F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0))))

    def join(done: Column, sums: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0))
        return F.concat(done, F.transform(sums, lambda n: n + before))

    return F.aggregate(F.transform(_stretches(sizes), within), none, join)


def _found(low: Column, rule: Column) -> Column:
    """Spans of a rule's matches: what lies between them, by ``split``, gives their places."""
    none = F.array().cast(f"array<{_SPAN}>")

    def span(m: Column, end: Column) -> Column:
        return F.struct((end - F.length(m)).alias("start"), end.alias("end"), rule["order"].alias("order"), rule["label"].alias("label"), rule["certainty"].alias("certainty"))

    def spans(matched: Column) -> Column:
        between = F.slice(F.split(low, rule["pattern"], -1), F.lit(1), F.size(matched))
        sizes = F.zip_with(matched, between, lambda m, x: F.length(x) + F.length(m))
        return let(sizes, lambda n: F.zip_with(matched, _ends(n), span))

    return let(F.regexp_extract_all(low, rule["pattern"], F.lit(0)), lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(none))


def _settle(spans: Column) -> Column:
    """Detections left: none lies within another, and of two that overlap the one of worse priority goes.

    Taken by start, then longest, then priority, a span that ends no later than one before it lies within that one.
    What is left has rising starts and ends, so overlaps are between neighbours.
    """
    key = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["order"].alias("order"), s.alias("span")))
    ordered = F.transform(F.array_sort(key), lambda k: k["span"])
    empty = F.array().cast(f"array<{_SPAN}>")

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        within = F.coalesce(last["end"] >= s["end"], F.lit(False))
        overlaps = F.coalesce(last["end"] > s["start"], F.lit(False))
        better = s["order"] < last["order"]
        return (
            F.when(within, kept)
            .when(overlaps & better, _append(F.slice(kept, F.lit(1), F.size(kept) - 1), s))
            .when(overlaps, kept)
            .otherwise(_append(kept, s))
        )

    def go_on(done: Column, part: Column) -> Column:
        """Only the last span kept so far meets the next stretch."""
        last = F.slice(done, F.greatest(F.size(done), F.lit(1)), F.lit(1))
        return F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.aggregate(part, last, step))

    return let(ordered, lambda spans: F.aggregate(_stretches(spans), empty, go_on))


def _rule_array(table: list[Rule]) -> Column:
    """The rules as one literal."""
    return F.from_json(F.lit(json.dumps([asdict(r) for r in table])), "array<struct<order:int,label:string,keyword:string,pattern:string,certainty:double>>")


def scan_licenses(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """One row for each input row: id, ``n_words``, ``places array<struct<at,label>>`` of base phrases, ``detections`` of the rules.

    ``detections`` is an array of (start, end, order, label, certainty) in code points of the text, in order, none overlapping: of
    the matches of all rules whose keyword occurs, those within another are dropped (equal spans: the later rule's), then of
    two neighbours that still overlap the one of lower priority. Texts are read whole in lower case (A-Z); null is empty: no word,
    place or detection. Null and repeated ids pass; other columns are not read. No shuffle and no Python; the work on a row
    grows with its detections, not with their square.
    """
    table = rules() if table is None else table
    low = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    out = df.select(F.col(id_col).alias("id"), low.alias("low"))
    words = F.array_remove(F.split("low", SEPARATORS, -1), "")
    keywords = F.array(*map(F.lit, sorted({r.keyword for r in table})))
    out = out.withColumn("words", words).withColumn("present", F.filter(keywords, lambda k: F.contains("low", k)))
    active = F.filter(_rule_array(table), lambda r: F.array_contains("present", r["keyword"]))
    spans = F.flatten(F.transform(active, lambda r: _found(F.col("low"), r)))
    places = F.filter(
        F.transform(
            "words",
            lambda w, i: F.struct(
                i.alias("at"),
                F.coalesce(*(F.when(_phrase(w, i, phrase), F.lit(label)) for label, phrase in PHRASES)).alias("label"),
            ),
        ),
        lambda p: p["label"].isNotNull(),
    )
    none = F.array().cast(f"array<{_SPAN}>")
    found = out.select(
        F.col("id").alias(id_col),
        F.size("words").cast("long").alias("n_words"),
        F.when(F.contains("low", F.lit("license")), places).otherwise(F.array().cast("array<struct<at:int,label:string>>")).alias("places"),
        F.when(F.size("present") > 0, spans).otherwise(none).alias("spans"),
    )
    return found.select(id_col, "n_words", "places", F.when(F.size("spans") > 0, _settle(F.col("spans"))).otherwise(none).alias("detections"))


def _phrase(word: Column, i: Column, phrase: tuple[str, ...]) -> Column:
    hit = word == phrase[0]
    for k, w in enumerate(phrase[1:], 1):
        hit = hit & F.coalesce(F.get("words", i + k) == w, F.lit(False))
    return hit


def licenses_report(docs: DataFrame) -> DataFrame:
    """Counts, places and labels of ``documents``; the score is the largest certainty, 0.9 for a base phrase."""
    found = scan_licenses(docs)
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"]))))
    sure = F.coalesce(F.array_max(F.transform("detections", lambda d: d["certainty"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(sure, F.when(F.size("places") > 0, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
