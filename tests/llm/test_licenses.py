import dataclasses
import re
import time

from tidemark.llm import license_rules, licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

TEXTS = [
    "Released under the MIT License. Licensed under the Apache License, Version 2.0.\nThe GNU General Public License, version 3 or (at your option) any later version.",
    "# SPDX-License-Identifier: GPL-2.0-or-later\n# Copyright (c) 2020 Someone. All rights reserved.",
    "Licensed under CC BY-NC-SA 4.0, see https://creativecommons.org/licenses/by-nc-sa/4.0 and the Creative Commons Attribution-NonCommercial 3.0 licence",
    "the mit license " * 50, "licensing is no license", "", "This work is in the public domain; GPL, LGPLv3, AGPL-3.0 and MPL 2.0 are not.", "mit-license general*public*license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and so on", "all rights reserved all rights reserved", "prefix gplx nogpl",
]


def brute(text):
    """All rules by Python's engine, then pairwise suppression."""
    low = text.translate(LOWER)
    spans = [(m.start(), m.end(), r.order, r.label) for r in license_rules.rules() if r.keyword in low for m in re.finditer(r.pattern, low, re.ASCII)]
    inside = lambda s, o: o is not s and o[0] <= s[0] and s[1] <= o[1] and ((o[0], o[1]) != (s[0], s[1]) or o[2] < s[2])
    left = sorted(s for s in spans if not any(inside(s, o) for o in spans))
    kept = []
    for s in left:
        if kept and kept[-1][1] > s[0]:
            if s[2] < kept[-1][2]:
                kept[-1] = s
            continue
        kept.append(s)
    return kept


def test_rules():
    table = license_rules.rules()
    assert len(table) > 300 and len({(r.label, r.keyword, r.pattern) for r in table}) == len(table)
    for r in table:
        re.compile(r.pattern)


def test_detections_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        assert [(d.start, d.end, d.order, d.label) for d in r.detections] == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_labels(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.licenses_report(df).collect()}
    assert got[0].base_labels == "apache,gpl,mit" and {"gpl-3.0-or-later", "apache-2.0"} <= set(got[0].labels.split(","))
    assert (got[0].n_base, got[0].first_word, got[0].last_word) == (3, 3, 15)
    assert "cc-by-nc-sa-4.0" in got[2].labels and "cc-by-nc-3.0" in got[2].labels
    assert got[3].n_base == 50 and got[5].labels == "" and got[5].score == 0 and got[5].first_word is None
    assert got[7].base_labels == "gpl,mit" and got[10].labels == ""


def test_report_equals_brute_force(small):
    got = {r.doc_id: r for r in licenses.licenses_report(small).collect()}
    for r in small.collect():
        words = WORD.findall(r.text.translate(LOWER))
        places = [(i, label) for i in range(len(words)) for label, p in licenses.PHRASES if tuple(words[i : i + len(p)]) == p]
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.base_labels) == (len(words), len(places), ",".join(sorted({label for _, label in places})))
        assert x.labels == ",".join(sorted({label for _, label in places} | {s[3] for s in brute(r.text)})) and 0 <= x.score <= 1


def _must_hold(nodes, keyword):
    """Whether every match of a parsed expression holds ``keyword``."""
    run = ""
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            if keyword in run:
                return True
            continue
        run = ""
        if name == "SUBPATTERN" and _must_hold(arg[3], keyword):
            return True
        if name == "BRANCH" and all(_must_hold(branch, keyword) for branch in arg[1]):
            return True
        if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1 and _must_hold(arg[2], keyword):
            return True
    return False


def test_no_match_lacks_its_keyword():
    table = license_rules.rules()
    gates = {}
    for r in table:
        gates.setdefault((r.label, r.pattern), []).append(r.keyword)
    short = {("cc by", "cc-by")}  # the two spellings of one pattern, each a rule
    lacking = [k for k, words in gates.items() if tuple(words) not in short and not all(_must_hold(re._parser.parse(k[1]), w) for w in words)]
    assert lacking == []
    assert all(k[1].startswith(r"\bcc[- ]by") for k, words in gates.items() if tuple(words) in short)


BROKEN = {
    "permission is hereby\ngranted, free of charge, to any person obtaining a copy of this software": "mit-text",
    "the GNU General\n# Public License, version 3, or any later": "gpl-3.0-or-later",
    "this program is free\nsoftware; you can redistribute it and/or modify": "gpl-text",
    "is in the public\ndomain": "public-domain",
    "Creative\n * Commons Attribution 4.0": "cc-by-4.0",
    "an end-user license agreement": "eula",
    "all  rights\treserved": "all-rights-reserved",
    "a noncommercial licence": "ncl",
    "the simplified license": "bsd-2-clause",
    "Licence Ouverte": "etalab-2.0",
    "shall be used for good, not evil": "json",
    "unauthorised copying of this file is prohibited": "proprietary",
    "in no event shall the authors\nor holders be liable": "liability-disclaimer",
    "neither the name of the\ncompany nor the names of its contributors": "bsd-3-clause-text",
}


def test_line_breaks_and_comment_marks(spark, monkeypatch):
    """Detections equal those of the patterns alone, without keywords, however a text parts its words."""
    table = license_rules.rules()
    monkeypatch.setattr(license_rules, "rules", lambda: [dataclasses.replace(r, keyword="") for r in table])
    every = [*BROKEN, *TEXTS]
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = {r.doc_id: [(d.start, d.end, d.label) for d in r.detections] for r in licenses.scan_licenses(df, table=table).collect()}
    for i, text in enumerate(every):
        assert got[i] == [(a, b, label) for a, b, _, label in brute(text)], text
        assert BROKEN.get(text) in {*(x[2] for x in got[i]), None}, text


def test_time_grows_with_the_detections(spark):
    """One text of nothing but license lines takes about as long as ten of a tenth of it."""
    line = "Released under the MIT License. Licensed under the Apache License, Version 2.0; gpl-3.0, all rights reserved. "
    took, n = [], []
    for texts in ([line * 200] * 10, [line * 2000]):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        for _ in range(2):  # the first compiles
            began = time.perf_counter()
            rows = licenses.scan_licenses(df).collect()
            last = time.perf_counter() - began
        took.append(last)
        n.append(sum(len(r.detections) for r in rows))
    assert n[0] == n[1] == 10_000 and took[1] < 3 * took[0] + 3
