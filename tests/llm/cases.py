"""Rows that operators have to bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and blank texts, repeated rows and ids, a very long text, characters beyond the basic plane.
EDGES = [
    (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n\t ", "en", "a", 4), (4, "word", "en", "b", 4), (5, "same text here twice over and over again", "en", "a", 40),
    (5, "same text here twice over and over again", "en", "a", 40), (6, "same text here twice over and over again", "fr", "b", 40), (None, "a row without an id, which may come with any text", "en", "c", 10),
    (None, None, None, None, None), (7, "ÄÖ 😀 naïve ﬁ İstanbul KK 中文 " * 3, "de", "d", 30), (8, "long " * 60_000, "en", "e", 300_000), (9, "x" * 200_000, "en", "e", 200_000), (-4, "negative ids count too", "es", "f", 20),
]
