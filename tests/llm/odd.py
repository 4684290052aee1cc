"""Awkward inputs that every text operator must take."""

from __future__ import annotations

LONG = "one two three four five six seven eight nine ten " * 6_000

#: (doc_id, text, lang, source, n_chars, and columns whose names operators use inside)
TEXTS = [
    (1, "Plain words here, and some more words so that there are enough of them for every rule we have"
        " today and also tomorrow.\nSecond line.\n", "en", "src0"),
    (2, None, "en", "src0"),
    (3, "", None, None),
    (4, " \t\n\x0b\n ", "en", "src1"),
    (5, LONG, "en", "src0"),
    (6, LONG, "en", "src0"),
    (7, "ÉÀ straße\u00a0日本語 ▁marker▁ \x00 \U0001f600\r\nDONE\n", "fr", "src2"),
    (8, "one line of more than fifty bytes that several documents share, word for word.\nA", "en", "s"),
    (9, "one line of more than fifty bytes that several documents share, word for word.\nB", "en", "s"),
    (9, "one line of more than fifty bytes that several documents share, word for word.\nB", "en", "s"),
    (9, "another text under the same id", "en", "s"),
    (None, "a text without an id, which has more words than five", "en", "s"),
    (None, None, None, None),
]


def documents(spark, rows=TEXTS):
    """The rows as a documents table with extra columns of clashing names."""
    data = [
        (*r, len(r[1] or ""), "x", 1, 2, 3.0, "y", [1]) for r in rows
    ]
    return spark.createDataFrame(
        data,
        "doc_id bigint, text string, lang string, source string, n_chars bigint,"
        " doc string, d bigint, pos int, score double, h string, words array<int>",
    )


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
