"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, word string, v double"


def docs(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang); extra columns clash with inner names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1]), 7, "word", 0.5) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (4, "one"),
    (None, "no id here at all"),
    (5, "Straße ÉCOLE 日本語 \U0001f642 don't \x1c a\x00b  two   spaces\n\nline 7"),
    (6, "long " * 30_000),
    (7, "12345 67890"),
]


def components(n, linked):
    """Smallest member reachable for each of n items, by brute force."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(x) for x in range(n)]
