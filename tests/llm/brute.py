"""Plain Python versions to compare with, and awkward rows."""

from itertools import combinations

HOSTILE = [None, "", " \t\n", "word", "one two", "a " * 30_000, "é" * 5000, "x<|im_end|>y <\\|z", "\u00a0\u2003", "1234 5678", "a\x00b c"]

DOC = "doc_id long, text string, lang string, source string, n_chars long, Score double, rank string, _c0 string"


def docs(spark, rows):
    """documents with extra columns whose names clash with results; rows of (doc_id, text[, lang])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, 1.0, "r", "c") for r in rows]
    return spark.createDataFrame(full, DOC)


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n, percent):
    """{doc_id: (set size, smallest id reachable)} for unique non-null ids."""
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        both = len(x & y)
        if x and y and 100 * both >= percent * (len(x) + len(y) - both):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}
