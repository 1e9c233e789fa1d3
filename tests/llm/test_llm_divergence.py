"""The divergence of sources against sums over all pairs of sources and all terms."""

import collections
import re

import pytest

from sgspark.llm import divergence
from test_llm_operators import SCHEMA

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def truth(rows, least=3, top=200):
    """(lang, source, part, item, value, rank) by definition; rows: (text, lang, source)."""
    docs = [((lang or ""), (source or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = collections.Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        sources = {d[1] for d in docs if d[0] == lang}

        def shares(source):
            c = collections.Counter(t for d in docs if d[0] == lang and source in (None, d[1]) for t in d[2])  # noqa: B023
            n = sum(c[t] for t in kept)  # noqa: B023
            return c, {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}  # noqa: B023

        _, whole = shares(None)
        own = {s: shares(s) for s in sources}
        for a in sources:
            pair = sorted((-sum((own[a][1][t] - own[b][1][t]) ** 2 // own[b][1][t] for t in kept), b.encode()) for b in sources if b != a)
            term = sorted((-((own[a][1][t] - whole[t]) ** 2 // whole[t]), t.encode()) for t in kept if own[a][0][t] and own[a][1][t] > whole[t])[:top]
            for part, made in (("pair", pair), ("term", term)):
                out += [(lang, a, part, item.decode(), -value, k) for k, (value, item) in enumerate(made, 1)]
    return sorted(out)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(1, r[0], r[1], r[2], 1, 0.5, "u", 3, "k") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in divergence.audited(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_rows_of_every_kind(spark):
    rows = [
        ("The cat the CAT naïve Straße", "en", "a"), ("the dog Ünder under", "en", "a"), ("the cat dog dog", "en", "b"), ("cat, cat; cat the", "en", "c"), ("", "en", "empty"), (None, "en", "null"),
        ("das das Haus", "de", "a"), ("das Haus", "de", None), ("das Haus Haus x1y", "de", ""), ("one", "xx", "alone"), ("two", "yy", "p"), ("three", "yy", "q"), (None, None, None), ("the cat dog dog", "en", "b"),
        ("w " * 30000 + "cat the", "en", "long"), ("ﬁ 🦙 日本 日本", "ja", "b"), ("日本 🦙", "ja", "é"), ("日本 🦙 日本", "ja", "z"),
    ]
    assert found(spark, rows) == truth(rows)
    assert found(spark, rows, least=1) == truth(rows, least=1)
    assert found(spark, rows, least=1, top=2) == truth(rows, least=1, top=2)


def test_many_sources_and_ties(spark):
    rows = [(f"common word{i % 7} word{i % 3} " * (1 + i % 4), "en", f"s{i % 23}") for i in range(120)]
    assert found(spark, rows) == truth(rows)


def test_no_rows(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("count, n, v, want", [(0, 0, 1, 10**9 + 1), (10**15, 10**15, 10**6, 1 + 10**9 * (10**15 + 1) // (10**15 + 10**6)), (0, 0, 0, None)])
def test_shares_of_large_counts(spark, count, n, v, want):
    got = spark.createDataFrame([(count, n, v)], "c long, n long, v long").select(divergence.share("c", "n", "v")).first()[0]
    assert got == want
