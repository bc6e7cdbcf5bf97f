"""Radix select against sorting, and the audit's counts and pairs against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from aerolith.llm import divergence, ranking

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.mark.parametrize(("k", "bounded"), [(3, 1024), (3, 2), (10, 1)])
def test_top_k(spark, k, bounded):
    """Values over all bits, ties by bytes (beginnings alike, empty items, characters beyond the first plane), groups of null and fewer rows, repeated rows."""
    rng = random.Random(k)
    rows = [("many", "a" * 40 + f"{i:03}", 7) for i in range(60)] + [("many", "b", 9), ("many", "\U0001f600", 7), ("many", "￮", 7), ("many", "a" * 40, 7), ("many", "", 7)]
    rows += [(None, f"x{i}", rng.choice([-5, 0, 3, 2**40])) for i in range(20)] + [("few", "é", -(2**50)), ("few", None, 1), ("few", "null", None)]
    rows += [("same", "twice", 4)] * 5 + [("random", str(rng.random()), rng.randrange(-(2**62), 2**62)) for _ in range(50)]
    got = defaultdict(list)
    for r in ranking.top_k(spark.createDataFrame(rows, "g string, item string, v long"), ["g"], "v", "item", k, bounded).collect():
        got[r.g].append((r.rank, r.item, r.v))
    want = defaultdict(list)
    for g, item, v in sorted(((g, i or "", v) for g, i, v in rows if v is not None), key=lambda r: (-r[2], r[1].encode())):
        want[g].append((len(want[g]) + 1, item, v))
    assert {g: sorted(x) for g, x in got.items()} == {g: x[:k] for g, x in want.items()}
    assert ranking.top_k(spark.createDataFrame([], "g string, item string, v long"), ["g"], "v", "item", k).columns == ["g", "item", "v", "rank"]


def plain(docs, least):
    kept, here, rows = defaultdict(Counter), defaultdict(Counter), []
    spread = defaultdict(Counter)
    for lang, source, text in docs:
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        kept[lang].update(terms)
        here[lang, source].update(terms)
        spread[lang].update(set(terms))
    far = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in here:
        own = [t for t in kept[lang] if spread[lang][t] >= least]
        share = lambda c, own=own: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in own) + 2 * len(own)) for t in own}
        p, q = share(here[lang, source]), share(kept[lang])
        pairs = [(s, sum(far(p[t], r[t]) for t in own)) for (g, s), c in here.items() if g == lang and s != source for r in [share(c)]]
        terms = [(t, far(p[t], q[t])) for t in own if here[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
            rows += [(lang, source, part, i, v, k) for k, (i, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, monkeypatch, small):
    """Nulls, empty texts, sources without terms and alone, over several blocks and slices and without broadcasts."""
    if small:
        for name, value in (("SOURCES_A_BLOCK", 2), ("TERMS_A_SLICE", 5), ("BROADCAST_GROUPS", 0), ("PIECE_BYTES", 64)):
            monkeypatch.setattr(divergence, name, value)
        monkeypatch.setattr(ranking, "BROADCAST_GROUPS", 0)
    rng = random.Random(1)
    words = ["the", "Éa", "été", "x", "Kilo", "word", "mañana", "ÅNGSTRÖM", "日本", "end", "ab", "AB"]
    docs = [(lang, f"s{rng.randrange(5) ** 2 % 5}", rng.choice([" ", "-1 ", "\n"]).join(rng.choices(words, k=rng.randrange(40)))) for lang in ("a", "b", None) for _ in range(40)]
    docs += [("a", None, None), ("a", "none", ""), ("alone", "s", "the the"), ("rare", "s", "x"), ("rare", "t", "y"), *[("b", "s0", "the " * 50)] * 2]
    schema = "lang string, source string, text string, term string, n long, p long"
    table = spark.createDataFrame([(*d, "t", 1, 2) for d in docs], schema)
    got = [tuple(r) for r in divergence.audit(table, least_docs=3).collect()]
    want = plain([tuple(x or "" for x in d) for d in docs], 3)
    assert sorted(got) == sorted(want) and len(got) > 50
    empty = divergence.audit(table.limit(0))
    assert empty.count() == 0 and [f.dataType.simpleString() for f in empty.schema] == ["string"] * 4 + ["bigint", "int"]


def test_long_texts_count_once():
    """A text in pieces gives the counts of the whole; terms are never cut, however long."""
    body = ("the End été " * 50 + "z" * 200_000 + "9 the ").encode()
    raw = np.frombuffer(body, np.uint8)
    n, docs = Counter(), Counter()
    for terms, times, new in divergence._long(raw, 100):
        for t, c, d in zip(terms.to_pylist(), times.tolist(), new.tolist(), strict=True):
            n[t] += c
            docs[t] += d
    assert n == {"the": 51, "end": 50, "été": 50, "z" * 200_000: 1} and set(docs.values()) == {1}
