"""Queries against SQL, and against plain Python where SQL has no words for them, at the smallest scale."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def run(spark):
    done = {}

    def query(name):
        if name not in done:
            done[name] = __spark_entry__.queries()[name](spark, SF).toPandas()
        return done[name]

    return query


@pytest.mark.parametrize("name", ["op4_rules", "op7_chat", "op8_exact_dedup", "op11_divergence", "op12_clustering"])
def test_sql(spark, name):
    assert_same(__spark_entry__.queries()[name](spark, SF), __spark_entry__.oracle_sql()[name], SF)


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(sets, percent=85):
    """Smallest linked id of each document by comparing all pairs that share a shingle."""
    by = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by[g].append(d)
    shared = Counter((a, b) for own in by.values() for i, b in enumerate(sorted(own)) for a in sorted(own)[:i])
    label = {d: d for d in sets}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return {d: find(d) for d in sets}


def test_op3(run):
    sets = {d: shingles(t) for d, t, _ in documents()}
    want, got = components(sets), run("op3_near_dedup")
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == want
    assert dict(zip(got.doc_id, got.n_shingles, strict=True)) == {d: len(s) for d, s in sets.items()}
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_op5(run):
    import public_tokenizers
    from tokenizers import Tokenizer

    own, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), run("op5_packing")
    pieces = defaultdict(dict)
    for r in got.itertuples():
        pieces[r.doc_id][r.piece] = r
    for d, text, _ in documents():
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k in range(len(pieces[d])):
            p = pieces[d][k]
            assert p.start == at and (p.length == 2048 or k == 0)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids) and (len(ids) > 2048) == (len(pieces[d]) > 1)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 2048 + 1


def test_op6(run):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, text):
        digits = [int(c) for c in text if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in text.split("."))
        if kind == "card":
            total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    got = run("op6_pii").set_index("doc_id")
    for d, text, _ in documents():
        spans = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text or "") if good(k, m[0])]
        r = got.loc[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in patterns]
        shown = [f"{k}:{i}:{j}" for k, i, j in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(r.spans.split(",")) | {""} and len(text or "") < 10**7


def test_op2_and_op9_hold_out(run):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    q = run("op2_quality")
    assert (q.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in q.doc_id]).all()
    assert q.score.between(0, 1).all() and (q.predicted == (q.score >= 0.3)).all()
    held = q[q.held_out & q.doc_id.isin(labels)]
    assert np.mean([labels[d] == p for d, p in zip(held.doc_id, held.predicted, strict=True)]) >= 0.85
    lang = {d: (t, g) for d, t, g in documents()}
    g = run("op9_langid")
    assert (g.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in g.doc_id]).all() and g.score.between(0, 1).all()
    for r in g.itertuples():
        text = lang[r.doc_id][0]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    held = g[g.held_out & (g.lang_pred != "und")]
    assert np.mean([lang[d][1] == p for d, p in zip(held.doc_id, held.lang_pred, strict=True)]) >= 0.97


def test_op9_scores(spark, run):
    """The query's own predictions against code lengths from plain counts of all that trains."""
    from tests.llm.test_edges import plain_bits

    train = defaultdict(list)
    for d, text, lang in documents():
        if zlib.crc32(str(d).encode()) % 4 != 2 and lang is not None and text is not None:
            train[lang].append(text)
    got = run("op9_langid").set_index("doc_id")
    for d, text, _ in documents()[:200:40]:
        if got.loc[d].lang_pred != "und":
            bits = {k: plain_bits(train[k], text[:4000]) for k in sorted(train)}
            if len(text) <= 4000:
                least = min(bits.values())
                assert bits[got.loc[d].lang_pred] == pytest.approx(least, rel=1e-6)
                assert got.loc[d].score == pytest.approx(1 / sum(2 ** max(least - b, -1000) for b in bits.values()), rel=1e-3)


def test_op10(run):
    import public_tokenizers
    from tokenizers import Tokenizer

    own, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), run("op10_bpe").set_index("doc_id")
    for d, text, _ in documents():
        ids = own.encode(text or "", add_special_tokens=False).ids
        r = got.loc[d]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op1(run):
    got = run("op1_licenses").set_index("doc_id")
    for d, text, _ in documents():
        named = re.search(r"(Apache License, Version 2.0|MIT License|GNU General Public License, version 3|CC BY-NC 4.0)", text or "")
        want = {"Apa": "Apache-2.0", "MIT": "MIT", "GNU": "GPL-3.0", "CC ": "CC-BY-NC-4.0"}[named[0][:3]] if named else None
        assert got.loc[d].own_license == want, text[-200:]


def test_op1_inheritance(spark, run):
    """Licence files by plain counting of terms, inheritance by walking up from each path."""
    from aerolith.llm import licenses

    table = spark.read.parquet(f"{SF}/documents.parquet")
    paths = {r.doc_id: (r.path, r.text) for r in licenses.corpus_paths(table).collect()}
    got, given = run("op1_licenses").set_index("doc_id"), {}
    for d in sorted(paths, key=lambda d: paths[d][0], reverse=True):  # the least path comes last and stays, unless another matches better
        r, terms = got.loc[d], licenses.terms(paths[d][1] or "")
        notices = [len(licenses.terms(n)) for n in licenses.NOTICES.get(r.own_license, ())]
        if r.own_license and max(notices) >= 0.5 * len(terms):
            where = paths[d][0].rpartition("/")[0]
            if where not in given or r.own_score >= given[where][1]:
                given[where] = (r.own_license, r.own_score)
    for d, (path, _) in paths.items():
        where, want = path.rpartition("/")[0], (None, None)
        while where and not got.loc[d].own_license:
            if where in given:
                want = (given[where][0], where)
                break
            where = where.rpartition("/")[0]
        assert (got.loc[d].license, got.loc[d].license_dir) == ((got.loc[d].own_license, None) if got.loc[d].own_license else want)


def test_pipeline(spark):
    import corpus_pipeline

    docs = {d: t for d, t, _ in documents()}
    rules = __spark_entry__.queries()["op4_rules"](spark, SF).toPandas()
    passed = {d: docs[d] for d in rules[rules.kept].doc_id}
    last = {}
    for d, t in passed.items():
        last[t or ""] = max(d, last.get(t or "", -1))
    sets = {d: shingles(docs[d]) for d in last.values()}
    kept = {d for d, c in components(sets, 80).items() if d == c}
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == kept and len(corpus_pipeline.STAGES) == 5
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty and repeated texts, ties, further and clashing columns through every stage; then an empty table."""
    import corpus_pipeline

    words = [f"w{k}" for k in range(400)]
    long = [" ".join(words[k : k + 120]) for k in (0, 130, 260)]
    rows = [(1, None), (2, ""), (3, long[0]), (4, long[0]), (4, long[0]), (5, long[1]), (6, long[1] + " end"), (None, long[2] + " mail a@b.org"), (7, "too short"), (8, " ".join(f"v{k}" for k in range(12_000)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, id long, component_id long, base_failed string, n_words string, sequence_id string, keep_id string, __text string"
    docs = spark.createDataFrame([(d, t, None, None if d == 8 else "s", len(t or ""), "k", 0, 1, "b", "w", "s", "i", "t") for d, t in rows], schema)
    want = [{3, 4, 5, 6, None, 8}, {4, 5, 6, None, 8}, {4, 5, None, 8}, {4, 5, None, 8}]
    for table, own in ((docs, want), (docs.limit(0), [set()] * 4)):
        for (_, stage), ids in zip(corpus_pipeline.STAGES[:4], own, strict=True):
            table = stage(spark, table, SF).cache()
            assert table.columns == docs.columns and {r.doc_id for r in table.collect()} == ids
            assert all((r.kept, r.id, r.component_id, r["__text"]) == ("k", 0, 1, "t") for r in table.collect())
        pieces = corpus_pipeline.STAGES[4][1](spark, table, SF).collect()
        assert {r.doc_id for r in pieces} == ids
        texts = {r.doc_id: r.text for r in table.collect()}
        assert not ids or (texts[None].endswith("[EMAIL]") and texts[8] == rows[-1][1])
