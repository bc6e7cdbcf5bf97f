"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import subprocess
import sys
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerolith.llm import chat, components, exact_dedup, langid, lexicon, licenses, mapped, near_dedup, packing, pii, quality_model, rules, text

LONG = " ".join(f"word{k % 977} x{k}" for k in range(60_000))
ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one two three", "fr", "b"), (5, "one two three", "fr", "b"), (5, "one two three", "fr", "b"), (None, "null id", "fr", None), (6, LONG, "en", "b"), (7, LONG + " end", "en", "b"), (8, "日本語 🤦🏼‍♂️ é \x00 nul", None, "c")]
SCHEMA = "doc_id long, text string, lang string, source string, kept string, score string, component_id string, n_words string, dir string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "k", "s", "c", "n", "d") for r in ROWS], SCHEMA).repartition(3, "source").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_rules(docs, none):
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert len(rules.judge(docs).collect()) == len(ROWS)
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[6].n_words == 120_000 and got[6].n_repeat_words == 0
    assert rules.judge(none).count() == 0 and rules.keep_rows(none).columns == none.columns
    kept = rules.keep_rows(docs, rate=0.99).collect()
    assert {r.doc_id for r in kept} == {6, 7} and kept[0].kept == "k" and kept[0].n_words == "n"


@pytest.mark.parametrize("body", ["a b c a b c", "a b a b a b", "x", "a b c", "a a a a a", "q w e r t y q w e z z", "a\x0bb\x0cc d\ra b c"])
def test_repeat_words(spark, body):
    w = body.split()
    at = [i for i in range(len(w) - 2) if sum(w[j : j + 3] == w[i : i + 3] for j in range(len(w) - 2)) > 1]
    want = len({p for i in at for p in (i, i + 1, i + 2)})
    r = rules.with_base(spark.createDataFrame([(body,)], "text string")).first()
    assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(w), want, sum(map(len, w)))


def test_host_verdicts(spark):
    bad = [(k, "w " * 3, "bad") for k in range(30)] + [(100 + k, " ".join(f"t{k}x{j}" for j in range(60)), "bad" if k < 3 else "good") for k in range(40)]
    got = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(bad, "doc_id long, text string, source string")).collect()}
    assert not any(got[100 + k] for k in range(3)) and all(got[100 + k] for k in range(3, 40))


def test_exact_dedup(docs, none):
    got = exact_dedup.dedup_groups(docs).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    for sha, own in by.items():
        texts = [t or "" for d, t, *_ in ROWS if hashlib.sha256((t or "").encode()).hexdigest() == sha]
        assert len(own) == len(texts) == own[0].group_size and sum(r.kept for r in own) == 1
    assert {r.keep_id for r in got if r.doc_id == 4} == {5} and {r.keep_id for r in got if r.doc_id == 1} == {2}
    kept = exact_dedup.dedup_rows(docs).collect()
    assert len(kept) == len(by) and all(r.kept == "k" for r in kept)
    assert exact_dedup.dedup_groups(none).count() == 0 and exact_dedup.dedup_rows(none).count() == 0


def test_grace_recursion(spark, monkeypatch):
    """Tiny buckets: three levels at least, aliases between them, and the same outcome as in one level."""
    monkeypatch.setattr(exact_dedup, "FAN_OUT", 2)
    monkeypatch.setattr(exact_dedup, "AGAIN", 2)
    monkeypatch.setattr(exact_dedup, "CHUNK_ROWS", 7)
    rnd = random.Random(4)
    rows = [(k, f"text {rnd.randrange(60)} " * 20) for k in range(600)] + [(1000 + k, "hot " * 50) for k in range(300)]
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    levels, stage = [], exact_dedup.stage_table

    def staged(df, name):
        levels.append(name)
        return stage(df, name)

    monkeypatch.setattr(exact_dedup, "stage_table", staged)
    monkeypatch.setattr(exact_dedup, "_text_bytes", lambda docs, text: 1)  # one bucket to begin with
    by = {}
    for d, t in rows:
        by.setdefault(t, []).append(d)
    got = exact_dedup.dedup_groups(table, most=3000).collect()
    assert len({x for x in levels if "level" in x}) >= 3
    texts = dict(rows)
    assert len(got) == len(rows) and all(r.keep_id == max(by[texts[r.doc_id]]) and r.group_size == len(by[texts[r.doc_id]]) and r.kept == (r.doc_id == r.keep_id) for r in got)
    assert {r.doc_id for r in exact_dedup.dedup_rows(table, most=3000).collect()} == {max(own) for own in by.values()}


def test_open_addressing_compares_contents():
    t = exact_dedup.OpenAddressing()
    assert [t.find_or_add(7, c) for c in (b"a", b"b", b"a")] == [0, 1, 0]
    for k in range(5000):
        assert t.find_or_add(k % 13, str(k).encode()) == k + 2
    assert t.find_or_add(3, b"3") == 5


def brute(sets):
    label = {d: d for d in sets}
    find = lambda d: d if label[d] == d else find(label[d])
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("block", [512, 8])
def test_near_copies_in_chains_and_hot_groups(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", block)
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(160)]
    rows, sets = [], {}

    def add(words):
        d = len(rows)
        rows.append((d, " ".join(words)))
        sets[d] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()

    for _ in range(120):  # copies with one to four changed words
        w = list(base)
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(10**6)}"
        add(w)
    w = list(base)
    for k in range(12):  # a chain whose ends have nothing in common
        w = w[10:] + [f"c{k}_{j}" for j in range(10)]
        add(w)
    for _ in range(60):
        add([f"z{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 30))])
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=85).collect()}
    want = brute(sets)
    assert {d: r.component_id for d, r in got.items()} == want and {d: r.n_shingles for d, r in got.items()} == {d: len(s) for d, s in sets.items()}


def test_near_dedup_crowd(spark):
    rnd = random.Random(11)
    words = lambda n: [f"u{rnd.randrange(10**9)}" for _ in range(n)]
    base, n = words(220), 4000
    tails = [words(20) for _ in range(n)]
    for a, b in np.random.default_rng(3).permutation(n).reshape(-1, 2)[:200].tolist():  # pairs whose tails begin with the same words
        tails[b][:2] = tails[a][:2]
    whole = lambda t: {tuple(w[i : i + 5]) for w in [base + t] for i in range(len(w) - 4)}
    passage = whole([])
    own, by = [whole(t) - passage for t in tails], {}
    for d, s in enumerate(own):
        for g in s:
            by.setdefault(g, []).append(d)
    alike = lambda shared, x, y: shared / (2 * len(passage) + len(own[x]) + len(own[y]) - shared)
    assert {alike(len(passage), 0, d) for d in range(1, n)} == {216 / 256}  # all others, 0.84
    shared = {(x, y) for ids in by.values() for x in ids for y in ids if x < y}
    linked = {(x, y) for x, y in shared if alike(len(passage) + len(own[x] & own[y]), x, y) >= 0.85}
    assert len(linked) == 200
    want = {d: d for d in range(n)} | {y: x for x, y in linked}
    rows = [(d, " ".join(base + t)) for d, t in enumerate(tails)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=85).collect()
    assert sum(r.component_id != want[r.doc_id] for r in got) == 0 and len(got) == n


def test_near_dedup_edges(docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    ids = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert ids[1] == (0, 1, True) and ids[3] == (0, 3, True) and ids[4] == (1, 4, True) and ids[5] == (1, 4, False) and ids[7][1:] == (6, False)
    assert ids[None] == (1, None, True)
    kept = near_dedup.keep_rows(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 6, 8}
    assert near_dedup.near_duplicates(none).count() == 0


def test_components(spark, monkeypatch):
    monkeypatch.setattr(components, "HELD_NODES", 5)
    chain = [(k + 1, k) if k % 3 else (k, k + 1) for k in range(50)] * 2 + [(100, 101), (200, 200), (None, 7)]
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(chain, "a long, b long").repartition(7)).collect()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert got == {k: 0 for k in range(1, 51)} | {101: 100}


def test_word_hashes_do_not_depend_on_place():
    a, b = "Ab cd  ef\ngh\x0bij", "zz\tab cd ef gh ij"
    raw, at = text.flat(pa.array([a, None, b]))
    s, e, w = text.words(text.lower_ascii(raw), at)
    h = text.spans_hash(text.lower_ascii(raw), s, e)
    assert np.diff(w).tolist() == [5, 0, 6] and (h[:5] == h[6:]).all() and len(set(h.tolist())) == 6
    assert text.windows_hash(h[:5], 5) == text.windows_hash(h[6:], 5)


def test_packing_edges(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, path, per_packer=4).toPandas()
    assert packing.pack(none, path).count() == 0
    assert got[got.doc_id == 1].length.tolist() == [1] and len(got[got.doc_id == 5]) == 2
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_blanks_beyond_the_faster_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "a" + " " * 1_500_000 + "b"
    assert packing.token_ids(text, path).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    b = packing.BestFit(10, 2)
    assert [b.place(6), b.place(7), b.place(3), b.place(4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    b = packing.BestFit(10, 1)
    assert b.place(6) == (0, 0) and b.place(9) == (1, 0)  # bin 1 is fuller and closes
    assert b.place(4) == (0, 6)


def test_pii(docs, none, spark):
    assert pii.find(none).count() == 0 and pii.find(docs).count() == len(ROWS)
    same = spark.createDataFrame([(1, "call +1 (743) 555-3824 or 4465758382889437 4465758382889437, a.b@c.de 10.1.2.3 999.1.1.1", 3)] * 2, "doc_id long, text string, n_chars long")
    r = pii.find(same).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1)
    masked = pii.mask_rows(same).first()
    assert "[EMAIL]" in masked.text and "[PHONE]" in masked.text and masked.n_chars == len(masked.text)


@pytest.mark.parametrize(("body", "n"), [("1" * 200_000, 0), ("0" * 6000 + "1.1.1.1", 1), ("!" * 200_000 + "a1", 0), ("a@b.co " * 20_000, 20_000)])
def test_pii_of_very_long_texts(body, n):
    began, spans = time.time(), pii.base_spans(body)
    model = pii.Potentials.from_counts(Counter({(">skip", 1, 1): 9, (">skip", 0, 0): 9}))
    assert len(spans) == n and pii.added_spans([body], [spans], model) == [[]]
    assert (pii.Field(body, spans, {}).seen > 0).sum() == n
    assert time.time() - began < 20


@pytest.mark.parametrize("hint", ["", "a@b.co "])
def test_pii_of_a_text_of_numbers_is_bounded(hint):
    """8 MB of four-digit numbers, with and without something to pass on: seconds and resident megabytes of a process of its own."""
    code = (
        "import random, resource, sys, time\n"
        "from collections import Counter\n"
        "from aerolith.llm import pii\n"
        "rnd = random.Random(1)\n"
        f"body = {hint!r} + ' '.join(str(rnd.randrange(1000, 10000)) for _ in range(1_600_000))\n"
        "model = pii.Potentials.from_counts(Counter({('>skip', 4, 4): 50, ('>skip', 0, 0): 50, ('>chain', 0, 0): 50, ('>chain', 4, 4): 5, ('>near', 4, 4): 5}))\n"
        "before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()\n"
        "pii.added_spans([body], [pii.base_spans(body)], model)\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, int(time.time() - began))\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    mb, seconds = map(int, done.stdout.split())
    assert mb < 400 and seconds < 120, (mb, seconds)


def test_similar_tokens_are_linked():
    text = "4465758382889437 x 4465758382889431 y 446575838288943 z ab@c.de w AB@d.ef v 4465758382889437 u 1234 1235"
    f = pii.Field(text, [], {})
    assert f.near.tolist() == [-1, 0, -1, -1, 3, -1, -1, -1] and f.same.tolist() == [-1, -1, -1, -1, -1, 0, -1, -1] and f.follows.tolist() == [0] * 7 + [1]
    rnd = np.random.default_rng(2)
    numbers = [str(x) for x in rnd.integers(1_000_000, 1_000_400, 300)]
    f = pii.Field(" ".join(numbers), [], {})
    apart = lambda x, y: sum(a != b for a, b in zip(x, y, strict=True))
    for i, x in enumerate(numbers):
        near = [j for j in range(i) if apart(x, numbers[j]) == 1] if x not in numbers[:i] else []
        assert f.near[i] == max(near, default=-1)


def test_distant_mentions_share_a_label():
    counts = {("n:16:False:False:False:False:False:True", 3): 40, ("n:16:False:False:False:False:False:True", 0): 1, (">skip", 3, 3): 30, (">skip", 0, 0): 5, (">chain", 0, 0): 9}
    number = "4465758382889437"
    body = f"{number} {number} and far away {number}"
    model = pii.Potentials.from_counts(Counter(counts))
    base = pii.base_spans(body)
    assert [s[0] for s in base] == [2]  # the two in a row are no card to the pattern
    assert [body[i:j] for _, i, j in pii.added_spans([body], [base], model)[0]] == [number, number]


def test_chat_folds_events(spark):
    log = [(1, 1, 10, "message", "user", "hi"), (1, 2, 11, "delta", "assistant", "he"), (1, 3, 11, "delta", "assistant", "llo"), (1, 5, 12, "message", "user", "more"), (1, 6, 11, "edit", None, "hey <|im_end|>"), (1, 7, 13, "delta", "assistant", "x"), (1, 8, 13, "regenerate", "assistant", ""), (1, 9, 13, "delta", "assistant", "done"), (2, 1, None, None, None, None)]
    segments = chat.reconstruct(spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string"))
    got = {r.conv_id: list(chat.parse(r.formatted)) for r in chat.formatted(segments).collect()}
    assert [(a, b) for a, b, _ in got[1]] == [("user", "hi"), ("assistant", "hey <|im_end|>"), ("user", "more"), ("assistant", "done")]
    assert got[2] == [("", "", False)]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.reconstruct(chat.events(empty))).count() == 0


def test_chat_turns_through_events(spark):
    """Repeated rows, null conversations, turns, roles and texts, clashing columns; every kind of event occurs and folds into the turn."""
    rnd = random.Random(8)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice([None, "", "a", "hey 🤦 <|im_end|>", "long " * 2000 + str(t)])) for c in (1, 2, 3, 4, None) for t in range(7)]
    rows += rows[3:5] * 2 + [(2, None, "user", "no turn"), (9, 0, "assistant", LONG)]
    table = spark.createDataFrame([(*r, "k", 0) for r in rows], "conv_id long, turn long, role string, text string, kind string, seq long")
    log = chat.events(table)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = {r.conv_id: r for r in chat.digest(chat.reconstruct(log)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.render(x[2] or "", x[3] or "")) for x in own)


@pytest.mark.parametrize("body", ["", "<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|<||", "\\n\n<|", "a" * 100_000])
def test_chat_round_trip(body):
    assert list(chat.parse(chat.render("user", body) + chat.render(body[:20], "x")))[0][1] == body
    assert chat.unescape(chat.escape(body)) == body and "<|" not in chat.escape(body)
    assert list(chat.parse(chat.render(body[:40], "x")))[0][0] == body[:40]


def test_langid_edges(docs, none, spark):
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0 and len(langid.predict(docs, model).collect()) == len(ROWS)
    blank = langid.train(none)
    assert blank[0] == [] and langid.predict(docs, blank).where("lang_pred != 'und'").count() == 0 and langid.predict(none, model).count() == 0
    tied = spark.createDataFrame([(d, "same text", lang) for d in (7, 8, 9, 10) for lang in ("xx", "aa")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.predict(tied, langid.train(tied)).collect()} == {("aa", 0.5)}


def plain_bits(texts, body):
    """A text's code length, byte by byte, from plain counts of contexts."""
    counts = [{} for _ in range(langid.ORDER + 1)]
    for t in texts:
        s = b"\n" * langid.ORDER + t.encode()
        for i in range(langid.ORDER, len(s)):
            for order in range(langid.ORDER + 1):
                own = counts[order].setdefault(s[i - order : i], {})
                own[s[i]] = own.get(s[i], 0) + 1
    bits, s = 0.0, b"\n" * langid.ORDER + body.encode()
    for i in range(langid.ORDER, len(s)):
        p = 1.0
        for order in range(langid.ORDER, -1, -1):
            own = counts[order].get(s[i - order : i])
            if own is None:
                continue
            total, kinds = sum(own.values()), len(own)
            if s[i] in own:
                p *= own[s[i]] / (total + kinds)
                break
            p *= kinds / (total + kinds)
        else:
            p /= 256
        bits -= np.log2(p)
    return bits


def test_code_lengths_are_those_of_the_trees(tmp_path, monkeypatch):
    corpus, bodies = {"a": ["abracadabra", "abc"], "b": ["zzz yyy"]}, ["abraxas z", "", "日本 zzz", "abracadabra" * 50]
    counts = {}
    for k, v in corpus.items():
        raw, at = text.flat(pa.array(v))
        counts[k] = np.unique(langid.strings(raw, at, 0, len(raw)), return_counts=True)
        parts = [langid.strings(raw, at, i, min(i + 3, len(raw))) for i in range(0, len(raw), 3)]  # pieces know what stands before them
        assert (np.concatenate(parts) == langid.strings(raw, at, 0, len(raw))).all()
    (tmp_path / "trees").write_bytes(mapped.pack_arrays(langid.compile_trees(counts)))
    for group, cells in ((1 << 20, 1 << 22), (7, 3)):
        monkeypatch.setattr(langid, "GROUP", group)
        monkeypatch.setattr(langid, "CELLS", cells)
        got = langid.ContextTrees(["a", "b"], mapped.map_arrays(str(tmp_path / "trees"))).lengths(pa.array(bodies))
        assert got == pytest.approx(np.array([[plain_bits(corpus[k], x) for k in "ab"] for x in bodies]), rel=1e-5)


def test_quality_edges(docs, none, spark):
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, None)], "doc_id long, quality int")
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.classify(none, labels).count() == 0
    assert quality_model.classify(docs, labels.limit(0)).first().score == pytest.approx(0.5)


def plain_statistics(body):
    """The features of one text in plain Python."""
    raw = (body or "").encode()
    n, w = len(raw), [x for x in re.split(rb"[ \t-\r]+", raw) if x]
    low, lines = [x.lower() for x in w], [x for x in raw.split(b"\n") if x]
    share = lambda chars: sum(c in chars for c in raw) / max(n, 1)
    again = lambda items: len(items) - len(set(items))
    symbols, per = b"#*$%&<>{}[]\\^~=@", max(len(w), 1)
    out = {
        "log_bytes": np.log1p(n), "log_words": np.log1p(len(w)), "word_bytes": sum(map(len, w)) / per, "long_words": sum(len(x) > 12 for x in w) / per,
        "distinct_words": 1 - again(low) / per, "repeated_words": again([tuple(low[i : i + 3]) for i in range(len(low) - 2)]) / per,
        "upper": share(bytes(range(65, 91))), "lower": share(bytes(range(97, 123))), "digit": share(b"0123456789"), "newline": share(b"\n"), "stop": share(b"."),
        "comma": share(b","), "bang": share(b"!?"), "symbol": share(symbols), "pipe": share(b"|"), "not_ascii": share(bytes(range(128, 256))),
        "line_words": len(w) / max(len(lines), 1), "repeated_lines": again(lines) / max(len(lines), 1), "symbol_words": sum(any(c in symbols for c in x) for x in w) / per,
        "upper_words": sum(sum(65 <= c <= 90 for c in x) >= 2 for x in w) / per,
    }
    return [out[f] for f in quality_model.FEATURES]


def test_statistics_against_plain_python():
    rnd = random.Random(12)
    bodies = ["", None, "\n\n", "one", "a b\x0bc\td  A b C", "Same line\nSame line\n\nsame LINE", "é ü 日本 | # $x", "x" * 5000]
    bodies += ["".join(rnd.choice("aB3 .\n,!?#|é") for _ in range(rnd.randrange(400))) for _ in range(40)]
    raw, at = text.flat(pa.array(bodies))
    assert quality_model.statistics(raw, at) == pytest.approx(np.array([plain_statistics(b) for b in bodies]), rel=1e-5, abs=1e-6)


def test_trees_learn_a_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    t = quality_model.fit(x[:2000], y[:2000])
    assert ((t.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    for k in range(20):  # the flat walk against a plain one
        margin = t.base
        for f, thr, v in zip(t.feature, t.threshold, t.value, strict=True):
            node = 0
            while 2 * node + 1 < len(v):
                node = 2 * node + 1 + (x[k, f[node]] > thr[node])
            margin += v[node]
        assert t.score(x[k : k + 1])[0] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_lexicon_is_minimal_and_exact(tmp_path):
    m = lexicon.Merges(public_tokenizers.path("word_bpe_49k.json"))
    words = ["tap", "taps", "top", "tops", "stop", "stops", "é", "naïve"]
    arrays = lexicon.compile_lexicon(words, m)
    assert arrays["step"].shape[0] - 1 < sum(len(w.encode()) for w in words)  # suffixes are shared
    (tmp_path / "lex").write_bytes(mapped.pack_arrays(arrays))
    e = lexicon.Encoder(m, mapped.map_arrays(str(tmp_path / "lex")))
    ordered = sorted(words, key=str.encode)
    assert e.ranks([*ordered, "to", "tapsx", "x" * 40, "a\0"]).tolist() == [*range(len(words)), -1, -1, -1, -1]
    with_, without = list(e.encode(["Taps stop", "to\x00 STOPS"])), list(lexicon.Encoder(m, lexicon.compile_lexicon([], m)).encode(["Taps stop", "to\x00 STOPS"]))
    assert with_ == without


@pytest.mark.parametrize("word", ["ab" * 400, "a" * 777, "unhappinessé" * 60])
def test_long_words_merge_as_the_library_does(word):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert lexicon.Merges(path).merge(word.encode()) == Tokenizer.from_file(path).encode(word, add_special_tokens=False).ids


def test_lexicon_edges(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert lexicon.digests(none, path).count() == 0
    got = {r.doc_id: r for r in lexicon.encode(docs, path).collect()}
    assert got[1].ids == [] and got[2].decoded == "" and len(got[4].ids) == 3


def test_licences(spark, none):
    mit = (licenses.Path(licenses.__file__).parent / "licence_texts" / "MIT.txt").read_text()
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/x.py", "code"), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0"), (4, "a/y.py", None), (5, "z/q.py", ""), (6, None, "x"), (7, "top", "y"), (8, "a/b/own.py", "Licensed under CC BY-NC 4.0.\n" + "body text " * 300), (8, "a/b/own.py", "n"), (9, "z/COPYING", "ours.\n" + "words of our own " * 50 + "Released under the MIT License.")]
    table = spark.createDataFrame([(*r, "k", "s") for r in rows], "doc_id long, path string, text string, own_license string, dir string")
    got = licenses.scan(table).collect()
    by = {(r.doc_id, r.own_license): (r.license, r.license_dir) for r in got}
    assert len(got) == len(rows)
    assert by[2, None] == ("Apache-2.0", "a/b") and by[4, None] == ("MIT", "a") and by[5, None] == ("MIT", "z") and by[6, None] == (None, None)
    assert by[8, "CC-BY-NC-4.0"] == ("CC-BY-NC-4.0", None) and by[8, None] == ("Apache-2.0", "a/b") and by[3, "Apache-2.0"] == ("Apache-2.0", None)
    assert licenses.scan(none.select("doc_id", F.lit("a/b").alias("path"), "text")).count() == 0
    long = spark.createDataFrame([(1, "a/b", LONG + " Released under the MIT License " + LONG)], "doc_id long, path string, text string")
    assert licenses.scan(long).first().own_license == "MIT"


def small_weights():
    given = licenses.templates()
    vocabulary = np.unique(np.concatenate([t.terms for t in given]))
    common = licenses._slots(licenses._hashes("the of to a is in under and this for has been all as"), vocabulary)
    slots, counts = np.append(common, -1), np.append(np.full(len(common), 9000), 10_000)
    return given, licenses.Weights(given, vocabulary, slots, counts)


def test_terms_of_bytes_are_those_of_the_pattern():
    for body in ("Licensed under the Apache License, Version 2.0.", "..a-+b.+-- C++ --- +x. 3.0-or-later é1.5é -", "", "---", "a"):
        raw = text.lower_ascii(np.frombuffer(body.encode(), np.uint8))
        starts, stops = licenses.term_spans(raw, np.array([0, len(raw)]))
        assert [raw[i:j].tobytes().decode() for i, j in zip(starts, stops, strict=True)] == licenses.terms(body)


def test_licence_matches_are_those_of_all_windows():
    """Every place of every notice by dense vectors; bounds leave nothing out."""
    given, w = small_weights()
    rnd = random.Random(3)
    notices = [n for own in licenses.NOTICES.values() for n in own]
    words = [x for n in notices for x in n.split()] + ["alpha", "beta", "gamma", "the", "of"] * 9
    for k in range(60):
        body = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 30)))
        if k % 2:
            own = rnd.choice(notices).split()
            own[rnd.randrange(len(own))] = rnd.choice(words)
            body += " " + " ".join(own) + " tail"
        h = licenses._hashes(body)
        every = {x: i for i, x in enumerate(np.unique(np.concatenate([h, *(t.terms for t in given)])).tolist())}
        weight = w.idf[licenses._slots(np.array(list(every), np.uint64), w.vocabulary)].astype(float)

        def vector(terms, every=every, weight=weight):
            v = np.zeros(len(every))
            for x, c in Counter(terms.tolist()).items():
                v[every[x]] = (1 + np.log(c)) * weight[every[x]]
            return v / np.linalg.norm(v)

        best = 0.0
        for t in given:
            size = len(h) if t.whole else min(len(t.terms), len(h))
            for i in range(len(h) - size + 1):
                some = set(t.terms.tolist()) & set(h[i : i + size].tolist())
                if len(set(t.terms.tolist())) >= licenses.WHOLE or len(some) == len(set(t.terms.tolist())):
                    best = max(best, vector(h[i : i + size]) @ vector(t.terms))
        got = w.best(h)
        assert got[1] == pytest.approx(best if best >= licenses.COSINE else 0.0, abs=1e-5)


def test_whole_licences_and_wrapped_headers():
    _, w = small_weights()
    folder = licenses.Path(licenses.__file__).parent / "licence_texts"
    for f in folder.glob("*.txt"):
        body = f.read_text()
        for own in (body, "Copyright (c) 2020 Someone Else\n\n" + body, "\n".join("// " + x for x in body.split("\n"))):
            k, cosine, covered = w.best(licenses._hashes(own))
            assert w.names[k] == f.stem and w.whole[k] and cosine > 0.9 and covered == len(licenses._hashes(own))
    code = "int main() { return 0; }\n" * 200
    wrapped = (
        "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
        " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\n"
    )
    apache = '# Copyright 2021 The Authors. Licensed under the Apache License,\n# Version 2.0 (the "License"); you may not use this file except\n# in compliance with the License.\n'
    mpl = "; This Source Code Form is subject to the terms of the\n; Mozilla Public License, v. 2.0. If a copy\n"
    for body, want in ((wrapped, "GPL-3.0"), (apache, "Apache-2.0"), (mpl, "MPL-2.0"), ("// SPDX-License-Identifier: MIT\n", "MIT"), ("# SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0"), ("Released under the MIT License, as is. It has been all.", "MIT"), ("All of it has been licensed under the Apache License, Version 2.0.", "Apache-2.0")):
        k, cosine, _ = w.best(licenses._hashes(body + code))
        assert k >= 0 and w.names[k] == want and cosine >= 0.8, body
    for body in ("Die Katze lief mit dem Hund.", "the permission to read is granted to all", "a license to kill"):
        assert w.best(licenses._hashes(body))[0] == -1


def test_everything_but_llm_imports_without_it():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('aerolith.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(k.startswith('op') for k in e.queries())\n"
    )
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True).returncode == 0


def test_memory_of_a_long_text_is_bounded(tmp_path):
    """A text of 24 MB takes less than 150 MB beyond the start of a process, its own bytes twice included."""
    code = """
import resource, numpy as np, pyarrow as pa
from aerolith.llm import langid, text
raw, at = text.flat(pa.array(["some words to count, others too"]))
trees = langid.ContextTrees(["a"], langid.compile_trees({"a": np.unique(langid.strings(raw, at, 0, len(raw)), return_counts=True)}))
trees.lengths(pa.array(["warm " * 1000]))
body = pa.array([("1 " * 3_000_000) + ("word and others " * 1_125_000)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert langid._has_letter(body).all()
bits = trees.lengths(body)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before, bits[0, 0])
"""
    used = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=".", check=True).stdout.split()
    assert int(used[0]) < 150_000 and float(used[1]) > 1e6


@pytest.mark.parametrize("kind", ["int", "short", "string"])
def test_ids_of_any_integer_type(spark, kind):
    """Ids of shorter types come back as longs with the same rows; other types are refused with a clear error."""
    rows = [(k, " ".join(f"w{(k // 2) * 7 + i}" for i in range(60)) + " a@b.org", ["en", "fr"][k % 2], "s") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id int, quality int")
    byte, word = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    paths = lambda d: d.withColumn("path", F.concat(F.lit("a/"), F.col("doc_id").cast("string")))
    operators = {
        "near": near_dedup.near_duplicates, "pii": pii.find, "quality": lambda d: quality_model.classify(d, labels), "bpe": lambda d: lexicon.digests(d, word), "licences": lambda d: licenses.scan(paths(d)),
        "langid": lambda d: langid.predict(d, langid.train(d)), "packing": lambda d: packing.pack(d, byte).drop("sequence_id", "offset"),
    }
    for name, run in operators.items():
        own = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
        if kind == "string":
            with pytest.raises(TypeError, match="integers"):
                run(own)
        else:
            got = run(own)
            assert dict(got.dtypes)["doc_id"] == "bigint" and sorted(map(repr, got.collect())) == sorted(map(repr, run(docs).collect())), name


def test_links_are_staged_between_two_python_steps(spark):
    """Two Python steps in one stage take two workers for each core, and all of them stay in memory."""
    from aerolith.llm import near_dedup
    from aerolith.plans.staging import recorded

    t = spark.createDataFrame([(k, "a b c d e f g h i j " * 3 + ("x" if k else "")) for k in range(3)], "doc_id long, text string")
    with recorded() as made:
        assert near_dedup.near_duplicates(t).count() == 3
    assert any("near-links" in m.staged_path for m in made)
