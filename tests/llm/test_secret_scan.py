"""Secrets: base spans against the plain patterns, ownership against plain counting, planted copies and credentials."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from aerolith.llm import secret_scan
from aerolith.llm.secret_scan import KINDS

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def runs(text, spans):
    """Candidates by splitting the text into runs."""
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        if 16 <= len(m[0]) <= 512 and any(c.isdigit() for c in m[0]) and not any(i < m.end() and m.start() < j for i, _, j, _ in spans):
            yield m.start(), m.end(), m[0]


def plain(docs):
    """docs: (doc_id, text, repo, owner); rows as scan gives them."""
    owners, repos, kind = defaultdict(set), defaultdict(set), {}
    for _, text, repo, owner in docs:
        spans = base(text or "")
        for _, k, _, v in spans:
            kind[v] = min(k, kind.get(v, 9))
        for v in [s[3] for s in spans] + [r[2] for r in runs(text or "", spans)]:
            owners[v].add(owner)
            repos[v].add((owner, repo))
    copied = lambda v: len(owners[v]) >= 3 or len(repos[v]) >= 20
    for d, text, _, _ in docs:
        spans = base(text or "")
        added = [(i, kind.get(v, secret_scan.looks(v)), j) for i, j, v in runs(text or "", spans) if not copied(v) and (v in kind or secret_scan.alive(v))]
        shown = lambda x: ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in sorted(x))
        own = [s[:3] for s in spans]
        n = sum(copied(s[3]) for s in spans)
        yield d, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(shown(own).encode()).hexdigest(), shown(own + added), n, len(spans) - n, len(added)


def test_op13(spark):
    import __spark_entry__

    rows = duckdb.sql(f"SELECT doc_id, text, coalesce(source || '/', '') || (doc_id // 1000), source FROM '{SF}/documents.parquet'").fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["op13_secrets"](spark, SF).collect()]
    assert sorted(got) == sorted(plain(rows)) and sum(r[1] for r in got) > 0


LIVE, OTHER, EXAMPLE, WIDE = "Zk4Qw81LmX0pT7vRb2Yc95", "q7GfD3s0PzX9wLm2Kc5uVt", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "0f1e2d3c4b5a69788796a5b4c3d2e1f0"


@pytest.mark.parametrize("hot", [1, 100_000])
def test_owners_tell_examples_from_secrets(spark, hot):
    """A value of one owner is found where it stands bare, a widely copied one is not; examples, paths and numbers are left alone; odd rows have defined results."""
    docs = [(1, f"password = '{LIVE}'", "a/1", "a"), (2, f"curl -u {LIVE} host", "a/2", "a"), (3, f"bare {OTHER}.", "b/1", "b"), (3, f"bare {OTHER}.", "b/1", "b"), (4, f"{EXAMPLE} 2024-01-02T03:04:05 usr/lib/python3/site-packages/a1b2", "b/1", "b")]
    docs += [(10 + k, f"hash {WIDE} or {WIDE.upper()}x9", f"o{k}/1", f"o{k}") for k in range(5)] + [(20 + k, f"é token:{WIDE[:20]}Zz {WIDE[:20]}Zz", f"c/{k}", "c") for k in range(20)]
    docs += [(None, None, None, None), (40, "", "d", "d"), (None, f"api_key: {LIVE[::-1]} {LIVE[::-1]}", None, None), (41, "ſecret=abcdefgh toKen=abcdefgh PASSWD\"  :  'x.y=z+9", "e", "e"), (42, "secret=short AKIA" + "A" * 16 + " AKIAB", "e", "e")]
    table = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id int, text string, repo string, owner string, spans string, n_hex int")
    got = [tuple(r) for r in secret_scan.scan(table, "repo", "owner", hot=hot).collect()]
    assert sorted(got, key=repr) == sorted(plain(docs), key=repr)
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[2][5] == f"assign:8:{8 + len(LIVE)}" and by[3][5] == f"assign:5:{5 + len(OTHER)}" and by[4][5] == ""
    assert by[10][6:] == (1, 0, 0) and by[20][6:] == (1, 0, 0) and by[41][1] == 2 and by[42][1:4] == (0, 1, 0)
    assert secret_scan.scan(table.limit(0), "repo", "owner").count() == 0


def test_base_spans_of_made_texts():
    rng = random.Random(0)
    bits = ["password", "Token", "api_key", "apikey", "secret", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "-", "x.y", "é", "K", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(20)))
        assert secret_scan.base_spans(text) == base(text)
        assert [c for c in secret_scan.candidates(text, base(text))] == list(runs(text, base(text)))


@pytest.mark.parametrize("body", ["a" * 3_000_000, "secret " * 400_000, "0" * 3_000_000, "a1" * 1_000_000, "AKIA" * 500_000, "token" + " " * 2_000_000, "f" * 23 + " "])
def test_very_long_texts(body):
    spans = secret_scan.base_spans(body)
    assert len(spans) <= 1 and len(secret_scan.candidates(body, spans)) <= 1
