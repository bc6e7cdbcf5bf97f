"""Secrets by patterns, and by how many owners have them across the corpus.

Patterns give the base spans, which always stay. Candidates for more are wider: runs
of MIN_CHARS to MAX_CHARS characters of credentials. A candidate's value is hashed,
as are the values of base spans, and hashes are counted over the whole corpus by
distinct repositories and owners:

    copied   at least COPIED_OWNERS owners, or MANY_REPOS repositories, have the
             value: an example, a test vector, a vendored file
    specific fewer have it

A candidate becomes a span if its value is specific and either is a value of a base
span somewhere (another mention of it, without the word that gives it away), or looks
alive by itself: mixed characters, no word of an example in it, no more repeats than
chance gives. Added spans have the kind of the base span that has the value, or else
that of their looks. Widely copied values add nothing; how many base spans have one
is told in n_copied, the others' number in n_specific.

Texts are read once. What is shuffled are hashes with repository and owner, each once
for a partition, so a value may be in any share of the documents. What is known of
a value goes back to its mentions by a join; values of HOT mentions or more (few, as they
are so frequent) are broadcast, the others shuffled.

Defined cases: null text counts as empty and has no spans; a text of any length is
read whole; a null repository or owner is one like others; candidates that touch a
base span are not added; equal spans of two kinds are two spans; repeated rows get
the same spans each and count once for their repository; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.plans.staging import bounded_batches, stage_table
from aerolith.plans.workers import tidy

KINDS = ("assign", "access", "hex")
MIN_CHARS, MAX_CHARS, MIN_BITS = 16, 512, 3.0
COPIED_OWNERS, MANY_REPOS = 3, 20
#: Mentions of a value from which on it is joined by broadcast, and how many such values there may be.
HOT, HOT_VALUES = 100_000, 100_000

#: The base patterns. Runs that are too short are left out by the pattern where that finds the same.
_PATTERNS = (
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]{24,}"),
)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What examples have in them.
_EXAMPLES = ("example", "sample", "dummy", "test", "changeme", "your", "placeholder", "xxxx", "1234567", "abcdef", "deadbeef", "todo", "redacted", "fake")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{%d,%d}(?![A-Za-z0-9+/_=-])" % (MIN_CHARS, MAX_CHARS))
_JOINTS = re.compile("[-+/_=]")
_HEX, _UPPER = re.compile(r"[0-9A-Fa-f]+"), re.compile(r"[A-Z0-9]+")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of what the patterns find, by start, then kind."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):  # lower() never takes one of these words away
        out += [(m.start(), 0, m.end(), m[2]) for m in _PATTERNS[0].finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _PATTERNS[1].finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in _PATTERNS[2].finditer(text)]
    return sorted(out)


@lru_cache(maxsize=1 << 12)
def alive(value: str) -> bool:
    """Whether a value looks like a credential in use by itself."""
    low = value.lower()
    if any(w in low for w in _EXAMPLES):
        return False
    part = max(_JOINTS.split(value), key=len)  # paths and names are made of short parts
    digits = sum(c.isdigit() for c in part)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(part, part[1:], strict=False))
    if len(value) < 20 or len(part) < 12 or digits < 3 or len(part) - digits < 3 or turns < 4:
        return False
    bits = -sum(n / len(value) * log2(n / len(value)) for n in Counter(value).values())
    return bits >= MIN_BITS


def looks(value: str) -> int:
    """The kind that a value without a base span is of."""
    return 2 if _HEX.fullmatch(value) else 1 if _UPPER.fullmatch(value) else 0


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of runs that no base span touches."""
    out, ends, upto = [], [], 0
    for _, _, j, _ in base:
        upto = max(upto, j)
        ends.append(upto)
    starts = [s[0] for s in base]
    for m in _CANDIDATE.finditer(text):
        k = bisect_right(starts, m.end() - 1)  # base spans from k on begin behind the run
        if not k or ends[k - 1] <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


def _mark(value: str) -> bytes:
    return hashlib.sha256(value.encode()).digest()[:16]


def shown(spans: list[Span]) -> str:
    """spans: (start, kind number, end)."""
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in sorted(set(spans)))


_FOUND = "found array<struct<value binary, kind int, base boolean, alive boolean, start int, end int>>"
_SCHEMA = f"doc_id long, repo string, owner string, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, mark binary, {_FOUND}"
_FOUND_TYPE = pa.list_(pa.struct([("value", pa.binary()), ("kind", pa.int32()), ("base", pa.bool_()), ("alive", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and candidates of each text; mark tells texts of a document's number apart."""
    for b in batches:
        counts, sha, marks, found = [[] for _ in KINDS], [], [], []
        for text in b.column(1).to_pylist():
            base = base_spans(text or "")
            for k, c in enumerate(counts):
                c.append(sum(s[1] == k for s in base))
            sha.append(hashlib.sha256(shown([s[:3] for s in base]).encode()).hexdigest())
            own = [{"value": _mark(v), "kind": k, "base": True, "alive": False, "start": i, "end": j} for i, k, j, v in base]
            own += [{"value": _mark(v), "kind": looks(v), "base": False, "alive": alive(v), "start": i, "end": j} for i, j, v in candidates(text or "", base)]
            found.append(own)
            marks.append(_mark(text) if own else b"")
        columns = [b.column(0), b.column(2), b.column(3), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(marks, pa.binary()), pa.array(found, _FOUND_TYPE)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "repo", "owner", *(f"n_{k}" for k in KINDS), "base_sha256", "mark", "found"])


def value_owners(mentions: DataFrame) -> DataFrame:
    """value, owners, repos, mentions, base_kind (of a base span with the value, the first one listed, or null) and copied of every value."""
    own = mentions.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"), F.min(F.when(F.col("base"), F.col("kind"))).alias("k"))
    own = own.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"), F.min("k").alias("k"))
    own = own.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("mentions"), F.min("k").alias("base_kind"))
    return own.withColumn("copied", (F.col("owners") >= COPIED_OWNERS) | (F.col("repos") >= MANY_REPOS))


def _with_values(rows: DataFrame, values: DataFrame, hot: int) -> DataFrame:
    """Rows with what is known of their value; a value of very many rows does not go to one task."""
    total = values.agg(F.sum("mentions")).first()[0] or 0
    often = F.col("mentions") >= max(hot, total // HOT_VALUES)  # so at most HOT_VALUES values are broadcast
    frequent = F.broadcast(values.where(often))
    return rows.join(frequent, "value").unionByName(rows.join(frequent, "value", "left_anti").join(values.where(~often), "value"))


def scan(docs: DataFrame, repo_col: str, owner_col: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans (kind:start:end in code points), and the numbers of base spans that are n_copied and n_specific and of spans that are n_added."""
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"))
    found = stage_table(given.mapInArrow(tidy(_scan), _SCHEMA), "secret-candidates")
    mentions = found.select("doc_id", "mark", "owner", "repo", F.explode("found").alias("f")).select("doc_id", "mark", "owner", "repo", "f.*")
    values = stage_table(value_owners(mentions), "secret-values")
    known = _with_values(mentions, values.select("value", "mentions", "base_kind", "copied"), hot)
    span = lambda kind: F.struct("start", kind.alias("kind"), "end")
    more = ~F.col("base") & ~F.col("copied") & (F.col("base_kind").isNotNull() | F.col("alive"))
    own = known.groupBy(F.col("doc_id").alias("id"), F.col("mark").alias("of")).agg(  # sets, as repeated rows have their mentions twice
        F.collect_set(F.when(more, span(F.coalesce("base_kind", "kind")))).alias("added"),
        F.size(F.collect_set(F.when(F.col("base") & F.col("copied"), span(F.col("kind"))))).alias("n_copied"),
        F.size(F.collect_set(F.when(F.col("base") & ~F.col("copied"), span(F.col("kind"))))).alias("n_specific"),
    )
    some = found.where(F.size("found") > 0)
    some = some.join(own, some.doc_id.eqNullSafe(own.id) & (some.mark == own.of))
    base = F.transform(F.filter("found", lambda f: f["base"]), lambda f: F.struct(f["start"], f["kind"], f["end"]))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    spans = F.array_join(F.transform(F.array_sort(F.concat(base, "added")), text), ",")
    first = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256"]
    some = some.select(*first, spans.alias("spans"), *(F.col(c).cast("long").alias(c) for c in ("n_copied", "n_specific")), F.size("added").cast("long").alias("n_added"))
    none = found.where(F.size("found") == 0).select(*first, F.lit("").alias("spans"), *(F.lit(0).cast("long").alias(c) for c in ("n_copied", "n_specific", "n_added")))
    return some.unionByName(none)


def with_owners(documents: DataFrame) -> DataFrame:
    """Documents with an owner, their source, and a repository of that owner: a thousand numbers each."""
    return documents.select("doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string")).alias("repo"))
