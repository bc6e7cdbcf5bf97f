"""Audit of sources: how far their use of terms is from each other's and from their language's.

Terms are runs of letters (A-Z and a-z, the former lower-cased, and all characters
beyond ASCII). A language keeps the terms of at least LEAST_DOCS of its documents.
With smoothed shares p of a group and q of another in parts of 10**9, a term's
divergence is floor((p - q)**2 / (p + q)); all arithmetic is on integers.

    pair   two sources of a language: the sum over all kept terms
    term   a source and its whole language: the terms that the source has more
           often, the first RANKS by radix select (module ranking)

Most terms are in few sources, so pairs are sparse: a term that neither source
has adds the same baseline each time, which is multiplied out; a term of one
source adds a correction for each different share; only terms of both sources
are met one by one. The corrections are summed within blocks of SOURCES_A_BLOCK
sources and slices of about TERMS_A_SLICE terms, in arrays, so a term that all
sources have makes no rows for its pairs, and a task holds a block's slice
at most. The one join of sources with sources is the result itself.

Texts are counted before anything is shuffled: what is dealt out is a row for
each language, source and term of a partition. A source may hold any share.

Defined cases: null text, language and source read as ''; an empty text has no
terms, but its source is a group; a text of any length is read whole, a long one
in pieces between terms; a language without kept terms has pairs of value 0 and no
terms; a source alone in its language has no pairs; equal values rank by the item's
UTF-8 bytes; repeated rows are documents of their own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.ranking import top_k
from aerolith.llm.text import flat, runs
from aerolith.plans.staging import bounded_batches, stage_table
from aerolith.plans.workers import tidy

LEAST_DOCS, RANKS = 10, 10
#: Bytes of text that are counted at once.
PIECE_BYTES = 4 << 20
SOURCES_A_BLOCK, TERMS_A_SLICE = 128, 512
#: Groups up to this number are broadcast to their terms; more are joined by a shuffle.
BROADCAST_GROUPS = 50_000
#: How often the sources of a language are dealt out to meet each other, where they are too many to broadcast.
DEALS = 16

_TERM = np.zeros(256, dtype=bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(raw: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of texts in order, and the number of the text that each is from."""
    inside = _TERM[raw]
    starts, stops = runs(inside, at)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    body = _LOWER[raw[inside]]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(body))
    return words.dictionary_encode(), np.searchsorted(at, starts, "right") - 1


def _cut(raw: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A text's bytes in pieces of about ``most`` that end between terms."""
    i = 0
    while i < len(raw):
        j = min(len(raw), i + most)
        while j < len(raw) and _TERM[raw[j]]:
            gap = np.flatnonzero(~_TERM[raw[j : j + 65536]])
            j = j + int(gap[0]) if len(gap) else min(len(raw), j + 65536)
        yield raw[i:j]
        i = j


def _counted(groups: np.ndarray, raw: np.ndarray, at: np.ndarray, first: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents of texts, one row for each group and term."""
    words, doc = terms_of(raw, at)
    n = max(1, len(words.dictionary))
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, times = np.unique(doc * n + code, return_counts=True)
    keys, back = np.unique(groups[pairs // n] * n + pairs % n, return_inverse=True)
    docs = np.bincount(back, minlength=len(keys)) if first else np.zeros(len(keys), np.int64)
    occurrences = np.zeros(len(keys), np.int64)
    np.add.at(occurrences, back, times)
    return keys // n, words.dictionary.take(pa.array(keys % n)), occurrences, docs


def _long(raw: np.ndarray, most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Terms, occurrences and documents of one long text; a term is of one document, however many pieces have it."""
    seen = np.zeros(0, "S16")
    for piece in _cut(raw, most):
        _, terms, n, _ = _counted(np.zeros(1, np.int64), piece, np.array([0, len(piece)]), first=False)
        marks = np.array([xxhash.xxh3_128_digest(t) for t in terms.cast(pa.large_binary()).to_pylist()], "S16")
        new = ~np.isin(marks, seen)
        seen = np.concatenate([seen, marks[new]])
        yield terms, n, new.astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    for b in batches:
        pairs = pa.StructArray.from_arrays([b.column(0), b.column(1)], ["lang", "source"]).to_pylist()
        number = {p: i for i, p in enumerate(dict.fromkeys((p["lang"], p["source"]) for p in pairs))}
        group = np.array([number[p["lang"], p["source"]] for p in pairs], np.int64)
        langs, sources = (pa.array([p[k] for p in number], pa.string()) for k in (0, 1))
        raw, at = flat(b.column(2))

        def rows(of: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
            of = pa.array(of)
            return pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), terms.cast(pa.string()), pa.array(n), pa.array(docs)], names=names)  # noqa: B023

        i = 0
        while i < len(group):
            j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE_BYTES, "right")) - 1)
            own = raw[at[i] : at[j]]
            if len(own) > PIECE_BYTES:
                for terms, n, docs in _long(own, PIECE_BYTES):
                    yield rows(np.full(len(n), group[i]), terms, n, docs)
            elif len(own):
                yield rows(*_counted(group[i:j], own, at[i : j + 1] - at[i]))
            i = j


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n (occurrences there), lang_n (in the language) and first (true in one row of each language and term)."""
    bounded_batches(docs.sparkSession)
    counts = _plain(docs).mapInArrow(tidy(_count), "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")  # a row for each source at most
    every = counts.withColumns({"lang_n": F.sum("n").over(w), "lang_docs": F.sum("docs").over(w), "first": F.col("source") == F.min("source").over(w)})
    return every.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first")


def share(count: str, total: str, terms: str):
    """1 + floor(10**9 (count + 2) / (total + 2 terms)) of columns, in exact decimals, as a long."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({total} + 2 * {terms} as decimal(20,0))").cast("long")


def distance(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})").cast("long")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _block_sums(table: pa.Table) -> pa.Table:
    """Corrections of all pairs of sources of two blocks (or of one) over a slice of terms: lang, a, b, value.

    Rows without a term have a source's baseline, the share of a term that it has not.
    """
    lang, bi, bj = table["lang"][0].as_py(), table["bi"][0].as_py(), table["bj"][0].as_py()
    bare = pc.is_null(table["term"])
    heads, rest = table.filter(bare), table.filter(pc.invert(bare))
    order = pc.sort_indices(heads, [("block", "ascending"), ("source", "ascending")])
    heads = heads.take(order)
    names, block, base = heads["source"].to_pylist(), heads["block"].to_numpy(), heads["p"].to_numpy()
    place = {s: i for i, s in enumerate(names)}
    source = np.array([place[s] for s in rest["source"].to_pylist()], np.int64)
    term = rest["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    p, n = rest["p"].to_numpy(), 1 + int(term.max(initial=-1))
    own = np.argsort(source, kind="stable")
    source, term, p = source[own], term[own], p[own]
    edge = np.searchsorted(source, np.arange(len(names) + 1))
    sums = np.zeros((len(names), len(names)), np.int64)
    for a in range(len(names)):
        mine, at = p[edge[a] : edge[a + 1]], term[edge[a] : edge[a + 1]]
        shares, times = np.unique(mine, return_counts=True)
        for k in range(0, len(shares), 256):
            u, t = shares[k : k + 256, None], times[k : k + 256, None]
            alone = ((_f(u, base) - _f(base[a], base)) * t).sum(0)
            sums[a] += alone
            sums[:, a] += alone
        here = np.zeros(n, np.int64)
        here[at] = mine
        lo = edge[a + 1]  # sources after a
        both = lo + np.flatnonzero(here[term[lo:]])
        b, mine, other = source[both], here[term[both]], p[both]
        np.add.at(sums[a], b, _f(mine, other) - _f(mine, base[b]) - _f(base[a], other) + _f(base[a], base[b]))
    a, b = np.triu_indices(len(names), 1)
    wanted = (sums[a, b] != 0) & ((block[a] == bi) & (block[b] == bj))
    a, b = a[wanted], b[wanted]
    text = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": text.take(pa.array(a)), "b": text.take(pa.array(b)), "value": pa.array(sums[a, b])})


def _sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n (occurrences of kept terms), terms (kept ones of the language), lang_n, base (the share of a term that is not there), sources (of the language)."""
    groups = _plain(docs).select("lang", "source").distinct()
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    count = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    out = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").join(count, "lang").na.fill(0, ["n", "terms", "lang_n"])
    return out.withColumn("base", F.when(F.col("terms") > 0, share("0", "n", "terms")))


def pair_divergence(shares: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item (another source) and value, for all pairs of sources of a language in both orders.

    shares has lang, source, term and p of terms that a source has; sizes is of _sizes.
    """
    blocks = F.ceil(F.col("sources") / SOURCES_A_BLOCK).cast("int")
    slices = F.ceil(F.col("terms") / TERMS_A_SLICE).cast("int")
    block = F.pmod(F.xxhash64("source"), blocks).cast("int")
    facts = sizes.where("terms > 0").select("lang", "source", "base", blocks.alias("blocks"), slices.alias("slices"), block.alias("block"))
    small = sizes.count() <= BROADCAST_GROUPS
    rows = shares.select("lang", "source", "term", "p").join(F.broadcast(facts) if small else facts, ["lang", "source"])
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
    heads = facts.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), "base", "blocks", "slices", "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    met = rows.select("lang", "source", "term", "p", "blocks", "block", "slice").unionByName(heads.select("lang", "source", "term", "p", "blocks", "block", "slice"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("lang", "slice", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "source", "term", "p")
    sums = met.groupBy("lang", "slice", "bi", "bj").applyInArrow(_block_sums, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    sums = sums.select("lang", F.explode(ways).alias("w"), "more").select("lang", "w.source", "w.item", "more")
    own = sizes.select("lang", "source", "terms", "base")
    other = sizes.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"))
    if small:
        pairs = own.join(F.broadcast(other), "lang")
    else:
        deal = F.pmod(F.xxhash64("source"), F.lit(DEALS))
        pairs = own.withColumn("deal", deal).join(other.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)).cast("array<bigint>"))), ["lang", "deal"])
    pairs = pairs.where(F.col("source") != F.col("item")).join(sums, ["lang", "source", "item"], "left")
    value = F.when(F.col("terms") > 0, F.col("terms") * distance("base", "item_base") + F.coalesce("more", F.lit(0))).otherwise(F.lit(0))
    return pairs.select("lang", "source", "item", value.cast("long").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of every source of every language."""
    kept = stage_table(kept_terms(docs, least_docs), "kept-terms")
    sizes = stage_table(_sizes(docs, kept), "source-sizes")
    own = sizes.select("lang", "source", F.col("n").alias("total"), "terms", F.col("lang_n").alias("lang_total"))
    own = F.broadcast(own) if sizes.count() <= BROADCAST_GROUPS else own
    shares = kept.join(own, ["lang", "source"]).select(
        "lang", "source", "term", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q")
    )
    more = shares.where("p > q").select("lang", "source", "term", distance("p", "q").alias("value"))
    terms = top_k(more, ["lang", "source"], "value", "term", ranks).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))  # a row for each other source
    pairs = pair_divergence(shares, sizes).withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
