"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Templates are whole licence texts (the files of ``licence_texts``) and notices.
A whole text is compared with the whole licences, whatever its length. Notices
are looked for at every place: a header is a run of as many terms as the notice
has, over lines and comment marks alike, so one that is wrapped or stands in a
longer paragraph is found. Vectors are sparse, with weights (1 + log count) * idf
over all terms. A template counts from a cosine of COSINE; a short one of fewer
than WHOLE different terms must be there with all of them. Nothing is looked up
by a list of words: a template is left out for a text, or a place, only where the
terms that are there bound the cosine below COSINE (Cauchy-Schwarz).

Document frequencies cover all documents and all terms: those of the templates'
terms one by one, those of all others in 2**BUCKET_BITS buckets by hash, so what
is broadcast does not grow with the corpus.

A document that is a licence as a whole, or consists of a notice for the most
part, or has a licence and the name of a licence file, is a licence file. Its
directory, and all below it that have no nearer one, inherit its licence. Paths
are resolved by joins of directories with their ancestors, so only short rows of
paths are shuffled and a directory may hold any share of the files.

Defined cases: null and empty texts have no licence of their own but inherit;
a text of any length is read whole; a null path has no directory and inherits
nothing; of several licence files in a directory the best match counts, then the
least path; a whole licence goes before a notice, equal cosines go to the
template first in order; repeated rows come back as often as they occur; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.text import groups, lower_ascii, runs, spans_hash, whole_id
from aerolith.plans.staging import bounded_batches, stage_table
from aerolith.plans.workers import tidy

#: Usual notices of licences.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Released under CC0 1.0 Universal public domain dedication",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "ISC": ("Released under the ISC License",),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "MIT": ("Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
}
#: Suffixes of identifiers, for versions of the same licence.
_SUFFIXES = {"GPL-2.0": ("-only", "-or-later", "+"), "GPL-3.0": ("-only", "-or-later", "+"), "LGPL-2.1": ("-only", "-or-later", "+"), "LGPL-3.0": ("-only", "-or-later", "+")}

COSINE, FILE_SHARE, WHOLE = 0.8, 0.5, 5
BUCKET_BITS = 18
_TERM = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]")
_FILE_NAME = re.compile(r"(?:^|/)(?:licen[cs]e|copying|copyright|notice)[^/]*$", re.IGNORECASE)
#: Directories up to this number are broadcast; beyond it they are shuffled.
BROADCAST_DIRS = 100_000

_ALNUM = np.zeros(256, bool)
_ALNUM[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
_INNER, _END = _ALNUM.copy(), _ALNUM.copy()
_INNER[[*b".+-"]], _END[[*b"+"]] = True, True


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def term_spans(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of lower-cased texts: runs of letters, digits and .+- without such marks around them (a + may end one)."""
    starts, stops = runs(_INNER[low], at)
    if not len(starts):
        return starts, stops
    letters, ends = np.append(np.flatnonzero(_ALNUM[low]), len(low)), np.flatnonzero(_END[low])
    starts = letters[np.searchsorted(letters, starts)]
    some = starts < stops
    starts, stops = starts[some], stops[some]
    return starts, ends[np.searchsorted(ends, stops) - 1] + 1 if len(ends) else stops


def _hashes(text: str) -> np.ndarray:
    raw = lower_ascii(np.frombuffer(text.encode(), np.uint8))
    return spans_hash(raw, *term_spans(raw, np.array([0, len(raw)])))


@dataclass(frozen=True)
class Template:
    licence: str
    whole: bool
    terms: np.ndarray  # hashes of its terms, in order


def templates() -> list[Template]:
    """Whole licences, then notices, then identifiers; fixed by the files and tables of this package."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    out = [Template(f.stem, True, _hashes(f.read_text(encoding="utf-8"))) for f in files]
    out += [Template(name, False, _hashes(n)) for name, own in NOTICES.items() for n in own]
    return out + [Template(name, False, _hashes(f"SPDX-License-Identifier: {name}{s}")) for name in NOTICES for s in ("", *_SUFFIXES.get(name, ()))]


def _slots(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each hash in the templates' sorted vocabulary; beyond it, its bucket."""
    k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[k] == h, k, len(vocabulary) + (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))


def _frequencies(vocabulary: np.ndarray):
    """(slot, documents that have it) of a partition; slot -1 has the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(vocabulary) + (1 << BUCKET_BITS), np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, _, raw, at in groups(b.column(0)):
                low = lower_ascii(raw)
                starts, stops = term_spans(low, at)
                doc = np.searchsorted(at, starts, "right") - 1
                distinct = np.unique(doc * len(counts) + _slots(spans_hash(low, starts, stops), vocabulary))
                counts += np.bincount(distinct % len(counts), minlength=len(counts))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(counts[found], n))], names=["slot", "n"])

    return run


class Weights:
    """Inverse document frequencies and the templates' unit vectors."""

    def __init__(self, given: list[Template], vocabulary: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> None:
        n = int(counts[slots < 0].sum())
        found = np.zeros(len(vocabulary) + (1 << BUCKET_BITS), np.int64)
        found[slots[slots >= 0]] = counts[slots >= 0]
        self.vocabulary, self.idf = vocabulary, (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)
        self.names, self.whole = [t.licence for t in given], np.array([t.whole for t in given])
        self.length, self.different = np.array([len(t.terms) for t in given]), np.array([len(np.unique(t.terms)) for t in given])
        self.unit = np.zeros((len(vocabulary) + 1, len(given)), np.float32)  # the last row is for all other terms
        for k, t in enumerate(given):
            own, c = np.unique(_slots(t.terms, vocabulary), return_counts=True)
            w = (1 + np.log(c)) * self.idf[own]
            self.unit[own, k] = w / np.linalg.norm(w)

    def cosines(self, slots: np.ndarray, h: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of a run of terms (their slots and hashes) with the templates ``which``, and how many terms of each it has."""
        _, first, c = np.unique(h, return_index=True, return_counts=True)
        own = slots[first]
        w = (1 + np.log(c)) * self.idf[own]
        q = self.unit[np.minimum(own, len(self.vocabulary))][:, which]
        return w @ q / np.linalg.norm(w), (q > 0).sum(0)

    def best(self, h: np.ndarray) -> tuple[int, float, int]:
        """The template that a text matches best (-1: none from COSINE), its cosine, and the terms of the text that it covers.

        ``h`` are the hashes of the text's terms.
        """
        if not len(h):
            return -1, 0.0, 0
        slots = _slots(h, self.vocabulary)
        known = np.minimum(slots, len(self.vocabulary))
        bound = (self.unit[np.unique(known)] ** 2).sum(0)  # no run of the text has a larger squared cosine
        may = bound >= COSINE**2
        if not may.any():
            return -1, 0.0, 0
        which = np.flatnonzero(may & self.whole)
        if len(which):
            cosine = self.cosines(slots, h, which)[0]
            if cosine.max() >= COSINE:
                return int(which[cosine.argmax()]), float(cosine.max()), len(h)
        found = (-1, 0.0, 0)
        for k in np.flatnonzero(may & ~self.whole).tolist():
            size = min(int(self.length[k]), len(h))
            sums = np.concatenate([[0], np.cumsum(self.unit[known, k].astype(np.float64) ** 2)])
            for i in np.flatnonzero(sums[size:] - sums[:-size] >= COSINE**2 - 1e-9).tolist():
                cosine, has = self.cosines(slots[i : i + size], h[i : i + size], np.array([k]))
                if cosine[0] > found[1] and cosine[0] >= COSINE and (self.different[k] >= WHOLE or has[0] == self.different[k]):
                    found = (k, float(cosine[0]), size)
        return found


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: Weights = shared.value
        for b in batches:
            licence, score, share = [], [], []
            for _, _, raw, at in groups(b.column(2)):
                low = lower_ascii(raw)
                starts, stops = term_spans(low, at)
                h, edges = spans_hash(low, starts, stops), np.searchsorted(starts, at)
                for i, j in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                    k, cosine, covered = weights.best(h[i:j])
                    licence.append(weights.names[k] if k >= 0 else None)
                    score.append(cosine)
                    share.append(covered >= FILE_SHARE * (j - i))
            named = [p is not None and _FILE_NAME.search(p) is not None for p in b.column(1).to_pylist()]
            file = [own is not None and (s or n) for own, s, n in zip(licence, share, named, strict=True)]
            columns = [pa.array(licence, pa.string()), pa.array(score, pa.float64()), pa.array(file, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "path", "own_license", "own_score", "is_file"])

    return run


def corpus_weights(docs: DataFrame) -> Weights:
    """Weights from the document frequencies of all terms; a row for each slot, of which there are a fixed number, reaches the driver."""
    given = templates()
    vocabulary = np.unique(np.concatenate([t.terms for t in given]))
    found = docs.select("text").mapInArrow(tidy(_frequencies(vocabulary)), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    return Weights(given, vocabulary, np.asarray(found.column("slot")), np.asarray(found.column("n")))


def scan(docs: DataFrame) -> DataFrame:
    """From doc_id, path and text: doc_id, path, own_license, own_score, license and license_dir (null unless inherited)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(corpus_weights(docs))
    schema = "doc_id long, path string, own_license string, own_score double, is_file boolean"
    own = stage_table(docs.select(whole_id(docs), "path", "text").mapInArrow(tidy(_scan(shared)), schema), "own-licences")
    own = own.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/", 1)))
    files = own.where(F.col("is_file") & F.col("dir").isNotNull())
    rank = F.struct(-F.col("own_score"), F.col("path"), F.col("own_license"))
    given = files.groupBy("dir").agg(F.min_by("own_license", rank).alias("found"))
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.concat_ws("/", F.slice(parts, 1, n)).alias("up"), n.alias("depth")))
    above = own.where(F.col("dir").isNotNull()).select("dir").distinct().select("dir", F.explode(up).alias("a")).select("dir", "a.up", "a.depth")
    given = stage_table(given.withColumnRenamed("dir", "up"), "licence-dirs")
    small = F.broadcast(given) if given.count() <= BROADCAST_DIRS else given
    nearest = above.join(small, "up").groupBy("dir").agg(F.max_by(F.struct("found", "up"), "depth").alias("near"))
    nearest = stage_table(nearest.select(F.col("dir").alias("__dir"), "near.found", "near.up"), "licence-heirs")
    small = F.broadcast(nearest) if nearest.count() <= BROADCAST_DIRS else nearest
    out = own.join(small, F.col("dir") == F.col("__dir"), "left")
    inherits = F.col("own_license").isNull() & F.col("found").isNotNull()
    return out.select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "found").alias("license"), F.when(inherits, F.col("up")).alias("license_dir")
    )


def corpus_paths(documents: DataFrame) -> DataFrame:
    """Documents as files of a tree: source/thousands/hundreds/doc_id.txt, and every tenth one a directory higher."""
    k = F.col("doc_id")
    thousands, hundreds = F.floor(k / 1000).cast("string"), F.floor(k / 100).cast("string")
    where = F.when(k % 10 == 0, F.concat_ws("/", "source", thousands)).otherwise(F.concat_ws("/", "source", thousands, hundreds))
    return documents.select("doc_id", F.concat(where, F.lit("/"), k.cast("string"), F.lit(".txt")).alias("path"), "text")
