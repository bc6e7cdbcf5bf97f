"""BPE encoding and decoding with a minimal acyclic transducer for frequent words.

Frequent words of the corpus are compiled into a minimal acyclic automaton that
shares suffixes. Its transitions carry numbers; their sum along a word is the
word's rank in the lexicon, which indexes the word's ids. The arrays are one
file that executors memory-map, so the workers of a machine share its pages.
Words that the lexicon lacks are merged pair by pair in the tokenizer's order of
merges; the ids of either way are the same, and the lexicon's size decides
speed alone.

Defined cases: null and empty texts have no ids; strings of special tokens in a
text become their ids, as the tokenizers library has it by default; a NUL
character is a character like any other; a text of any length is read whole and
a word of any length merged in n log n steps; of words that occur equally often
the lexicon takes the first in order; repeated rows are encoded each and count
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.mapped import map_arrays, pack_arrays
from aerolith.llm.packing import byte_symbols
from aerolith.llm.text import groups, lower_ascii, whole_id
from aerolith.plans.sharing import share_file
from aerolith.plans.staging import bounded_batches, drop_staged, stage_table
from aerolith.plans.workers import tidy

#: Words in the lexicon, and the longest of them in bytes.
LEXICON_WORDS, LONGEST = 100_000, 32
#: Different words that a task counts before it gives its counts on.
COUNTED = 500_000
#: Merged words that a worker remembers, and the longest of them in characters.
REMEMBERED, SHORT = 200_000, 256
#: Bytes of a word up to which a scan for its next merge is quicker than a heap.
SCANNED = 128

#: How the tokenizer cuts normalised text into words.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")




@lru_cache(maxsize=1)
def _careful(path: str) -> tuple[dict[int, str], regex.Pattern]:
    """_WORD with the letters and numbers of the tokenizer's own Unicode version, and lower-case forms that unicodedata lacks.

    The regex module knows letters that are newer; the tokenizer's own cut says
    which of those that unicodedata lacks are letters to it.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    cut = own.pre_tokenizer.pre_tokenize_str
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    doubtful = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c)[0] not in "LN"]
    lower = {ord(c): n for c in doubtful if (n := own.normalizer.normalize_str(c)) != c}
    late = [ord(c) for c in doubtful if len(cut(f".{c}")) == 1]
    ranges: list[list[int]] = []
    for c in late:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    new = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]" if ranges else "[^\\s\\S]"
    letter, number = rf"(?:(?!{new})\p{{L}})", rf"(?:(?!{new})\p{{N}})"
    return lower, regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|(?:[^\s\p{{L}}\p{{N}}]|{new})+")


def _cut(text: str, path: str) -> list[str]:
    """The words of normalised text."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            lower, word = _careful(path)
            return word.findall(text.translate(lower))
    return _WORD.findall(text)


class Merges:
    """Vocabulary and merge order of a BPE tokenizer whose words end in a marked symbol."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        symbols, end = {b: c for c, b in byte_symbols().items()}, model["end_of_word_suffix"]
        self.inner = [self.ids[symbols[b]] for b in range(256)]
        self.last = [self.ids[symbols[b] + end] for b in range(256)]
        self.pairs = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.pairs[self.ids[left], self.ids[right]] = rank, self.ids[left + right]
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")

    def shown(self, ids: list[int]) -> tuple[int, str, str]:
        """Number of ids, the ids as text, the decoded text of a word."""
        return len(ids), " ".join(map(str, ids)), " ".join(self.tokens[i] for i in ids)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: of all neighbouring pairs the one of least rank, leftmost first, merges until none can."""
        if len(word) > SCANNED:
            return self._merge_long(word)
        ids = [*(self.inner[b] for b in word[:-1]), self.last[word[-1]]]
        get, none = self.pairs.get, (1 << 60, 0)
        found = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is none or best[0] == 1 << 60:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for a long word, with a heap of pairs: n log n steps instead of n for each merge."""
        ids = [*(self.inner[b] for b in word[:-1]), self.last[word[-1]]]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap: list[tuple[int, int, int, int]] = []  # rank, place, the pair's ids

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := self.pairs.get((ids[i], ids[after[i]]))):
                heappush(heap, (found[0], i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # one of them has merged since
            ids[i], ids[j], after[i] = self.pairs[left, right][1], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [k for k in ids if k >= 0]


def normalise(text: str) -> str:
    """The tokenizer's normal form; white space only separates words and stays as it is."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def words_of(text: str, merges: Merges) -> list[str]:
    """Words in order; a special token's string comes as a word of its own."""
    if "<|" not in text:
        return _cut(normalise(text), merges.path)
    out: list[str] = []
    for k, part in enumerate(merges.split.split(text)):
        out.extend([part] if k % 2 else _cut(normalise(part), merges.path))
    return out


def automaton(words: Iterable[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, and the rank of each word as a sum along its path.

    Words are added in order; a state whose words are complete is replaced by an
    equal one if there is any, which is what makes suffixes shared.
    """
    register: dict[tuple, int] = {}
    done: list[tuple] = []  # (final, ((byte, state), ...)) of each settled state
    path: list[list] = [[False, []]]  # open states along the last word: final, edges
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            key = (final, tuple(edges))
            state = register.get(key)
            if state is None:
                state = register[key] = len(done)
                done.append(key)
            path[-1][1].append((last[len(path) - 1], state))

    for word in words:
        common = next((k for k, (x, y) in enumerate(zip(word, last, strict=False)) if x != y), min(len(word), len(last)))
        settle(common)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    settle(0)
    done.append((path[0][0], tuple(path[0][1])))

    count = np.zeros(len(done), np.int64)
    used = sorted({b for _, edges in done for b, _ in edges})
    symbol = np.zeros(256, np.int32)
    symbol[used] = np.arange(1, len(used) + 1)
    dead = len(done)
    step = np.full((dead + 1, len(used) + 1), dead, np.int32)
    add = np.zeros((dead + 1, len(used) + 1), np.int32)
    for s, (final, edges) in enumerate(done):  # a state's targets are settled before it
        total = int(final)
        for b, t in edges:
            step[s, symbol[b]], add[s, symbol[b]] = t, total
            total += count[t]
        count[s] = total
    final = np.array([f for f, _ in done] + [False])
    return {"step": step, "add": add, "symbol": symbol, "final": final, "start": np.array([dead - 1], np.int32)}


def compile_lexicon(words: Iterable[str], merges: Merges) -> dict[str, np.ndarray]:
    """The automaton of words (normalised, each one word to the tokenizer) and their ids."""
    ordered = sorted({w.encode() for w in words if w and "\0" not in w and len(w.encode()) <= LONGEST and _WORD.fullmatch(w)})
    shown = [merges.shown(merges.merge(w)) for w in ordered]
    out = automaton(ordered) | {"n": np.array([n for n, _, _ in shown], np.int32)}
    for name, texts in (("ids", [t.encode() for _, t, _ in shown]), ("decoded", [t.encode() for _, _, t in shown])):
        out |= {name: np.frombuffer(b"".join(texts), np.uint8), f"{name}_at": np.cumsum([0, *map(len, texts)], dtype=np.int64)}
    return out


class Encoder:
    """Encodes with a mapped lexicon and exact merging, and remembers some merged words."""

    def __init__(self, merges: Merges, lexicon: dict[str, np.ndarray]) -> None:
        self.merges, self.lexicon = merges, {k: np.asarray(v) for k, v in lexicon.items()}
        self._seen: dict[str, tuple[int, str, str]] = {}

    def _texts(self, name: str, ranks: np.ndarray) -> Iterator[str]:
        """Texts of words of the lexicon, read from the mapped file."""
        whole, at = memoryview(self.lexicon[name]), self.lexicon[f"{name}_at"]
        return (whole[i:j].tobytes().decode() for i, j in zip(at[ranks].tolist(), at[ranks + 1].tolist(), strict=True))

    def ranks(self, words: list[str]) -> np.ndarray:
        """Rank of each word in the lexicon, or -1: all words step through the automaton together."""
        lex = self.lexicon
        raw = [w.encode() for w in words]
        out = np.full(len(raw), -1, np.int64)
        fit = np.array([k for k, w in enumerate(raw) if len(w) <= LONGEST and b"\0" not in w], np.int64)
        if not len(fit) or not len(lex["n"]):
            return out
        chars = np.array([raw[k] for k in fit], dtype=f"S{LONGEST}").view(np.uint8).reshape(len(fit), LONGEST)
        symbols = lex["symbol"][chars]
        state = np.full(len(fit), lex["start"][0])
        total, live = np.zeros(len(fit), np.int64), np.arange(len(fit))
        for k in range(LONGEST):
            live = live[chars[live, k] != 0]
            if not len(live):
                break
            s, c = state[live], symbols[live, k]
            total[live] += lex["add"][s, c]
            state[live] = lex["step"][s, c]
        good = lex["final"][state]
        out[fit[good]] = total[good]
        return out

    def shown(self, words: list[str]) -> list[tuple[int, str, str]]:
        out: list = [None] * len(words)
        ranks = self.ranks(words)
        known = np.flatnonzero(ranks >= 0)
        ranks = ranks[known]
        for k, own in zip(known.tolist(), zip(self.lexicon["n"][ranks].tolist(), self._texts("ids", ranks), self._texts("decoded", ranks), strict=True), strict=True):
            out[k] = own
        for k, w in enumerate(words):
            if out[k] is None:
                got = self._seen.get(w)
                if got is None:
                    got = self.merges.shown([self.merges.special[w]] if w in self.merges.special else self.merges.merge(w.encode()))
                    if len(self._seen) >= REMEMBERED:
                        self._seen.clear()
                    if len(w) <= SHORT:
                        self._seen[w] = got
                out[k] = got
        return out

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of its ids, the ids joined by spaces and the decoded text."""
        words: list[str] = []
        ends = [0]
        for t in texts:
            words.extend(words_of(t, self.merges) if t else ())
            ends.append(len(words))
        distinct: dict[str, int] = {}
        codes = np.array([distinct.setdefault(w, len(distinct)) for w in words], np.int64)
        shown = self.shown(list(distinct))
        n = np.array([s[0] for s in shown], np.int64)
        ids, tokens = [s[1] for s in shown], [s[2] for s in shown]
        totals = np.concatenate([[0], np.cumsum(n[codes])]) if len(words) else np.zeros(1, np.int64)
        codes = codes.tolist()
        for i, j in zip(ends, ends[1:], strict=False):
            own = codes[i:j]
            yield int(totals[j] - totals[i]), " ".join([ids[c] for c in own]), " ".join([tokens[c] for c in own])


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=1)
def _encoder(path: str, file: str) -> Encoder:
    return Encoder(_merges(path), map_arrays(SparkFiles.get(file)))


def _letter_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of letters (ASCII, or any other byte from 0x80 on) of a partition with their counts, none left out."""
    letter = np.zeros(256, bool)
    letter[97:123] = True
    letter[128:] = True
    counts: Counter[bytes] = Counter()

    def give() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for b in batches:
        for _, _, raw, _ in groups(b.column(0)):
            low = lower_ascii(raw)
            inside = np.concatenate([[False], letter[low], [False]])
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            starts, stops = edge[::2], edge[1::2]
            short = stops - starts <= LONGEST
            whole = low.tobytes()
            counts.update(whole[i:j] for i, j in zip(starts[short].tolist(), stops[short].tolist(), strict=True))
        if len(counts) > COUNTED:
            yield give()
    yield give()


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent runs of letters of all texts, at most ``most``: this many rows reach the driver.

    Counts by powers of two tell how often a word must occur, so the rows that
    are ordered are a small multiple of ``most``, however many words there are.
    """
    found = docs.select("text").mapInArrow(tidy(_letter_runs), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = stage_table(found, "word-counts")
    level = F.floor(F.log2("n")).cast("int")
    least, total = 0, 0
    for r in sorted(found.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # a row for each power of two
        least, total = r["level"], total + r["count"]
        if total >= most:
            break
    top = found.where(F.col("n") >= 2**least).orderBy(F.desc("n"), "word").limit(most).select("word").toArrow().column(0).to_pylist()
    drop_staged(found)
    return [w.decode(errors="ignore") for w in top]


def _encode(path: str, file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, file)
        for b in batches:
            for i, j, _, _ in groups(b.column(1), 4 << 20):
                part = b.slice(i, j - i)
                n, ids, decoded = [], [], []
                for count, shown, text in encoder.encode(part.column(1).to_pylist()):
                    n.append(count)
                    ids.append(hashlib.sha256(shown.encode()).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _encode_rows(path: str, file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, file)
        for b in batches:
            got = list(encoder.encode(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([list(map(int, x[1].split())) for x in got], pa.list_(pa.int32())), pa.array([x[2] for x in got], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return run


def share_lexicon(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS) -> str:
    """Compile the corpus's frequent words and hand the file to the executors."""
    bounded_batches(docs.sparkSession)
    arrays = compile_lexicon(frequent_words(docs, most), _merges(tokenizer))
    return share_file(docs.sparkSession, pack_arrays(arrays), "lexicon")


def encode(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids and decoded text of every whole text."""
    file = share_lexicon(docs, tokenizer, most)
    return docs.select(whole_id(docs), "text").mapInArrow(tidy(_encode_rows(tokenizer, file)), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded text; the ids themselves stay in the task."""
    file = share_lexicon(docs, tokenizer, most)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(whole_id(docs), "text").mapInArrow(tidy(_encode(tokenizer, file)), schema)
