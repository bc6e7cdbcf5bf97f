"""Near-duplicate detection with a MinHash LSH forest.

Documents are sets of hashed word shingles. Documents of equal sets form one
class at once. A class has a signature of DEEPEST min-hashes for each tree; a tree is
the order of all classes by their signature in it. Classes with a
common prefix of SHALLOWEST values form a region. A region that is small enough
is one block of candidates. A dense one is first cut into blocks whose common
prefix grows until they are small, which links most of a group of near copies at
little cost; what is in different components then is compared block by block
(``_dense_pairs``) until every member met every other whose size allows a link.

Blocks, not pairs, are shuffled. Trees are taken in rounds; a block whose
classes are in one component by then is done. In the others signatures tell
which members have a possible partner in another component, and only those
bring their full sets, on which each link is confirmed with integers. Inside a
block a pair already connected is not compared again, so a block yields a
spanning forest of its links.

The number of trees follows from the similarity that is asked for (``Forest``):
a pair at it shares a region of 4 values in some tree with probability 0.99999
(16 trees at 0.85, 22 at 0.8), however dense the region and however long the
texts. No document and no link is dropped for want of room. The price is
paid by regions of more than BLOCK_CLASSES classes that do not link: their
comparisons grow with the square of their classes, in tasks of two chunks each.

Defined cases: null text, empty text and text without words have no shingles and
link with nothing; fewer words than the width make one shingle; rows that repeat
an id count as one document (with the least of their set hashes); a null id is
left out of links and comes back as its own component; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.llm.components import Labels, components
from aerolith.llm.text import groups, lower_ascii, mix, spans_hash, whole_id, windows_hash, words
from aerolith.plans.staging import bounded_batches, drop_staged, stage_table
from aerolith.plans.workers import tidy

#: Words of a shingle, and the similarity from which documents link, in hundredths.
WIDTH, PERCENT = 5, 80
#: Min-hashes of a region's prefix and of a tree.
SHALLOWEST, DEEPEST = 4, 8
#: The share of pairs at the threshold that may share no region, and the trees of the first round.
MISSED, FIRST_TREES = 1.1e-5, 2
#: Classes and shingles that a block, or a chunk of a dense region, may hold.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 4 << 20
#: With more possible partners than this, a member's shared shingles are counted with all of a block at once.
MANY = 16
#: Ids up to this number are broadcast when texts are read again; beyond it they are shuffled.
BROADCAST_IDS = 1_000_000

#: Rows that one task of a sort or of the blocks gets, where the session's partitions would get more.
TASK_ROWS = 2_000_000
_STEP = 4096


@dataclass(frozen=True)
class Forest:
    """What follows from the similarity (in hundredths) from which two sets link."""

    percent: int = PERCENT

    @cached_property
    def trees(self) -> int:
        """The fewest trees with which a pair at the threshold shares no region with probability MISSED at most."""
        return int(np.ceil(np.log(MISSED) / np.log(1 - (self.percent / 100) ** SHALLOWEST)))

    @property
    def hashes(self) -> int:
        return self.trees * DEEPEST

    @cached_property
    def agree(self) -> int:
        """Min-hashes that a linked pair has in common: the mean at the threshold less 5.6 standard deviations."""
        s = self.percent / 100
        return int(self.hashes * s - 5.6 * np.sqrt(self.hashes * s * (1 - s)))

    @cached_property
    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """Odd multipliers and summands of the hash functions; those of a smaller forest come first."""
        seed = np.random.Generator(np.random.PCG64(20240229))
        drawn = np.stack([seed.integers(0, 1 << 32, 2, dtype=np.uint32) for _ in range(self.hashes)])
        return drawn[:, 0] | np.uint32(1), drawn[:, 1]


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a flat byte array."""
    low = lower_ascii(raw)
    starts, stops, word_at = words(low, at)
    h = spans_hash(low, starts, stops)
    wide = windows_hash(h, width)
    for i, j in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
        n = j - i
        if n >= width:
            yield np.unique(wide[i : j - width + 1])
        else:
            yield windows_hash(h[i:j], n) if n else h[:0]


def signature(shingles: np.ndarray, forest: Forest) -> np.ndarray:
    """The least value of each hash function of a forest over a set that is not empty."""
    multiply, add = forest.functions
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(forest.hashes, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), _STEP):
        np.minimum(out, (low[k : k + _STEP, None] * multiply + add).min(0), out=out)
    return out


def _sign(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, one, two, sig, low = [], [], [], [], []
            for _, _, raw, at in groups(b.column(1)):
                for s in shingle_sets(raw, at):
                    n.append(len(s))
                    one.append(int(np.bitwise_xor.reduce(s)) if len(s) else 0)
                    two.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()) if len(s) else 0)
                    values = signature(s, forest) if len(s) else None
                    sig.append(None if values is None else values.tobytes())
                    low.append(None if values is None else values.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(n, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)),
                    pa.array(np.array(two, np.uint64).view(np.int64)), pa.array(sig, pa.binary()), pa.array(low, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "sig", "sig8"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [s.tobytes() for _, _, raw, at in groups(b.column(1)) for s in shingle_sets(raw, at)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])


def _in_trees(trees: int):
    """A class's place in every tree: the min-hashes of the tree's signature in order, two to a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.array([np.frombuffer(x, np.uint32) for x in b.column(2).to_pylist()], np.uint32).reshape(-1, trees, DEEPEST)
            wide = sig[..., 0::2].astype(np.uint64) << np.uint64(32) | sig[..., 1::2]
            n = len(sig)
            keys = wide.reshape(n * trees, DEEPEST // 2).view(np.int64)
            own = pa.array(np.repeat(np.arange(n), trees))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), *(pa.array(np.ascontiguousarray(keys[:, k])) for k in range(DEEPEST // 2)),
                    b.column(0).take(own), b.column(1).take(own),
                ],
                names=["tree", *_KEYS, "id", "n"],
            )

    return run


_KEYS = tuple(f"k{i}" for i in range(DEEPEST // 2))


def _common(x: np.ndarray) -> np.ndarray:
    """Length of the common prefix, in min-hashes, of each row with the next; x has columns tree and _KEYS."""
    same = x[1:, 0] == x[:-1, 0]
    out = np.zeros(len(same), np.int64)
    diff = x[1:, 1:].view(np.uint64) ^ x[:-1, 1:].view(np.uint64)
    for k in range(diff.shape[1]):
        whole = same & (diff[:, k] == 0)
        out += np.where(whole, 2, np.where(same & (diff[:, k] >> np.uint64(32) == 0), 1, 0))
        same = whole
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut sorted classes of dense regions into blocks (block, tree, id); what the cuts part is left to _dense_pairs.

    Rows come sorted by tree and signature. At most one block's worth of rows is
    held; if the region goes on beyond it, the deepest prefix that ends inside
    closes there.
    """
    x, ids, n = np.zeros((0, 1 + len(_KEYS)), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        x = np.concatenate([x, np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("tree", *_KEYS)], 1)])
        ids, n = np.concatenate([ids, np.asarray(b.column("id"))]), np.concatenate([n, np.asarray(b.column("n"))])
        done, rows = _cut(x, ids, n, False)
        x, ids, n = x[done:], ids[done:], n[done:]
        yield rows
    yield _cut(x, ids, n, True)[1]


def _cut(x: np.ndarray, ids: np.ndarray, n: np.ndarray, last: bool) -> tuple[int, pa.RecordBatch]:
    """Blocks of the rows whose block is sure, and how many rows those are."""
    common = _common(x)
    ends = np.flatnonzero(common < SHALLOWEST) + 1  # regions end before these rows
    found: list[tuple[int, int]] = []
    at = 0
    size = np.concatenate([[0], np.cumsum(n)])

    def fits(i: int, j: int) -> bool:
        return j - i <= BLOCK_CLASSES and size[j] - size[i] <= BLOCK_SHINGLES

    while at < len(x):
        k = np.searchsorted(ends, at, "right")
        end = int(ends[k]) if k < len(ends) else len(x)
        sure = k < len(ends) or last
        if sure and fits(at, end):
            if end - at > 1:
                found.append((at, end))
            at = end
            continue
        room = min(end, at + BLOCK_CLASSES, int(np.searchsorted(size, size[at] + BLOCK_SHINGLES, "right")) - 1)
        if not sure and room == end:
            break  # the region may go on in the next batch
        room = max(room, at + 2)
        inner = common[at : room - 1] if room - 1 > at else common[at:at]
        # the last of the shallowest boundaries inside ends a sub-region; a run of equal signatures is cut at the room, with one class of overlap
        cut = room - 1 - int(inner[::-1].argmin())
        if inner.min() >= DEEPEST:
            found.append((at, room))
            at = room - 1 if room < end else room
        else:
            if cut - at > 1:
                found.append((at, cut))
            at = cut
    block, tree, member = [], [], []
    for i, j in found:
        name = int(mix(np.array([x[i, 0] * 1_000_003 + int(ids[i])], np.int64).view(np.uint64) ^ x[i : i + 1, 1].view(np.uint64) ^ np.uint64(j - i))[0])
        block.append(np.full(j - i, name, np.uint64).view(np.int64))
        tree.append(x[i:j, 0].astype(np.int32))
        member.append(ids[i:j])
    join = lambda p, t: np.concatenate(p) if p else np.zeros(0, t)
    rows = pa.RecordBatch.from_arrays([pa.array(join(block, np.int64)), pa.array(join(tree, np.int32)), pa.array(join(member, np.int64))], names=["block", "tree", "id"])
    return at, rows


def _by_block(settle, names: tuple[str, ...]):
    """Run settle(arrays of a block) on rows that come sorted by block; a block may reach over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            block = np.asarray(t.column("block"))
            edge = np.flatnonzero(block[1:] != block[:-1]) + 1
            last = int(edge[-1]) if len(edge) else 0
            rest = t.slice(last)
            yield from parts(t.slice(0, last), np.concatenate([[0], edge]) if last else edge)
        if rest is not None:
            yield from parts(rest, np.array([0, rest.num_rows]))

    def parts(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        t = t.combine_chunks()
        columns = [np.asarray(c) if pa.types.is_integer(c.type) else c for c in (x.chunk(0) for x in t.columns)]
        out: list[tuple] = []
        for i, j in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            own = [c[i:j] if isinstance(c, np.ndarray) else c.slice(i, j - i) for c in columns]
            out.append(settle(dict(zip(t.column_names, own, strict=True))))
        arrays = [pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in c]) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=list(names))

    return run


def _signs(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(s, np.uint8) for s in column.to_pylist()])


def _regions(column: pa.Array, tree: int) -> np.ndarray:
    """The members' regions in the trees before this one: a pair with one of them in common meets there."""
    return np.stack([np.frombuffer(r, np.int64)[:tree] for r in column.to_pylist()])


def _possible(forest: Forest):
    """Members of a block that may link with a member of another component, by size and signature.

    In a block of two chunks, sides 1 and 2, members meet those of the other side,
    and a pair only in the first tree in which its members share a region.
    """

    def run(block: dict) -> tuple:
        sig, comp, n, side, tree = _signs(block["sig"]), block["comp"], block["n"], block["side"], int(block["tree"][0])
        regions = _regions(block["regions"], tree) if tree > 0 else None
        need = np.zeros(len(comp), bool)
        for i in range(len(comp) - 1):
            m = n[i + 1 :]
            met = (side[i + 1 :] != side[i]) | (side[i] == 0)
            other = i + 1 + np.flatnonzero(met & (comp[i + 1 :] != comp[i]) & (100 * np.minimum(m, n[i]) >= forest.percent * np.maximum(m, n[i])))
            if regions is not None and len(other):
                other = other[~(regions[other] == regions[i]).any(1)]
            if len(other):
                near = other[(sig[other] == sig[i]).sum(1) >= forest.agree]
                need[near] = True
                need[i] |= len(near) > 0
        keep = pa.array(need)
        return block["block"][need], block["tree"][need], block["id"][need], comp[need], block["sig"].filter(keep), block["regions"].filter(keep)

    return run


class _Overlaps:
    """Shared shingles of one set of a block with all later ones.

    Shingles that a sixteenth of the sets hold, and eight at least, are counted by
    bits, the others by lists of the sets that hold them.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        n = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), n)
        _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        hot = count >= max(8, len(sets) // 16)
        bit = np.cumsum(hot) - 1
        words = int(hot.sum()) + 63 >> 6
        self._bits = np.zeros((len(sets), words), np.uint64)
        own = hot[shingle]
        at = bit[shingle[own]]
        np.bitwise_or.at(self._bits, (owner[own], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        rare = ~own & (count[shingle] > 1)
        order = np.argsort(shingle[rare], kind="stable")
        self._holders = owner[rare][order]
        held = np.bincount(shingle[rare], minlength=len(count))
        first = np.concatenate([[0], np.cumsum(held)])
        self._from, self._to = first[shingle[rare]], first[shingle[rare] + 1]
        self._edges = np.searchsorted(owner[rare], np.arange(len(sets) + 1))
        self._n = len(sets)

    def of(self, p: int) -> np.ndarray:
        """The number of shingles that set p shares with each set."""
        both = np.bitwise_count(self._bits & self._bits[p]).sum(1, dtype=np.int64)
        i, j = self._edges[p], self._edges[p + 1]
        start, size = self._from[i:j], self._to[i:j] - self._from[i:j]
        if len(size):
            lists = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            both += np.bincount(self._holders[lists], minlength=self._n)
        return both


def _links(forest: Forest):
    """The components that a block's links join, each with the least of them; links are confirmed on full sets."""

    def run(block: dict) -> tuple:
        order = np.argsort(np.array([len(s) for s in block["shingles"].to_pylist()]), kind="stable")
        comp, sig, tree = block["comp"][order].tolist(), _signs(block["sig"])[order], int(block["tree"][0])
        regions = _regions(block["regions"], tree)[order] if tree > 0 else None
        sets = [np.frombuffer(s, np.uint64) for s in block["shingles"].take(pa.array(order)).to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        labels, overlaps = Labels(), None
        for p in range(len(sets)):
            near = p + 1 + np.flatnonzero(forest.percent * n[p + 1 :] <= 100 * n[p])
            near = near[(sig[near] == sig[p]).sum(1) >= forest.agree]
            if regions is not None and len(near):
                near = near[~(regions[near] == regions[p]).any(1)]
            own = labels.find(comp[p])
            near = np.array([q for q in near.tolist() if labels.find(comp[q]) != own], np.int64)
            if len(near) > MANY:
                overlaps = overlaps or _Overlaps(sets)
                both = overlaps.of(p)[near]
            else:
                both = np.array([_shared(sets[p], sets[q]) for q in near.tolist()], np.int64)
            for q in near[100 * both >= forest.percent * (n[p] + n[near] - both)].tolist():
                labels.join(comp[p], comp[q])
        a, b = labels.stars()
        return np.array(a, np.int64), np.array(b, np.int64)

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Values in both of two sorted sets, x not the larger."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _tasks(rows: DataFrame) -> int:
    """Partitions for a staged table: those of the session, or more if a task would get over TASK_ROWS rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2, -(-rows.count() // TASK_ROWS))


def _sorted_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block", "id")


def _small(rows: DataFrame) -> DataFrame:
    """A staged table of ids or regions, broadcast if it is within BROADCAST_IDS rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _with_regions(trees: int):
    """(id, sig, regions) of classes: the last is the name of the class's region in each tree, as 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.array([np.frombuffer(x, np.uint32) for x in b.column(2).to_pylist()], np.uint32).reshape(-1, trees, DEEPEST)[..., :SHALLOWEST]
            wide = np.ascontiguousarray(sig).view(np.uint64)
            names = mix(mix(wide[..., 0]) + wide[..., 1] * np.uint64(0xD1342543DE82EF95))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in names], pa.binary())], names=["id", "sig", "regions"])

    return run


def _dense_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(block, tree, side, id, comp, n): every two members (region, tree, id, comp, n) of a region that may link meet in a block.

    Members are dealt by hash into chunks of equal size class; a pair of chunks is
    a block with two sides. Sizes in classes that are not neighbours cannot link.
    A component of more members than a chunk has chunks of its own, which do not
    meet each other.
    """
    counts = members.groupBy("region", "comp").agg(F.count("*").alias("m"))
    open_ = counts.groupBy("region").agg(F.count("*").alias("comps")).where("comps > 1").select("region")
    large = counts.where(F.col("m") > BLOCK_CLASSES).select("region", "comp", F.lit(True).alias("large"))
    members = members.join(_small(stage_table(open_, "open-regions")), "region", "left_semi").join(_small(stage_table(large, "large-components")), ["region", "comp"], "left")
    own = F.coalesce("large", F.lit(False))
    ratio = float(np.log(100 / percent * 1.001))  # a little wide, so that rounding puts no two sizes that may link two classes apart
    band = F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int")
    members = members.select("region", "tree", "id", "comp", "n", own.alias("own"), F.when(own, F.col("comp")).otherwise(F.lit(0).cast("long")).alias("owner"), band.alias("band"))
    cell = ["region", "own", "owner", "band"]
    room = F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / (BLOCK_SHINGLES // 2)))
    cells = stage_table(members.groupBy(*cell).agg(room.cast("int").alias("room")), "dense-cells")
    name = F.xxhash64(*cell, "k")
    chunks = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("room") - 1))).withColumn("chunk", name)
    x, y = (chunks.select("region", *(F.col(c).alias(f"{c}_{t}") for c in ("own", "owner", "band", "chunk"))) for t in "xy")
    meet = (F.abs(F.col("band_x") - F.col("band_y")) <= 1) & (F.col("chunk_x") <= F.col("chunk_y"))
    apart = ~(F.col("own_x") & F.col("own_y") & (F.col("owner_x") == F.col("owner_y")))
    pairs = x.join(y, "region").where(meet & apart).select("chunk_x", "chunk_y", F.xxhash64("chunk_x", "chunk_y").alias("block"))
    same = F.col("chunk_x") == F.col("chunk_y")
    pairs = stage_table(pairs.select("block", F.explode(F.when(same, F.array(F.struct(F.col("chunk_x").alias("chunk"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("chunk_x").alias("chunk"), F.lit(1).alias("side")), F.struct(F.col("chunk_y").alias("chunk"), F.lit(2).alias("side")))
    )).alias("c")).select("block", "c.chunk", "c.side"), "chunk-pairs")
    dealt = members.join(_small(cells), cell).withColumn("k", F.pmod(F.xxhash64("id"), F.col("room").cast("long")).cast("int")).withColumn("chunk", name)
    return dealt.join(_small(pairs), "chunk").select("block", "tree", "side", "id", "comp", "n")


_WANTED = ("block", "tree", "id", "comp", "sig", "regions")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; sets link from a similarity of ``percent`` hundredths."""
    bounded_batches(docs.sparkSession)
    forest = Forest(percent)
    docs = docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage_table(docs.mapInArrow(tidy(_sign(forest)), "doc_id long, n_shingles long, h1 long, h2 long, sig binary, sig8 binary"), "signatures")
    named = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    key = ("n_shingles", "h1", "h2")
    classes = stage_table(named.groupBy(*key).agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("sig8").alias("sig8")), "classes")
    signs = classes.select("id", F.col("n_shingles").alias("n"), F.col("sig8").alias("sig"), F.lit(None).cast("binary").alias("regions"))
    places = classes.select("id", F.col("n_shingles").alias("n"), "sig")
    schema = ", ".join(["tree int", *(f"{k} long" for k in _KEYS), "id long", "n long"])
    sorted_in = places.mapInArrow(tidy(_in_trees(forest.trees)), schema).withColumn("region", F.xxhash64("tree", *_KEYS[: SHALLOWEST // 2]))
    sorted_in = stage_table(sorted_in, "forest")
    sizes = sorted_in.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    dense = _small(stage_table(sizes.where((F.col("m") > 1) & ((F.col("m") > BLOCK_CLASSES) | (F.col("s") > BLOCK_SHINGLES))).select("region"), "dense-regions"))
    crowd = stage_table(sorted_in.join(dense, "region", "left_semi"), "crowds")
    ordered = crowd.repartitionByRange(_tasks(crowd), "tree", *_KEYS, "id").sortWithinPartitions("tree", *_KEYS, "id")
    cut = ordered.select("tree", *_KEYS, "id", "n").mapInArrow(tidy(_blocks), "block long, tree int, id long")
    whole = sorted_in.join(dense, "region", "left_anti").select(F.col("region").alias("block"), "tree", "id")
    whole = whole.withColumn("m", F.count("*").over(Window.partitionBy("block"))).where("m > 1").drop("m")
    blocks = stage_table(whole.unionByName(cut), "blocks")
    comp: DataFrame | None = None

    def named_by(rows: DataFrame) -> DataFrame:
        return rows.join(comp, "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id") if comp else rows.withColumn("comp", F.col("id"))

    rounds: list[tuple[int, int] | None] = [(0, FIRST_TREES), (FIRST_TREES, forest.trees), None]
    for trees in rounds:
        if trees:
            rows = named_by(blocks.where((F.col("tree") >= trees[0]) & (F.col("tree") < trees[1])).select("block", "id"))
            open_ = rows.groupBy("block").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("block")
            rows = rows.join(open_, "block").join(signs, "id").withColumn("side", F.lit(0)).withColumn("tree", F.lit(0))
        else:  # what the cuts of dense regions parted
            met = stage_table(named_by(crowd.select("region", "tree", "id", "n")), "crowds-named")
            if not met.groupBy("region").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").take(1):
                break
            members = classes.join(_small(stage_table(crowd.select("id").distinct(), "crowd-members")), "id", "left_semi")
            members = members.select("id", "sig8", "sig").mapInArrow(tidy(_with_regions(forest.trees)), "id long, sig binary, regions binary")
            rows = _dense_pairs(met, percent).join(members, "id")
        schema = "block long, tree int, id long, comp long, sig binary, regions binary"
        wanted = stage_table(_sorted_blocks(rows).mapInArrow(tidy(_by_block(_possible(forest), _WANTED)), schema), "wanted")
        ids = stage_table(wanted.select("id").distinct(), "wanted-ids")
        again = docs.join(_small(ids), F.col("doc_id") == F.col("id"), "left_semi")
        sets = again.mapInArrow(tidy(_sets), "id long, shingles binary")
        found = _sorted_blocks(wanted.join(sets, "id")).mapInArrow(tidy(_by_block(_links(forest), ("a", "b"))), "a long, b long")
        found = stage_table(found, "near-links")  # components begin in Python too: two such steps in one stage take two workers for each core, and both stay
        joined = components(found)
        if comp is not None:  # what was joined are components by now
            merged = joined.select(F.col("id").alias("component_id"), F.col("component_id").alias("later"))
            joined = comp.join(merged, "component_id", "left").select("id", F.coalesce("later", "component_id").alias("component_id")).union(joined)
        comp = stage_table(joined, "components")
        drop_staged(wanted, ids, found)
    drop_staged(sorted_in, crowd, blocks)
    own = named.join(classes.select(*key, "id"), list(key)).select("doc_id", "id")
    own = own.groupBy("doc_id").agg(F.min("id").alias("id"))
    own = own.join(comp, "id", "left").select("doc_id", F.coalesce("component_id", "id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(own, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    )


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose document is the least of its component, with their columns."""
    gone = stage_table(near_duplicates(docs, id_col, text_col, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    return docs.join(_small(gone), F.col(id_col) == F.col("__gone"), "left_anti")
