"""SimHash near-duplicates by a binary trie self-join.

Each document has a 64-bit fingerprint of its word shingles. Two fingerprints
link if they differ in at most `budget` bits; documents are grouped by the
links' connected components.

The trie over the distinct fingerprints is joined with itself: pairs of nodes go
down together, differing bits add up, and a pair is dropped once it exceeds the
budget. To deal the trie out, the bits are cut into budget + 1 blocks. Two linked
fingerprints agree in one block at least, so for each block the bits are rotated
such that the block comes first and every subtree below it is joined with itself
on its own. A subtree with more than `hot` fingerprints is cut again by blocks of
its remaining bits, level by level, which bounds the largest subtree by the bits
that are left rather than by the data. A task returns a spanning forest of the
links in its subtrees, not the links, so output stays linear in the fingerprints.

Defined cases: null and empty texts have fingerprint zero, linked like any
other; texts shorter than a shingle are one shingle; rows that repeat share a
fingerprint and a component; an empty table gives an empty result; only doc_id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _text as tx
from pixelloom.llm._graph import checked_join, components, cut, spread_join

_U = np.uint64
#: The bits of a byte as eight counters of eight bits.
_LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)
#: Node pairs that are expanded at once.
FRONTIER = 1 << 16
#: Node pairs with at most so many fingerprint pairs are compared directly.
LEAF = 32
#: Fingerprint pairs that are compared at once.
PAIRS = 1 << 19


def shingle_hashes(data: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all shingles: A-Z lower-cased, words cut at ASCII white space, XXH64 with seed 42."""
    docs = len(at) - 1
    data = tx.LOWER[data]
    member = ~tx.SPACE[data]
    starts, ends, first = tx.runs(member, at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    # the words joined by single spaces
    size = ends - starts
    new_end = np.cumsum(size + 1) - 1
    new_start = new_end - size
    joined = np.full(int(new_end[-1]) + 1, 0x20, np.uint8)
    joined[np.flatnonzero(_marks(new_start, new_end, len(joined)))] = data[member]
    count = np.diff(first)
    shingles = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    sh_first = np.concatenate([[0], np.cumsum(shingles)])
    doc = np.repeat(np.arange(docs), shingles)
    begin = first[doc] + np.arange(sh_first[-1]) - sh_first[doc]
    last = np.minimum(begin + shingle, first[doc + 1]) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[s:e], 42) for s, e in zip(new_start[begin].tolist(), new_end[last].tolist(), strict=True)), np.uint64, len(begin))
    return hashes, sh_first


def fingerprints(data: np.ndarray, at: np.ndarray, shingle: int) -> np.ndarray:
    """SimHash of each document, of 64 bits."""
    return majority(*shingle_hashes(data, at, shingle))


#: 64-bit words of a wide fingerprint.
WIDE = 6


def shingle_sets(data: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_hashes() without repeats in a document, sorted in each."""
    hashes, first = shingle_hashes(data, at, shingle)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[fresh], np.searchsorted(doc[fresh], np.arange(len(first)))


def wide_fingerprints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of each document's set of shingles, of 64 * WIDE bits: each word votes with the hashes mixed anew."""
    return np.stack([majority(tx.mix(hashes + _U(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) if k else hashes, first) for k in range(WIDE)], 1)


def _marks(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    return np.cumsum(step[:n], dtype=np.int8) > 0


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group of hashes the bits that are set in over half of them; zero for an empty group."""
    groups = len(first) - 1
    out = np.zeros(groups, np.uint64)
    count = np.diff(first)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    # blocks of at most 255, so that a counter of eight bits holds
    blocks = -(-count[full] // 255)
    of = np.repeat(np.arange(len(full)), blocks)
    block_first = np.cumsum(blocks) - blocks
    begin = first[full][of] + 255 * (np.arange(len(of)) - block_first[of])
    columns = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        packed = np.add.reduceat(_LANES[columns[:, byte]], begin)
        counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), block_first, axis=0)
        bits = (2 * counts > count[full][:, None]).astype(np.uint64)
        out[full] |= (bits << np.arange(8, dtype=np.uint64)).sum(1, dtype=np.uint64) << _U(8 * byte)
    return out


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_links(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int, top: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys that differ in at most `budget` bits, within each subtree.

    A subtree is a range [lo, hi) of keys that are sorted, distinct, and equal above its bit `top`. Every node of the
    trie is such a range.
    """
    root = hi - lo > 1
    lo, hi, top = lo[root], hi[root], top[root]
    stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int64), top)]
    while stack:
        a0, a1, b0, b1, diff, bit = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [tuple(x[:half] for x in (a0, a1, b0, b1, diff, bit)), tuple(x[half:] for x in (a0, a1, b0, b1, diff, bit))]
            continue
        work = (a1 - a0) * (b1 - b0)
        big = (bit < 0) & (work > PAIRS)
        if big.any():  # equal keys: halves by place, for memory
            stack += _quarters(*(x[big] for x in (a0, a1, b0, b1, diff, bit)))
            a0, a1, b0, b1, diff, bit, work = (x[~big] for x in (a0, a1, b0, b1, diff, bit, work))
        leaf = (work <= LEAF) | (bit < 0)
        if leaf.any() and work[leaf].sum() > 4 * PAIRS and leaf.sum() > 1:
            half = len(a0) // 2
            stack += [tuple(x[:half] for x in (a0, a1, b0, b1, diff, bit)), tuple(x[half:] for x in (a0, a1, b0, b1, diff, bit))]
            continue
        if leaf.any():
            x0, xn, y0, yn = a0[leaf], (a1 - a0)[leaf], b0[leaf], (b1 - b0)[leaf]
            size = xn * yn
            stop = np.cumsum(size)
            pair = np.repeat(np.arange(len(size)), size)
            k = np.arange(stop[-1]) - (stop - size)[pair]
            left, right = x0[pair] + k // yn[pair], y0[pair] + k % yn[pair]
            near = (left < right) & (popcount(keys[left] ^ keys[right]) <= budget)
            if near.any():
                yield left[near], right[near]
        down = ~leaf
        if not down.any():
            continue
        a0, a1, b0, b1, diff, bit = (x[down] for x in (a0, a1, b0, b1, diff, bit))
        am, bm = _halves(keys, a0, a1, bit), _halves(keys, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        bit = bit - 1
        parts = []
        for p0, p1, q0, q1, more, keep in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
            good = (p1 > p0) & (q1 > q0) & (diff + more <= budget)
            if keep is not None:
                good &= keep
            if more == 0:  # a node of one key with itself
                good &= ~(same & (p1 - p0 < 2))
            if good.any():
                parts.append((p0[good], p1[good], q0[good], q1[good], diff[good] + more, bit[good]))
        if parts:
            stack.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))


def _quarters(a0, a1, b0, b1, diff, bit) -> list[tuple[np.ndarray, ...]]:
    """Pairs of halves of pairs of nodes; of a node with itself, the two halves with themselves and with each other."""
    am, bm = (a0 + a1) // 2, (b0 + b1) // 2
    same = (a0 == b0) & (a1 == b1)
    out = [(a0, am, b0, bm, diff, bit), (a0, am, bm, b1, diff, bit), (am, a1, bm, b1, diff, bit)]
    other = ~same
    return [*out, tuple(x[other] for x in (am, a1, b0, bm, diff, bit))] if other.any() else out


def _halves(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the keys of each node whose bit is set begin (binary search in all nodes at once)."""
    lo, hi = lo.copy(), hi.copy()
    mask = _U(1) << bit.astype(np.uint64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        one = (keys[mid] & mask[open_]) != 0
        hi[open_[one]] = mid[one]
        lo[open_[~one]] = mid[~one] + 1


class Forest:
    """Least index of each linked set."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        while True:
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        r = up[x]
        while True:
            s = up[r]
            if np.array_equal(s, r):
                break
            r = s
        up[x] = r
        return r


def _blocks(bits: int, n: int) -> list[int]:
    return [bits // n + (i < bits % n) for i in range(n)]


def _rotated(df: DataFrame, bits: int, budget: int) -> DataFrame:
    """For each block of the lowest `bits` bits of column `key`, a row in which that block has moved above the others.

    head gets the block's number and value, and what head was before.
    """
    rows, low = [], 0
    for i, size in enumerate(_blocks(bits, budget + 1)):
        # rotate the lowest `bits` bits left so that [low, low + size) ends on top
        turn = bits - low - size
        whole = (1 << bits) - 1 if bits < 64 else -1
        key = F.col("key").bitwiseAND(F.lit(whole))
        up = F.shiftleft(key, turn).bitwiseAND(F.lit(whole)) if turn else key
        down = F.shiftrightunsigned(key, bits - turn) if turn else F.lit(0).cast("long")
        spun = up.bitwiseOR(down)
        rows.append(F.struct(F.xxhash64("head", F.lit(i), F.shiftrightunsigned(spun, bits - size)).alias("head"), spun.alias("key"), F.lit(bits - size).alias("left")))
        low += size
    return df.select("fp", F.explode(F.array(*rows)).alias("r")).select("fp", "r.head", "r.key", "r.left")


def _join_subtrees(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None

        def links(heads: np.ndarray, keys: np.ndarray, fps: np.ndarray, left: np.ndarray):
            begin = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
            forest = Forest(len(keys))
            for a, b in trie_links(keys, begin, np.append(begin[1:], len(heads)), budget, left[begin].astype(np.int64) - 1):
                forest.add(a, b)
            every = np.arange(len(keys))
            root = forest.roots(every)
            child = root != every
            if child.any():
                yield pa.RecordBatch.from_arrays([pa.array(fps[root[child]]), pa.array(fps[child])], ["a", "b"])

        for batch in batches:
            head, key, fp, left = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            now = (head, key.view(np.uint64), fp, left)
            kept = now if kept is None else tuple(np.concatenate(x) for x in zip(kept, now, strict=True))
            # the last subtree may go on in the next batch
            last = int(np.searchsorted(kept[0], kept[0][-1]))
            if last:
                yield from links(*(x[:last] for x in kept))
                kept = tuple(x[last:] for x in kept)
        if kept is not None and len(kept[0]):
            yield from links(*kept)

    return run


def link_forest(distinct: DataFrame, budget: int = 2, hot: int = 20_000) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (column fp, long) which link, directly or over others."""
    todo = distinct.select("fp", F.lit(0).cast("long").alias("head"), F.col("fp").alias("key"), F.lit(64).alias("left"))
    bits, found = 64, None
    while True:
        level = cut(_rotated(todo, bits, budget))
        size = level.groupBy("head").agg(F.count("*").alias("n")).where("n > 1")
        crowded = size.where(F.col("n") > hot)
        left = bits - min(_blocks(bits, budget + 1))
        more = left > 20 and crowded.limit(1).count() > 0
        ready = level.join(size.where(F.col("n") <= hot) if more else size, "head", "left_semi")
        ready = ready.select("head", "key", "fp", F.col("left").cast("int").alias("left"))
        found = ready if found is None else found.union(ready)
        if not more:
            break
        # blocks of one level may differ by a bit in size; the larger rest serves all
        todo, bits = level.join(crowded, "head", "left_semi").select("fp", "head", "key"), left
    spread = found.repartition("head").sortWithinPartitions("head", "key")
    return spread.mapInArrow(_join_subtrees(budget), "a long, b long")


def fingerprint_documents(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Rows of docs (text, and columns of type long) with fp, the text's fingerprint, in place of text."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            found = fingerprints(*tx.bytes_of(chunk.column(0)), shingle)
            yield pa.RecordBatch.from_arrays([*(chunk.column(i + 1) for i in range(len(names))), pa.array(found.view(np.int64))], [*names, "fp"])

    return docs.select("text", *names).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, hot: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs; component_id is the least doc_id that links reach."""
    return _grouped(docs.selectExpr("cast(doc_id as long) doc_id", "text"), shingle, budget, hot).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, shingle: int, budget: int, hot: int) -> DataFrame:
    prints = cut(fingerprint_documents(docs, shingle))
    # equal fingerprints are one node, however many rows have them
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(link_forest(nodes.select("fp"), budget, hot))
    labelled = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low", F.col("n").alias("rows")))
    least = cut(labelled.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")))
    named = cut(spread_join(labelled, least, "root").select("fp", "component_id", F.col("rows").alias("n")))
    return spread_join(prints, named, "fp")


# groups by similarity, over wide fingerprints

#: Bands of 32 bits in which the trie is joined, and the bits that two prints may differ by in one.
BANDS, BAND_BUDGET = 12, 3


def most_bits(similarity: float) -> int:
    """Bits of wide prints by which two texts of a Jaccard similarity differ, plus three standard deviations: candidates are verified."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    n = 64 * WIDE
    return int(n * share + 3 * np.sqrt(n * share * (1 - share)))


def _wide_documents(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows of docs (text, and columns of type long) with print, and fp, a hash of the text's set of shingles, in place of text."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            hashes, first = shingle_sets(*tx.bytes_of(chunk.column(0)), shingle)
            rows = [r.tobytes() for r in wide_fingerprints(hashes, first)]
            fps = tx.sums(tx.mix(hashes + _U(1)).view(np.int64), first)
            yield pa.RecordBatch.from_arrays([*(chunk.column(i + 1) for i in range(len(names))), pa.array(rows, pa.binary()), pa.array(fps)], [*names, "print", "fp"])

    return docs.select("text", *names).mapInArrow(run, ", ".join([*(f"{c} long" for c in names), "print binary", "fp long"]))


#: Bits of the blocks by which a band is dealt, level by level. Two words of a band that differ in BAND_BUDGET bits at the most agree in a block of each level.
LEVELS = ((8, 8, 8, 8), (6, 6, 6, 6), (5, 5, 4, 4))


def heads_of(words: np.ndarray, band: int, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(parent heads, heads) of the words of a band, for each choice of blocks down to the level. The lowest four bits of a head are its band."""

    def down(head: np.ndarray, rest: np.ndarray, bits: int, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        turn = 0
        for k, size in enumerate(LEVELS[at]):
            spun = ((rest << _U(turn)) | (rest >> _U(bits - turn))) & _U((1 << bits) - 1) if turn else rest
            turn += size
            value = tx.mix(head + _U(k + 1) + (spun >> _U(bits - size) << _U(8)))
            value = value & ~_U(15) | _U(band)
            if at == level:
                yield head, value
            else:
                yield from down(value, spun & _U((1 << bits - size) - 1), bits - size, at + 1)

    yield from down(np.full(len(words), band, np.uint64), words, 32, 0)


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _dealt(nodes: DataFrame, level: int, parents, crowded, want: str) -> DataFrame:
    """Rows of the nodes (fp, print) at a level, below the heads that are crowded one level up.

    parents and crowded are broadcast arrays (parents None: all). want: "heads" gives (head); "rows" gives (head, fp,
    print) of heads that aren't crowded; "crowds" gives (head, fp) of those that are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                n = batch.num_rows
                words = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, 2 * WIDE).astype(np.uint64)
                heads, take = [], []
                for band in range(BANDS):
                    for parent, head in heads_of(words[:, band], band, level):
                        keep = np.ones(n, bool) if parents is None else _member(parent, parents.value)
                        if want != "heads":
                            keep &= _member(head, crowded.value) == (want == "crowds")
                        heads.append(head[keep])
                        take.append(np.flatnonzero(keep))
                head = pa.array(np.concatenate(heads).view(np.int64))
                take = pa.array(np.concatenate(take))
                if want == "heads":
                    yield pa.RecordBatch.from_arrays([head], ["head"])
                elif want == "crowds":
                    yield pa.RecordBatch.from_arrays([head, batch.column(0).take(take)], ["head", "fp"])
                else:
                    yield pa.RecordBatch.from_arrays([head, batch.column(0).take(take), batch.column(1).take(take)], ["head", "fp", "print"])

    return nodes.select("fp", "print").mapInArrow(run, {"heads": "head long", "crowds": "head long, fp long", "rows": "head long, fp long, print binary"}[want])


def _join_bands(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_heads(batches):
            rows = rows.combine_chunks()
            heads, fps = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            prints = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint64).reshape(len(heads), WIDE)
            keys = prints.view(np.uint32)[np.arange(len(heads)), heads & 15].astype(np.uint64)
            order = np.lexsort((keys, heads))
            heads, fps, prints, keys = heads[order], fps[order], prints[order], keys[order]
            begin = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
            forest = Forest(len(keys))
            for a, b in trie_links(keys, begin, np.append(begin[1:], len(heads)), BAND_BUDGET, np.full(len(begin), 31, np.int64)):
                # those that are together already need no comparison
                apart = forest.roots(a) != forest.roots(b)
                a, b = a[apart], b[apart]
                near = popcount(prints[a] ^ prints[b]).sum(1, dtype=np.int64) <= limit
                forest.add(a[near], b[near])
            every = np.arange(len(keys))
            root = forest.roots(every)
            child = root != every
            if child.any():
                yield pa.RecordBatch.from_arrays([pa.array(fps[root[child]]), pa.array(fps[child])], ["a", "b"])

    return run


def _whole_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by head (column 0), in tables that hold all rows of their heads."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = batch.column(0).to_numpy()
        last = int(np.searchsorted(heads, heads[-1]))
        if last or (kept and kept[-1].column(0)[-1].as_py() != heads[0]):
            yield pa.Table.from_batches([*kept, batch.slice(0, last)] if last else kept)
            kept = []
        kept.append(batch.slice(last))
    if kept:
        yield pa.Table.from_batches(kept)


#: Crowded heads that the driver takes of a level; where there are more, all heads of the level are dealt further.
CROWDS = 2_000_000


def similar_forest(nodes: DataFrame, limit: int, hot: int = 50_000) -> DataFrame:
    """Edges (a, b) that connect the nodes (fp, print) whose prints differ in at most `limit` bits and in at most BAND_BUDGET bits of some band.

    Each band's trie is dealt by blocks of LEVELS: a node goes to the subtree of each of its blocks, and a subtree of
    more than `hot` nodes is dealt further by blocks of its remaining bits, so that subtrees become narrower as the data
    grows and no row is repeated for pairs of pieces. What is still crowded at the last level are prints that agree in 18
    bits of a band and more: they are linked without a comparison, for links are candidates that are verified.
    """
    nodes = cut(nodes)
    spark = nodes.sparkSession
    rows, edges, parents = None, None, None
    for level in range(len(LEVELS)):
        sizes = cut(_dealt(nodes, level, parents, None, "heads").groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") > hot))
        n = sizes.count()
        last = level == len(LEVELS) - 1
        if n > CROWDS and not last:
            parents = None
            continue
        found = np.sort(np.array([r["head"] for r in sizes.select("head").collect()] if n <= CROWDS else [], np.int64).view(np.uint64))
        crowded = spark.sparkContext.broadcast(found)
        own = _dealt(nodes, level, parents, crowded, "rows")
        rows = own if rows is None else rows.union(own)
        if not n:
            break
        if last:
            crowds = cut(_dealt(nodes, level, parents, crowded, "crowds"))
            # as many rows as crowded heads
            edges = crowds.join(F.broadcast(cut(crowds.groupBy("head").agg(F.min("fp").alias("a")))), "head").select("a", F.col("fp").alias("b")).where("a <> b").distinct()
        parents = crowded
    links = rows.repartition("head").sortWithinPartitions("head").mapInArrow(_join_bands(limit), "a long, b long")
    return links if edges is None else links.union(edges)


def jaccard_forest(flat: np.ndarray, at: np.ndarray, parts: np.ndarray, similarity: float, known: np.ndarray | None = None, pivots: np.ndarray | None = None) -> Forest:
    """Forest of the sets flat[at[i]:at[i + 1]] in which each pair of at least the similarity is linked; of a pair of pieces, pairs across.

    known: labels of sets that are together already where they are equal. pivots: only pairs with these sets are wanted.

    Common shingles are counted exactly, over lists of the sets that hold a shingle; sets that are together already are not compared.
    """
    n = len(at) - 1
    size = np.diff(at)
    _, ids, count = np.unique(flat, return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(n), size)[np.argsort(ids, kind="stable")]
    stop = np.cumsum(count)
    forest, every = Forest(n), np.arange(n)
    if known is not None:
        order = np.argsort(known, kind="stable")
        same = known[order[1:]] == known[order[:-1]]
        forest.add(order[1:][same], order[:-1][same])
    for i in range(n - 1) if pivots is None else np.flatnonzero(pivots).tolist():
        roots = forest.roots(every)
        low, high = np.minimum(size, size[i]), np.maximum(size, size[i])
        other = ((every > i) if pivots is None else (every != i)) & (roots != roots[i]) & (low >= similarity * high - 1e-9)
        if parts[i] >= 0:
            other &= parts != parts[i]
        other = np.flatnonzero(other)
        if not len(other):
            continue
        own = ids[at[i] : at[i + 1]]
        many = count[own]
        place = np.arange(many.sum()) + np.repeat(stop[own] - np.cumsum(many), many)
        common = np.bincount(holders[place], minlength=n)[other]
        near = other[common >= similarity * (size[i] + size[other] - common) - 1e-9]
        forest.add(np.full(len(near), i), near)
    return forest


def _verify(similarity: float):
    """Edges of rows (head, part, fp, known, pivot, shingles) by heads; see jaccard_forest()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_heads(batches):
            rows = rows.combine_chunks()
            heads, parts, fps, known, pivots = (rows.column(i).to_numpy() for i in range(5))
            begin = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(heads)], strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in rows.column(5).slice(a, b - a).to_pylist()]
                at = np.cumsum([0, *map(len, sets)])
                only = pivots[a:b] > 0
                root = jaccard_forest(np.concatenate(sets), at, parts[a:b], similarity, known[a:b], only if only.any() else None).roots(np.arange(b - a))
                child = root != np.arange(b - a)
                if child.any():
                    own = fps[a:b]
                    yield pa.RecordBatch.from_arrays([pa.array(own[root[child]]), pa.array(own[child])], ["a", "b"])

    return run


def _set_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """(root, fp, shingles) of rows (text, root, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            hashes, first = shingle_sets(*tx.bytes_of(chunk.column(0)), shingle)
            rows = [hashes[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column(1), chunk.column(2), pa.array(rows, pa.binary())], ["root", "fp", "shingles"])

    return docs.select("text", "root", "fp").mapInArrow(run, "root long, fp long, shingles binary")


#: Texts of a candidate group that one task takes, and pieces of a larger group before its pieces grow to LARGEST texts.
GROUP, PIECES, LARGEST = 250, 64, 20_000
#: Pivots of a larger group, about.
PIVOTS = 12


def _pieces(n, group: int):
    return F.ceil(n / F.least(F.greatest(F.lit(group), n / PIECES), F.greatest(F.lit(group), F.lit(LARGEST)))).cast("int")


def _verified(rows: DataFrame, similarity: float) -> DataFrame:
    rows = rows.select("head", F.col("part").cast("int").alias("part"), "fp", "known", F.col("pivot").cast("int").alias("pivot"), "shingles")
    return rows.repartition("head").sortWithinPartitions("head").mapInArrow(_verify(similarity), "a long, b long")


def verified_forest(sets: DataFrame, similarity: float, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect the nodes (root, fp, shingles) of equal root which have at least the similarity.

    All pairs of a root are covered. A root of more than `group` nodes is first compared with some pivots of it, which
    brings most nodes of a true group together in time with its size. Its largest part is then one: only pairs with a
    node that isn't in it are left, and they are dealt out by pairs of pieces, each a task of its own.
    """
    sets = cut(sets)
    size = cut(sets.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > group))
    plain = (F.lit(-1).alias("part"), "fp", F.col("fp").alias("known"), F.lit(0).alias("pivot"), "shingles")
    if size.limit(1).count() == 0:
        return _verified(sets.select(F.col("root").alias("head"), *plain), similarity)
    # roots of more than `group` nodes only
    small = sets.join(F.broadcast(size), "root", "left_anti").select(F.col("root").alias("head"), *plain)
    large = sets.join(F.broadcast(size), "root").withColumn("pieces", _pieces(F.col("n"), group))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("pieces")).cast("int")
    pivots = F.pmod(F.xxhash64("fp", F.lit(2)), F.ceil(F.col("n") / PIVOTS)) == 0
    stars = large.where(~pivots).withColumn("piece", own).withColumn("pivot", F.lit(0))
    stars = stars.unionByName(large.where(pivots).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("pivot", F.lit(1)))
    near = cut(_verified(stars.select(F.xxhash64("root", "piece").alias("head"), F.lit(-1).alias("part"), "fp", F.col("fp").alias("known"), "pivot", "shingles"), similarity))
    linked = components(near).withColumnRenamed("node", "fp").withColumnRenamed("root", "known")
    labelled = cut(large.select("root", "fp", "n").join(linked, "fp", "left").select("root", "fp", "n", F.coalesce("known", "fp").alias("known")))
    parts = labelled.groupBy("root", "known").agg(F.count("*").alias("in_part"))
    most = cut(parts.groupBy("root").agg(F.max_by("known", "in_part").alias("main"), F.max("in_part").alias("in_main")))
    rest = labelled.join(F.broadcast(most), "root").where("n > in_main")
    rest = rest.select("root", "fp", "known", "main", _pieces(F.col("n") - F.col("in_main"), group).alias("r"), _pieces(F.col("in_main"), group).alias("c"))
    # pieces 0 to r - 1 are of nodes outside the main part, r to r + c - 1 of those in it, which need no comparison among themselves
    outside = F.col("known") != F.col("main")
    piece = F.when(outside, F.pmod(F.xxhash64("fp", F.lit(3)), F.col("r"))).otherwise(F.col("r") + F.pmod(F.xxhash64("fp", F.lit(3)), F.col("c")))
    rest = rest.withColumn("piece", piece.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(outside, F.col("r") + F.col("c")).otherwise(F.col("r")) - 1)))
    rest = rest.join(sets.select("fp", "shingles"), "fp")
    head = F.xxhash64("root", F.least("piece", "other"), F.greatest("piece", "other"))
    part = F.when(F.col("piece") == F.col("other"), -1).otherwise(F.col("piece"))
    pairs = rest.select(head.alias("head"), part.alias("part"), "fp", "known", F.lit(0).alias("pivot"), "shingles")
    return _verified(small.unionByName(pairs), similarity).union(near)


def _gone(docs: DataFrame, shingle: int, similarity: float, hot: int, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, digest, text): (doc_id, digest) of those that stand for no group, and of those on several rows."""
    prints = cut(_wide_documents(docs, shingle))
    # texts of equal sets are one node, and one of its rows stands for it
    nodes = cut(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "digest")).alias("low"), F.first("print").alias("print"), F.count("*").alias("n")))
    loose = components(similar_forest(nodes.select("fp", "print"), most_bits(similarity), hot))
    members = cut(nodes.join(loose.withColumnRenamed("node", "fp"), "fp").select("low.doc_id", "low.digest", "fp", "root"))
    doubled = cut(prints.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "digest"))
    texts = checked_join(docs, members, ["doc_id", "digest"], "inner")
    if doubled.limit(1).count():  # rows that repeat
        texts = texts.dropDuplicates(["fp"])
    roots = components(verified_forest(_set_rows(texts, shingle), similarity, group))
    # nodes that stand alone, on one row, stay and need no name
    named = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").where("root is not null or n > 1").select(F.coalesce("root", "fp").alias("root"), "fp", "low", F.col("n").alias("rows")))
    least = cut(named.groupBy("root").agg(F.min("low").alias("least"), F.count("*").alias("n")))
    named = cut(spread_join(named, least, "root").select("fp", "least", F.col("rows").alias("n")))
    rows = cut(spread_join(prints.select("doc_id", "digest", "fp"), named, "fp"))
    stays = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("digest") == F.col("least.digest"))
    return cut(rows.where(~stays).select("doc_id", "digest").distinct()), doubled


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, hot: int = 50_000) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the least doc_id (of the least hash of its text where ids repeat); all columns stay.

    Two texts link if the Jaccard similarity of their sets of shingles is at least `similarity`, and links are closed
    transitively. Candidates come from wide fingerprints: the similarity stands for a number of bits, and the trie is
    joined in BANDS bands of 32 bits. Every pair of a group of candidates is then verified exactly on its shingles. A
    pair at the similarity becomes a candidate by itself with a probability of about 0.97, one of 0.9 or more with over
    0.9999; equal texts always do. A row without a doc_id counts with a negative number made
    of its text.
    """
    digest = F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))
    number = F.coalesce(F.col("doc_id").cast("long"), -F.shiftrightunsigned(digest, 1) - 1)
    gone, repeated = _gone(docs.select(number.alias("doc_id"), digest.alias("digest"), "text"), shingle, similarity, hot)
    keys = ["number", "digest"]
    # the row is packed, so that its columns may have any names; texts are not shuffled as long as the list of those that go can be broadcast
    packed = docs.select(number.alias("number"), digest.alias("digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = checked_join(packed, gone.toDF(*keys), keys, "left_anti")
    if repeated.limit(1).count() == 0:
        return kept.select("row.*")
    # equal rows: one of each stays
    once = checked_join(kept, repeated.toDF(*keys), keys, "left_anti")
    again = checked_join(kept, repeated.toDF(*keys), keys, "left_semi").dropDuplicates(keys)
    return once.select("row.*").unionByName(again.select("row.*"))
