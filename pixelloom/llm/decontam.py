"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of `window` words (a shorter item is one
window). A window is the set of its shingles. The shingles are ordered by how
often they occur in all documents; as containment has to be whole, the necessary
prefix of a window is its single rarest shingle, and only documents that hold it
are candidates. A candidate's position bounds where the window would start: it
has to begin and end inside the document (positional and length bounds). What is
left is verified exactly: all shingles of the window at their places.

One pass over the texts keeps the places of benchmark shingles, which is little
unless a document copies from the benchmark; counts, join and verification work
on those places. Benchmark shingles are broadcast in blocks of at most
`block_words` words, so a benchmark of any size is joined block by block.

Defined cases: a null text has no words; an item without words never occurs; an
item of fewer words than a window is one window, and its shingles are as long as
it is where it has fewer words than a shingle; rows that repeat, in either table,
are judged each on its own and items of equal text are all reported; items
without an item_id are searched like any other and count as one item of null id,
which the digest of the ids leaves out; an empty
benchmark leaves all documents clean; only doc_id, text, item_id and text are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _text as tx
from pixelloom.llm._graph import cut

_U = np.uint64
HITS = "doc_id long, key long, n_words long, pos array<int>, shingle array<long>"
MATCHES = "doc_id long, key long, n_words long, spans array<struct<start:int,stop:int>>, items array<string>"


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the lower-cased words of the documents."""
    starts, ends, first = tx.runs(tx.ALNUM[data], at)
    return tx.span_hashes(tx.prefix_hashes(data, tx.BYTE_VALUES_LOWER), starts, ends), first


@dataclass
class Index:
    """Windows of one block of items. Window w has shingles flat[at[w]:at[w + 1]], one for each place."""

    size: np.ndarray
    flat: np.ndarray
    at: np.ndarray
    items: list[list[str | None]]
    lengths: list[int] = field(default_factory=list)

    @classmethod
    def build(cls, items: list[tuple[str | None, str]], window: int, shingle: int) -> Index:
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        words, first = words_of(*tx.bytes_of(texts))
        sizes, parts, owners, known, lengths = [], [], [], {}, set()
        for d, (item, _) in enumerate(items):
            own = words[first[d] : first[d + 1]]
            if not len(own):
                continue
            n = min(window, len(own))
            k = min(shingle, n)
            lengths.add(k)
            grams = tx.ngram_hashes(own, k)
            for s in range(len(own) - n + 1):
                part = grams[s : s + n - k + 1]
                if (w := known.get(key := (n, part.tobytes()))) is None:
                    w = known[key] = len(sizes)
                    sizes.append(n)
                    parts.append(part)
                    owners.append([])
                if not owners[w] or owners[w][-1] != item:
                    owners[w].append(item)
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, np.uint64), *parts]), at, owners, sorted(lengths))

    def prefixes(self, seen: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, window, offset), sorted by shingle: the rarest shingle of each window all of whose shingles were seen."""
        count = np.array([seen.get(x, 0) for x in self.flat.tolist()], np.int64)
        rows = [(w, a + int(np.argmin(count[a:b])), a) for w, (a, b) in enumerate(zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)) if count[a:b].min() > 0]
        if not rows:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, best, a = np.array(rows).T
        order = np.argsort(self.flat[best], kind="stable")
        return self.flat[best][order], w[order], (best - a)[order]


class Members:
    """Membership of hashes in a fixed set: a bit table first, then a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.shift = _U(64 - min(26, max(10, int(64 * len(self.keys)).bit_length())))
        self.bits = np.zeros(1 << int(64 - int(self.shift)), bool)
        self.bits[(self.keys >> self.shift).astype(np.int64)] = True

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that are in the set."""
        maybe = np.flatnonzero(self.bits[(hashes >> self.shift).astype(np.int64)])
        if not len(maybe):
            return maybe
        k = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        return maybe[self.keys[k] == hashes[maybe]]


def _lists(values: np.ndarray, owner: np.ndarray, docs: int, kind: pa.DataType) -> pa.ListArray:
    """One list for each document of the values, which are sorted by owner."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(docs + 1)), pa.int32()), pa.array(values, kind))


def _places(words: np.ndarray, first: np.ndarray, lengths: list[int], members: Members) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position among all words, shingle, document) of the shingles of the benchmark, in order of position."""
    owner = tx.owners(first, len(words))
    pos, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in lengths:
        grams = tx.ngram_hashes(words, k)
        at = members.among(grams)
        at = at[owner[at] == owner[at + k - 1]] if len(at) else at
        pos.append(at)
        found.append(grams[at])
    at, shingles = np.concatenate(pos), np.concatenate(found)
    order = np.argsort(at, kind="stable")
    at, shingles = at[order], shingles[order]
    return at, shingles, owner[at] if len(at) else np.zeros(0, np.int64)


def _find_shingles(docs: DataFrame, shared) -> DataFrame:
    """A row of HITS for each row of docs (doc_id, text, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, members = shared.value
        for chunk in tx.chunks(batches):
            words, first = words_of(*tx.bytes_of(chunk.column(1)))
            pos, found, doc = _places(words, first, lengths, members)
            n = chunk.num_rows
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), chunk.column(2), pa.array(np.diff(first), pa.int64()), _lists(pos - first[doc], doc, n, pa.int32()), _lists(found.view(np.int64), doc, n, pa.int64())],
                ["doc_id", "key", "n_words", "pos", "shingle"],
            )

    return docs.mapInArrow(run, HITS)


def verify(n_words: np.ndarray, pos: np.ndarray, shingle: np.ndarray, doc: np.ndarray, index: Index, prefixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, window) of each occurrence, from the places of shingles, which are sorted by doc and pos."""
    heads, windows, offsets = prefixes
    lo, hi = np.searchsorted(heads, shingle, "left"), np.searchsorted(heads, shingle, "right")
    many = hi - lo
    hit = np.repeat(np.arange(len(pos)), many)
    row = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many) + lo[hit]
    window = windows[row]
    start = pos[hit] - offsets[row]
    own = doc[hit]
    good = (start >= 0) & (start + index.size[window] <= n_words[own])
    window, start, own = window[good], start[good], own[good]
    # places of one document and position lie side by side: one for each shingle length at most
    place = (doc << 32) | pos
    parts = np.diff(index.at)[window]
    most = int(parts.max()) if len(parts) else 0
    for j in range(most):
        todo = parts > j
        want = index.flat[np.minimum(index.at[window] + j, len(index.flat) - 1)]
        key = (own << 32) | (start + j)
        a, b = np.searchsorted(place, key, "left"), np.searchsorted(place, key, "right")
        match = ~todo
        for step in range(int((b - a).max()) if len(a) else 0):
            k = np.minimum(a + step, len(place) - 1)
            match |= (a + step < b) & (shingle[k] == want)
        window, start, own, parts = window[match], start[match], own[match], parts[match]
    return own, start, window


def _join_windows(hits: DataFrame, shared) -> DataFrame:
    """A row of MATCHES for each row of HITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, prefixes = shared.value
        for batch in batches:
            n = batch.num_rows
            n_words = batch.column(2).to_numpy(zero_copy_only=False)
            places, shingles = batch.column(3), batch.column(4)
            doc = np.repeat(np.arange(n), np.diff(places.offsets.to_numpy()))
            own, start, window = verify(n_words, places.flatten().to_numpy().astype(np.int64), shingles.flatten().to_numpy().view(np.uint64), doc, index, prefixes)
            stop = start + index.size[window]
            order = np.lexsort((stop, start, own))
            own, start, stop, window = own[order], start[order], stop[order], window[order]
            # touching and overlapping occurrences become one span
            far = np.maximum.accumulate((own << 32) | stop) if len(own) else own
            fresh = np.ones(len(own), bool)
            fresh[1:] = ((own[1:] << 32) | start[1:]) > far[:-1]
            head = np.flatnonzero(fresh)
            last = np.append(head[1:], len(own))[: len(head)] - 1
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(own[head], np.arange(n + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(start[head], pa.int32()), pa.array(far[last] & 0xFFFFFFFF, pa.int32())], ["start", "stop"]),
            )
            items: list[list[str | None]] = [[] for _ in range(n)]
            for d, w in np.unique(np.stack([own, window], 1), axis=0).tolist():
                items[d] += index.items[w]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), spans, pa.array([sorted(set(x), key=lambda i: (i is None, i or "")) for x in items], pa.list_(pa.string()))], ["doc_id", "key", "n_words", "spans", "items"])

    return hits.mapInArrow(run, MATCHES)


def _null_last(row: tuple[str | None, str]) -> tuple[bool, str, str]:
    return row[0] is None, row[0] or "", row[1]


def _blocks(benchmark: DataFrame, block_words: int) -> int:
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-int(size) // (2 * block_words)))  # a word and what parts it have two characters at least


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block_words: int = 200_000) -> DataFrame:
    """(doc_id, key, n_words, spans, items) of each row of docs: the word ranges [start, stop) that windows cover, in order, and the item_ids.

    key stands for the row's text (0 for all rows where the benchmark is one block).
    """
    items = benchmark.selectExpr("cast(item_id as string) item_id", "text").where("text is not null")
    blocks = _blocks(items, block_words)
    key = F.lit(0).cast("long") if blocks == 1 else F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"))
    context = docs.sparkSession.sparkContext
    found = None
    for block in range(blocks):
        # bounded by block_words
        rows = sorted(((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()), key=_null_last)
        index = Index.build(rows, window, shingle)
        hits = cut(_find_shingles(docs, context.broadcast((index.lengths, Members(index.flat)))))
        counts = hits.where("size(shingle) > 0").select(F.explode("shingle").alias("s")).groupBy("s").count()
        seen = {r.s & (2**64 - 1): r["count"] for r in counts.collect()}  # of the block's shingles only
        part = _join_windows(hits, context.broadcast((index, index.prefixes(seen))))
        found = part if found is None else found.union(part)
    if blocks == 1:
        return found
    # one row for each row of docs again: equal rows have equal matches, so one stands for all of them and is counted
    merged = found.groupBy("doc_id", "key").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        (F.count("*") / blocks).cast("long").alias("copies"),
    )
    # doc_id and key repeat in no more rows than the document itself does
    each = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")
    return merged.select("doc_id", "key", "n_words", _merged("spans").alias("spans"), F.array_sort("items").alias("items"), each).drop("copy")


def _merged(spans: str):
    """Sorted spans, those that touch made one."""

    def step(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.named_struct(F.lit("start"), last["start"], F.lit("stop"), F.greatest(last["stop"], span["stop"]))
        return F.when((F.size(done) > 0) & (last["stop"] >= span["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.expr("cast(array() as array<struct<start:int,stop:int>>)"), step)


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """Counts and digests of matches(), a row for each row of docs."""
    found = matches(docs, benchmark, window, shingle)
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"]).cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block_words: int = 200_000) -> DataFrame:
    """docs without the rows in which a window of the benchmark occurs; all columns stay. Reads the texts twice: for the counts, then for the join."""
    items = benchmark.selectExpr("cast(item_id as string) item_id", "text").where("text is not null")
    context = docs.sparkSession.sparkContext
    place = docs.columns.index("text")
    blocks = _blocks(items, block_words)
    for block in range(blocks):
        rows = sorted(((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()), key=_null_last)  # bounded by block_words
        index = Index.build(rows, window, shingle)
        members = Members(index.flat)
        hits = _find_shingles(docs.select(F.lit(0).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("key")), context.broadcast((index.lengths, members)))
        counts = hits.where("size(shingle) > 0").select(F.explode("shingle").alias("s")).groupBy("s").count()
        seen = {r.s & (2**64 - 1): r["count"] for r in counts.collect()}  # of the block's shingles only
        docs = docs.mapInArrow(_keeping(place, context.broadcast((index, members, index.prefixes(seen)))), docs.schema)
    return docs


def _keeping(place: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, members, prefixes = shared.value
        for chunk in tx.chunks(batches):
            words, first = words_of(*tx.bytes_of(chunk.column(place)))
            pos, found, doc = _places(words, first, index.lengths, members)
            own, _, _ = verify(np.diff(first), pos - first[doc], found, doc, index, prefixes)
            keep = np.ones(chunk.num_rows, bool)
            keep[own] = False
            yield chunk.filter(pa.array(keep))

    return run
