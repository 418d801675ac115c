"""Byte-level BPE encoding and decoding over rank files.

Encoding has two tiers. Pre-tokens are cut for a whole chunk of texts with numpy
and each distinct one is looked up once. A minimal perfect hash over the
vocabulary (hash and displace, one slot for each entry, the entry's bytes
compared on a hit) resolves the pre-tokens that are vocabulary entries; the rest
go through merges kept in a heap over linked bytes.

Defined cases: a null text is an empty text, and an empty text has no ids; a
pre-token of any length is merged in n log n steps; rows that repeat are encoded
each on its own; an empty table gives an empty result; only doc_id and text are
read, so other columns may have any name. A vocabulary in which two entries share a
64-bit hash doesn't load.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pixelloom.llm import _text as tx

_U = np.uint64
OTHER, LETTER, NUMBER, BLANK = range(4)
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The contractions that the split pattern cuts after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point, for the split pattern."""
    global _classes
    if _classes is None:
        found = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
                found[a:b] = kind
        found[WHITE_SPACE] = BLANK
        _classes = found
    return _classes


def pretokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, first): byte offsets at which the matches of the split pattern start (they tile the text), and each document's first match."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) == n:
        code = data
    else:
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[code]
    m = len(lead)
    bounds = np.searchsorted(lead, at)
    edge = np.zeros(m + 1, bool)
    edge[bounds] = True
    new = np.ones(m, bool)
    new[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], m)
    of = kind[start]
    mark = np.zeros(m + 1, bool)
    # a blank run leaves its last character to what follows; at the end of a text it stays whole
    blank = of == BLANK
    mark[start[blank]] = True
    follows = blank & ~edge[end]
    mark[end[follows] - 1] = True
    # other runs start at a space before them
    solid = start[~blank]
    spaced = np.zeros(len(start), bool)
    spaced[~blank] = ~edge[solid] & (code[np.maximum(solid, 1) - 1] == 0x20)
    mark[start[~blank & ~spaced]] = True
    # contractions: a lone apostrophe without a space before it, then letters
    lone = np.flatnonzero((of[:-1] == OTHER) & (end[:-1] - start[:-1] == 1) & ~spaced[:-1] & (code[start[:-1]] == 0x27) & (of[1:] == LETTER) & ~edge[start[1:]])
    for i in lone.tolist():
        s, e = int(start[i + 1]), int(end[i + 1])
        head = "".join(map(chr, code[s : min(e, s + 2)].tolist()))
        for c in CONTRACTIONS:
            if head.startswith(c):
                mark[s] = False
                if s + len(c) < e:
                    mark[s + len(c)] = True
                break
    starts = lead[np.flatnonzero(mark[:m])]
    return starts, np.searchsorted(starts, at)


class Vocabulary:
    """Ranks of a byte-level BPE, with a minimal perfect hash over the entries' hashes."""

    def __init__(self, entries: dict[bytes, int]):
        self.ranks = entries
        #: rank of each pair of bytes, -1 where it is no entry
        self.pairs = [-1] * 65536
        for w, rank in entries.items():
            if len(w) == 2:
                self.pairs[w[0] << 8 | w[1]] = rank
        words = sorted(entries, key=entries.get)
        self.ids = np.array([entries[w] for w in words], np.uint32)
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        # decoding: where the bytes of an id lie
        top = int(self.ids.max()) + 1 if len(words) else 0
        self.start, self.length = np.zeros(top, np.int64), np.full(top, -1, np.int64)
        self.start[self.ids], self.length[self.ids] = self.at[:-1], np.diff(self.at)
        self._build(tx.span_hashes(tx.prefix_hashes(self.blob), self.at[:-1], self.at[1:]))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def _build(self, keys: np.ndarray) -> None:
        """Displacements such that each key has a slot of its own among len(keys) slots: crowded buckets choose first, buckets of one take what is left."""
        n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("two entries of the vocabulary share a hash")
        self.buckets = max(1, n // 4)
        bucket = (keys % _U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        count = np.diff(first)
        self.shift = np.zeros(self.buckets, np.int64)
        free = np.ones(n, bool)
        slots = np.zeros(n, np.int64)
        tries = np.arange(1, 513, dtype=np.uint64)
        for b in np.argsort(-count, kind="stable"):
            if count[b] < 2:
                break
            own = order[first[b] : first[b + 1]]
            base = 0
            while True:
                at = (tx.mix(keys[own][None, :] ^ ((tries + _U(base)) * _U(0x9E3779B97F4A7C15))[:, None]) % _U(n)).astype(np.int64)
                ranked = np.sort(at, axis=1)
                good = free[at].all(1) & (ranked[:, 1:] != ranked[:, :-1]).all(1)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[b] = base + k + 1
                    slots[own] = at[k]
                    free[at[k]] = False
                    break
                base += len(tries)
        single = np.flatnonzero(count == 1)
        left = np.flatnonzero(free)
        own = order[first[single]]
        slots[own] = left[: len(single)]
        self.shift[single] = -1 - left[: len(single)]
        self.entry = np.zeros(n, np.int64)
        self.entry[slots] = np.arange(n)
        self.keys = keys

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Index of the entry that equals each span of data, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys) or not len(keys):
            return out
        shift = self.shift[(keys % _U(self.buckets)).astype(np.int64)]
        slot = (tx.mix(keys ^ (np.maximum(shift, 0).astype(np.uint64) * _U(0x9E3779B97F4A7C15))) % _U(len(self.keys))).astype(np.int64)
        slot = np.where(shift < 0, -1 - shift, slot)
        entry = self.entry[slot]
        maybe = np.flatnonzero((self.keys[entry] == keys) & (self.at[entry + 1] - self.at[entry] == ends - starts))
        if len(maybe):
            size = (ends - starts)[maybe]
            ours, theirs = spread(starts[maybe], size), spread(self.at[entry[maybe]], size)
            differ = np.concatenate([[0], np.cumsum(data[ours] != self.blob[theirs])])
            stop = np.cumsum(size)
            maybe = maybe[differ[stop] == differ[stop - size]]
            out[maybe] = entry[maybe]
        return out

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token: the pair of lowest rank, leftmost first, is merged until none is left."""
        ranks, pairs = self.ranks, self.pairs
        n = len(word)
        if n == 1:
            return [ranks[word]]
        after = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is merged into its left neighbour
        before = list(range(-1, n - 1))
        get = ranks.get
        # (rank, start, stop) of a candidate as one number, which orders like the three
        bits = n.bit_length()
        high, low = 2 * bits, (1 << bits) - 1
        heap = [pairs[a << 8 | b] << high | i << bits | i + 2 for i, (a, b) in enumerate(zip(word, word[1:])) if pairs[a << 8 | b] >= 0]  # noqa: B905
        heapify(heap)
        while heap:
            found = heappop(heap)
            i, stop = found >> bits & low, found & low
            j = after[i]
            if j == 0 or j >= n or after[j] != stop:
                continue
            after[i], after[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(word[i : after[stop]])) is not None:
                    heappush(heap, r << high | i << bits | after[stop])
            if (h := before[i]) >= 0 and (r := get(word[h:stop])) is not None:
                heappush(heap, r << high | h << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : after[i]]])
            i = after[i]
        return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each span, end to end."""
    stop = np.cumsum(sizes)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts - (stop - sizes), sizes)


class Codec:
    """Encoder and decoder of chunks. Keeps the merges of recent misses, at most `kept` of them."""

    def __init__(self, vocabulary: Vocabulary, kept: int = 400_000):
        self.v, self.kept, self.known = vocabulary, kept, {}

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ids of all documents end to end, and where each document's ids start."""
        starts, first = pretokens(data, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        ends = np.append(starts[1:], len(data))
        _, index, back = np.unique(keys := tx.span_hashes(tx.prefix_hashes(data), starts, ends), return_index=True, return_inverse=True)
        ids, first = self._expand(data, starts, ends, keys, index, back, first)
        if not np.array_equal(self.decode(ids), data):  # two pre-tokens of one hash: take each on its own
            every = np.arange(len(starts))
            ids, first = self._expand(data, starts, ends, keys, every, every, np.searchsorted(starts, at))
        return ids, first

    def _expand(self, data, starts, ends, keys, index, back, first):
        entry = self.v.find(keys[index], data, starts[index], ends[index])
        sizes = np.ones(len(index), np.int64)
        flat = np.where(entry >= 0, self.v.ids[np.maximum(entry, 0)], 0).astype(np.uint32)
        missed = np.flatnonzero(entry < 0)
        if len(missed):
            raw, merged, known = data.tobytes(), [], self.known
            for s, e in zip(starts[index[missed]].tolist(), ends[index[missed]].tolist(), strict=True):
                word = raw[s:e]
                got = known.get(word)
                if got is None:
                    got = array("I", self.v.merge(word)).tobytes()
                    if len(known) >= self.kept:
                        known.clear()
                    if e - s <= 64:
                        known[word] = got
                merged.append(got)
            sizes[missed] = [len(x) >> 2 for x in merged]
            offset = np.cumsum(sizes) - sizes
            wide = np.zeros(int(sizes.sum()), np.uint32)
            hit = entry >= 0
            wide[offset[hit]] = flat[hit]
            wide[spread(offset[missed], sizes[missed])] = np.frombuffer(b"".join(merged), np.uint32)
            flat = wide
        offset = np.cumsum(sizes) - sizes
        own = sizes[back]
        total = np.concatenate([[0], np.cumsum(own)])
        return flat[spread(offset[back], own)], total[first]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids. An id without an entry is an error."""
        if len(ids) and (int(ids.max()) >= len(self.v.length) or (self.v.length[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        return self.v.blob[spread(self.v.start[ids], self.v.length[ids])]


def _codec(shared) -> Codec:
    """The worker's codec of a broadcast vocabulary."""
    held = shared.value
    if not hasattr(held, "codec"):
        held.codec = Codec(held)
    return held.codec


def _share(docs: DataFrame, vocabulary: Vocabulary):
    # bounded: a vocabulary file has at most a few hundred thousand entries
    return docs.sparkSession.sparkContext.broadcast(vocabulary)


def encode_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, token_ids) of each row of docs (doc_id, text)."""
    shared = _share(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for chunk in tx.chunks(batches):
            ids, first = codec.encode(*tx.bytes_of(chunk.column(1)))
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "token_ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, token_ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, data) of each row of encoded (doc_id, token_ids); null ids give no bytes."""
    shared = _share(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            rows = [codec.decode(np.array(x or [], np.uint32)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "data"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "token_ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, vocabulary: Vocabulary, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, and token_ids if wanted): each text is encoded, its ids decoded again, and both digested, in one pass."""
    shared = _share(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for chunk in tx.chunks(batches):
            ids, first = codec.encode(*tx.bytes_of(chunk.column(1)))
            plain = codec.decode(ids)
            sizes = np.concatenate([[0], np.cumsum(codec.v.length[ids])])[first]
            digests = [[hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(k[:-1].tolist(), k[1:].tolist(), strict=True)] for x, k in ((ids.astype("<u4"), first), (plain, sizes))]
            columns = [chunk.column(0), pa.array(np.diff(first), pa.int64()), *(pa.array(d, pa.string()) for d in digests)]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: len(columns)])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids)
