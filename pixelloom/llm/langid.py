"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes. The probability of a
byte is taken from the longest context of `order` bytes in which the language has
seen it, with an escape to the next shorter context each time it hasn't (escape
method C: distinct followers against all followers). Statistics are frozen, so a
text's exact code length in a language is a sum over its bytes, and the language
of the shortest code wins.

Frozen statistics also make the trees plain tables. An n-gram is a node together
with the byte that follows; for each n-gram that any language has seen, the
table holds its cost in all languages, escapes included. Scoring looks up the
longest known n-gram that ends at each byte, for a whole chunk at once.

Defined cases: a null text, and a text without a letter, is `und` with score 0;
texts are scored whole; ties go to the first language by name; rows that repeat
are scored each on its own; an empty table gives an empty result, and without
labelled rows all texts are `und`; only doc_id, text and lang (for learning) are
read. Case of A-Z is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _text as tx
from pixelloom.llm._sample import fold, thinned

_U = np.uint64
ORDER = 3
#: Bytes of text scored at once; costs take 16 bytes or more for each and there is a worker for each core.
CHUNK_BYTES = 1 << 19
_LETTER = re.compile(r"[^\W\d_]")


def grams(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the last byte, key) of all n-grams within a document; the key is n and the bytes."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = np.full(m, n, np.uint64)
    for i in range(n):
        key = (key << _U(8)) | data[i : i + m]
    into = np.arange(n - 1, len(data)) - np.repeat(at[:-1], np.diff(at))[n - 1 :]
    inside = into >= n - 1
    return np.arange(n - 1, len(data))[inside], key[inside]


class Table:
    """Open-addressing table from n-gram keys to rows, probed for all keys at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.rows[slot] < 0
            put, where = todo[free], slot[free]
            _, one = np.unique(where, return_index=True)
            self.rows[where[one]], self.keys[where[one]] = put[one], keys[put[one]]
            left = self.keys[slot] != keys[todo]
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for unknown ones."""
        slot = self._slot(keys)
        out = self.rows[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            got = self.rows[slot]
            out[wrong] = got
            open_ = (got >= 0) & (self.keys[slot] != keys[wrong])
            wrong, slot = wrong[open_], slot[open_]
        return out


class Models:
    """Costs in bits. langs are sorted; row 0 of each table of costs stands for 'nothing known'."""

    def __init__(self, counts: dict[str, dict[int, int]], order: int = ORDER):
        """counts: for each language, the count of each n-gram key, for n up to order + 1."""
        self.order, self.langs = order, sorted(counts)
        width = len(self.langs)
        self.tables, self.costs, self.escapes = [], [], []
        # n = 1: context of no bytes; a byte that a language never saw costs an escape and 8 bits
        lower = None
        for n in range(1, order + 2):
            keys = np.array(sorted({k for c in counts.values() for k in c if k >> (8 * n) == n}), np.uint64)
            count = np.array([[counts[lang].get(int(k), 0) for lang in self.langs] for k in keys], np.float64).reshape(len(keys), width)
            context = keys >> _U(8)
            group, of = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(group), width)), np.zeros((len(group), width))
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(count / (total + kinds)[of])
            if n == 1:
                shorter = np.full((len(keys), width), 8.0)
            else:
                shorter = lower(keys, n - 1)
            cost = np.where(count > 0, seen, escape[of] + shorter)
            # contexts are keys of n - 1 bytes, with n in front as in `context`
            self.tables.append((Table(keys), Table(group)))
            self.costs.append(np.vstack([np.zeros((1, width)), cost]).astype(np.float32))
            self.escapes.append(np.vstack([np.zeros((1, width)), escape]).astype(np.float32))

            def lower(keys: np.ndarray, n: int) -> np.ndarray:
                """Costs of the last n bytes of longer n-grams."""
                return self.cost(((keys & _U((1 << 8 * n) - 1)) | _U(n << 8 * n)), n)

    def cost(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Cost of the last byte of each n-gram in each language."""
        table, contexts = self.tables[n - 1]
        row = table.find(keys)
        out = self.costs[n - 1][row + 1]
        lost = np.flatnonzero(row < 0)
        if len(lost):
            rest = keys[lost]
            escape = self.escapes[n - 1][contexts.find(rest >> _U(8)) + 1]
            if n == 1:
                out[lost] = escape + 8.0
            else:
                out[lost] = escape + self.cost((rest & _U((1 << 8 * (n - 1)) - 1)) | _U((n - 1) << 8 * (n - 1)), n - 1)
        return out

    def lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each document in each language, in bits."""
        data = tx.LOWER[data]
        docs, width = len(at) - 1, len(self.langs)
        total = np.zeros((len(data), width), np.float32)
        for n in range(1, self.order + 2):
            # a document's first bytes have shorter contexts
            where, keys = grams(data, at, n)
            if n <= self.order:
                into = where - np.repeat(at[:-1], np.diff(at))[where]
                first = into == n - 1
                where, keys = where[first], keys[first]
            if len(keys):
                total[where] = self.cost(keys, n)
        out = np.zeros((docs, width))
        for j in range(width):  # one language at a time, for memory
            run = np.concatenate([[0.0], np.cumsum(total[:, j], dtype=np.float64)])
            out[:, j] = run[at[1:]] - run[at[:-1]]
        return out


def learn(docs: DataFrame, per_lang: int = 400, order: int = ORDER, langs: int = 500) -> Models:
    """Models of the languages of docs (doc_id, text, lang): rows with text and lang, about per_lang of them for each language. More languages than `langs` are an error, for each has a model."""
    rows = docs.where("text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    sizes = {r.lang: r["count"] for r in docs.where("text is not null and lang is not null").groupBy("lang").count().limit(langs + 1).collect()}  # one row for each language
    if len(sizes) > langs:
        raise ValueError(f"more than {langs} languages")
    if not sizes:
        return Models({})
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep |= (F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, per_lang / n)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches, limit=CHUNK_BYTES):
            langs = np.array(chunk.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                part = chunk.filter(pa.array(langs == lang))
                data, at = tx.bytes_of(part.column(2))
                data = tx.LOWER[data]
                for n in range(1, order + 2):
                    keys, counts = np.unique(grams(data, at, n)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    # bounded by the sample
    found = rows.where(keep).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[int, int]] = {lang: {} for lang in sizes}
    for lang, gram, n in zip(*(found.column(i).to_pylist() for i in range(3)), strict=True):
        counts[lang][gram] = n
    return Models(counts, order)


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs (doc_id, text); score is the language's share of 2 ** -(bits / sqrt(bytes))."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for chunk in tx.chunks(batches, limit=CHUNK_BYTES):
            data, at = tx.bytes_of(chunk.column(1))
            known = np.array([bool(_LETTER.search(t)) if t else False for t in chunk.column(1).to_pylist()], bool)
            if m.langs:
                bits = m.lengths(data, at)
                best = bits.argmin(1)
                gain = (bits - bits.min(1, keepdims=True)) / np.sqrt(np.maximum(np.diff(at), 1))[:, None]
                score = 1 / np.exp2(-gain).sum(1)
            else:
                known[:] = False
                best, score = np.zeros(len(known), int), np.zeros(len(known))
            names = [m.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def report(docs: DataFrame, folds: int = 4, held: int = 2, per_lang: int = 400) -> DataFrame:
    """predict() by models that learn from the documents outside fold `held`."""
    models = learn(docs.where(fold(F.col("doc_id"), folds) != held), per_lang)
    return predict(docs, models).select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
