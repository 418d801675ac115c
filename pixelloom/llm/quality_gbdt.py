"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed for a chunk at once. Trees are grown by
depth over quantile bins with histograms of gradients, and are complete, so a
model is three flat arrays (feature, threshold, leaf value) that numpy walks for
all documents of a chunk level by level.

Training uses at most about `most` labelled rows (a parameter); statistics and
scores cover all documents.

Defined cases: null and empty texts have all statistics zero and are scored like
any other; texts are scored whole; repeated label rows count each, repeated
documents are scored each; null labels are left out; without labels of both
kinds every score is the share of label 1 (0.5 without any); an empty table gives
an empty result; only doc_id, text, and quality (for learning) are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _text as tx
from pixelloom.llm._sample import chosen_texts, fold

FEATURES = (
    "words", "chars_per_word", "upper", "digit", "hash_star_dollar", "percent_amp", "bar_angle", "other_punct", "high_bytes", "space",
    "lines_per_word", "same_as_previous", "distinct", "repeated_pairs", "repeated_triples", "repeated_lines", "all_upper_words",
    "capitalised_words", "ends_in_punct", "ends_in_symbol", "long_words", "short_words", "one_byte_words", "words_per_line", "bang_words",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
HASHES, PERCENTS, BARS, PUNCT = _class("#*$"), _class("%&"), _class("|<>"), _class(".,;:!?'\"()-_/\\[]{}@+=~^`")
SYMBOLS, BANG = HASHES | PERCENTS | BARS, _class("!")


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document."""
    docs = len(at) - 1
    member = ~tx.SPACE[data]
    starts, ends, first = tx.runs(member, at)
    owner = tx.owners(first, len(starts))
    count = np.diff(first)
    size = np.maximum(np.diff(at), 1)
    words = np.maximum(count, 1)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return (total[at[1:]] - total[at[:-1]]) / size

    def per_word(flags: np.ndarray) -> np.ndarray:
        return tx.sums(flags, first) / words

    long = ends - starts
    upper = np.concatenate([[0], np.cumsum(UPPER[data])])
    ups = upper[ends] - upper[starts]
    hashes = tx.span_hashes(tx.prefix_hashes(data), starts, ends)
    salt = tx.mix(np.arange(docs, dtype=np.uint64) + np.uint64(5))
    same = np.zeros(len(hashes), bool)
    if len(hashes):
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    distinct = ~tx.later(hashes ^ salt[owner])

    def repeats(n: int) -> np.ndarray:
        inside = tx.within(owner, n)
        flags = tx.repeated(tx.ngram_hashes(hashes, n)[inside] ^ salt[owner[inside]])
        return np.bincount(owner[inside[flags]], minlength=docs) / words

    lines, line_ends, line_first = tx.runs(data != 10, at)
    line_owner = tx.owners(line_first, len(lines))
    again = tx.later(tx.span_hashes(tx.prefix_hashes(data), lines, line_ends) ^ salt[line_owner])
    n_lines = np.maximum(np.diff(line_first), 1)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    head = data[starts] if len(starts) else last
    columns = [
        np.log1p(count), tx.sums(long, first) / words, share(UPPER), share(DIGIT), share(HASHES), share(PERCENTS), share(BARS), share(PUNCT), share(_HIGH), share(tx.SPACE),
        np.diff(line_first) / words, per_word(same), per_word(distinct), repeats(2), repeats(3), np.bincount(line_owner[again], minlength=docs) / n_lines, per_word((ups == long) & (long > 1)),
        per_word(UPPER[head]), per_word(PUNCT[last]), per_word(SYMBOLS[last]), per_word(long > 12), per_word(long < 3), per_word(long == 1), np.log1p(count / n_lines), per_word(BANG[last]),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1).reshape(docs, len(FEATURES))


_HIGH = np.arange(256) >= 128


@dataclass
class Trees:
    """Complete trees of one depth: node i has children 2 i + 1 and 2 i + 2; a row goes right if its feature is above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
                if not len(node) or node[0] >= len(feature):
                    break
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))


def train(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, smoothing: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for labels y (0 or 1)."""
    inner = (1 << depth) - 1
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: at most edge b
    margin = np.full(len(y), base)
    feature, threshold, leaf = [], [], []
    offset = np.arange(width) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        own_feature, own_threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            nodes, low = 1 << level, (1 << level) - 1
            cell = ((node - low)[:, None] * (width * bins) + offset + binned).ravel()
            g = np.bincount(cell, np.repeat(gradient, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(2)
            h = np.bincount(cell, np.repeat(hessian, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(2)
            total_g, total_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + smoothing) + (total_g - g) ** 2 / (total_h - h + smoothing) - total_g**2 / (total_h + smoothing)
            gain[(h < least * 0.1) | (total_h - h < least * 0.1)] = -np.inf
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -np.inf
            best = gain.reshape(nodes, -1).argmax(1)
            good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            for k in np.flatnonzero(good):
                own_feature[low + k] = best[k] // bins
                own_threshold[low + k] = edges[best[k] // bins][best[k] % bins]
            node = 2 * node + 1 + (x[np.arange(len(y)), own_feature[node]] > own_threshold[node])
        bottom = node - inner
        value = rate * np.bincount(bottom, gradient, inner + 1) / (np.bincount(bottom, hessian, inner + 1) + smoothing)
        margin += value[bottom]
        feature.append(own_feature)
        threshold.append(own_threshold)
        leaf.append(value)
    return Trees(np.array(feature), np.array(threshold), np.array(leaf), base)


def learn(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Trees:
    """Trees for labels (doc_id, quality)."""
    rows = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    picked = chosen_texts(docs, rows, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches, "text"):
            x = statistics(*tx.bytes_of(chunk.column(0)))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())), chunk.column(1), chunk.column(2)], ["x", "label", "doc_id"])

    # bounded by `most`
    found = picked.select("text", "label", "doc_id").mapInArrow(run, "x array<double>, label int, doc_id long").toArrow()
    x = np.array(found.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
    y = found.column(1).to_numpy().astype(float)
    order = np.lexsort((*x.T[::-1], y, found.column(2).to_numpy()))  # the same model however rows arrive
    return train(x[order], y[order])


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score) of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(shared.value.score(statistics(*tx.bytes_of(chunk.column(1)))))], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, least: float = 0.7) -> DataFrame:
    """score() by trees that learn from the labels outside fold `held`."""
    trees = learn(docs, labels.where(fold(F.col("doc_id"), folds) != held))
    scored = score(docs, trees)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
