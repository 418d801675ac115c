"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find, within each document, the n-grams
that occur more than once; the rule measures the share of a document's word
characters that lie inside such n-grams, and the share inside repeated lines.

Defined cases: a null or empty text has no words and fails the base rule; a text
of one very long line or word is processed whole; rows that repeat are judged
each on its own; an empty table gives an empty result; other columns are not
read, so clashing names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelloom.llm import _text as tx


@dataclass(frozen=True)
class Rules:
    """Limits of the base rule and of the coverage rule (shares of word characters)."""

    min_words: int = 50
    max_repeat_words: float = 0.5
    #: n-gram length in words -> largest share of characters inside repeated n-grams of that length
    coverage: tuple[tuple[int, float], ...] = ((2, 0.80), (3, 0.45), (5, 0.40), (8, 0.35))
    #: largest share of characters inside lines that repeat an earlier line
    line_coverage: float = 0.30


SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_coverage double, coverage array<double>"


def measure(data: np.ndarray, at: np.ndarray, rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """All measures of the documents whose bytes lie at data[at[d]:at[d + 1]]."""
    docs = len(at) - 1
    member = ~tx.SPACE[data]
    starts, ends, first = tx.runs(member, at)
    owner = tx.owners(first, len(starts))
    n_words = np.diff(first)
    # code points: bytes that don't continue a character
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    word_chars = tx.sums(chars, first)
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    prefix = tx.prefix_hashes(data)
    words = tx.span_hashes(prefix, starts, ends)
    salt = tx.mix(np.arange(docs, dtype=np.uint64) + np.uint64(77))

    def covered(n: int) -> np.ndarray:
        """Words that lie in an n-gram found twice or more in their document."""
        at_n = tx.within(owner, n)
        twice = at_n[tx.repeated(tx.ngram_hashes(words, n)[at_n] ^ salt[owner[at_n]])]
        size = len(words) + 1
        step = np.bincount(twice, minlength=size) - np.bincount(twice + n, minlength=size)
        return np.cumsum(step[:-1]) > 0

    in_three = covered(3)
    # lines with a word
    lines, line_ends, line_first = tx.runs(data != 10, at)
    seen = np.concatenate([[0], np.cumsum(member)])
    holds = np.flatnonzero(seen[line_ends] > seen[lines])
    line_owner = tx.owners(line_first, len(lines))[holds]
    again = tx.later(tx.span_hashes(prefix, lines[holds], line_ends[holds]) ^ salt[line_owner])
    dup_lines = np.bincount(line_owner[again], minlength=docs)
    spent = np.concatenate([[0], np.cumsum(member & ((data & 0xC0) != 0x80))])
    dup_chars = np.bincount(line_owner[again], weights=(spent[line_ends] - spent[lines])[holds][again], minlength=docs)
    whole = np.maximum(word_chars, 1)
    out = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
        "n_dup_lines": dup_lines,
        "n_repeat_words": tx.sums(in_three, first),
        "line_coverage": dup_chars / whole,
        "coverage": np.stack([tx.sums(chars * (in_three if n == 3 else covered(n)), first) / whole for n, _ in rules.coverage], 1).reshape(docs, -1),
    }
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > 100 * rules.max_repeat_words * n_words)
    limits = np.array([x for _, x in rules.coverage])
    out["kept"] = ~(out["base_failed"] | (out["line_coverage"] > rules.line_coverage) | (out["coverage"] > limits).any(1))
    return out


def repetition_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row of measures and the verdict for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            found = measure(*tx.bytes_of(chunk.column(1)), rules)
            cover = found["coverage"]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column(0),
                    *(pa.array(found[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    pa.array(found["base_failed"]),
                    pa.array(found["kept"]),
                    pa.array(found["line_coverage"], pa.float64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(cover) + 1) * cover.shape[1], pa.int32()), pa.array(cover.ravel(), pa.float64())),
                ],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_coverage", "coverage"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def keep_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs without the rows that the rules reject; all columns stay."""
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            yield chunk.filter(pa.array(measure(*tx.bytes_of(chunk.column(text)), rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
