"""Toxicity by a weighted finite-state pattern grammar.

A clause's words become classes (insult, threat, target, negation, reported
speech, other). Five weighted transducers read them, each what the one before it
writes: insults and threats become marks, marks after a negation are negated, marks
after a word of reported speech are reported, and the last one writes a pattern for
each mark: a bare insult, one at a target near it (before or after), a negated or
reported one, a threat, a threat at a target, or nothing. Their arcs are tables;
compose() makes one transducer of them, whose weights are the sums of theirs, and a
clause is read once. A document's score is a logistic function of what its words of
each pattern weigh, of its clauses' path weights and of its length, so a word counts
by the clause in which it stands.

Words of insult come from a seed list and from at most about `most` labelled rows
(a parameter): a word is learned if it stands in many different contexts in toxic
texts and in few in others, which copies of one text can't bring about. A context is
the words beside it in its document. All words beyond the limits are learned, so
there are no ties to break. The weights of patterns are learned from the same rows,
in an order of their own, pulled towards prior weights where a pattern is rare.
Statistics and scores cover whole texts and don't depend on how rows are dealt out.

Defined cases: null and empty texts match nothing and get the score of a text
without matches; a clause of any length is read once; repeated rows are scored
each; null labels are left out, and without labels the prior weights hold; an
empty table gives an empty result; only doc_id, text, and toxic (for learning)
are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _text as tx
from pixelloom.llm._graph import cut
from pixelloom.llm._sample import chosen_texts, fold

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SEEDS = {
    INSULT: "idiot idiots moron morons stupid dumb trash garbage scum loser losers pathetic worthless disgusting clown fool imbecile dumm dummkopf trottel abschaum idiota estúpido basura imbécil crétin débile ordure abruti",
    THREAT: "kill hurt destroy stab shoot strangle murder töten umbringen verletzen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours yourself u he she him her they them their du dich dir euch ihr sie tu toi vous il elle ils tú usted ustedes él ella ellos",
    NEGATION: "not never no none neither nor isn aren wasn weren don doesn didn won nicht kein keine nie niemals ne pas jamais aucun nunca jamás tampoco",
    REPORT: "said says say called calls wrote writes quoted quotes claimed claims alleged reported sagte sagt nannte schrieb dit appelé écrit dijo dice llamó escribió",
}
PATTERNS = ("insult", "insult_at_target", "insult_negated", "insult_reported", "threat", "threat_at_target")
#: What a mark is that a negation or a report takes away.
NOTHING = "nothing"
#: Prior weights: of no match, of a unit of each of PATTERNS, of a unit of path weight, and of the logarithm of a text's words.
PRIOR = np.array([-4.0, 1.2, 1.4, 0.1, 0.15, 0.1, 1.5, 0.1, 0.0])
#: Weights of the words of the seed list, and the most that the words of a pattern add up to.
SEED_WEIGHT, THREAT_WEIGHT, MOST = 4.0, 2.0, 24.0
#: A learned word weighs its squared log-odds over this: one certain word says more than several that chance puts into clean texts.
SHARPNESS = 8.0
CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[[ord(c) for c in ".!?;:\n"]] = True
#: Words after a negation, and between a target and what is said of it.
REACH = 4


@dataclass(frozen=True)
class Transducer:
    """Arcs by state and symbol read, as (next state, symbols written, weight), and what each state writes and weighs at the end of a clause. State 0 is the start."""

    arcs: list[dict[object, tuple[int, tuple, float]]]
    ends: list[tuple[tuple, float]]

    def read(self, symbols) -> tuple[list, float]:
        """(symbols written, path weight) of a clause."""
        state, out, weight = 0, [], 0.0
        for x in symbols:
            state, wrote, w = self.arcs[state][x]
            out += wrote
            weight += w
        wrote, w = self.ends[state]
        return [*out, *wrote], weight + w


def transducer(alphabet, start, step, end) -> Transducer:
    """Arc tables of the rules step(state, symbol) -> (state, written, weight) and end(state) -> (written, weight) over all states that can be reached."""
    states, arcs = {start: 0}, []
    for state in (order := [start]):
        row = {}
        for x in alphabet:
            after, wrote, weight = step(state, x)
            if after not in states:
                states[after] = len(states)
                order.append(after)
            row[x] = (states[after], tuple(wrote), weight)
        arcs.append(row)
    return Transducer(arcs, [(tuple(w), x) for w, x in map(end, order)])


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what `first` reads and writes what `second` writes on reading what `first` writes; weights add up."""

    def through(state: int, symbols) -> tuple[int, list, float]:
        out, weight = [], 0.0
        for x in symbols:
            state, wrote, w = second.arcs[state][x]
            out += wrote
            weight += w
        return state, out, weight

    def step(pair, x):
        a, wrote, w = first.arcs[pair[0]][x]
        b, out, v = through(pair[1], wrote)
        return (a, b), out, w + v

    def end(pair):
        wrote, w = first.ends[pair[0]]
        b, out, v = through(pair[1], wrote)
        last, u = second.ends[b]
        return [*out, *last], w + v + u

    return transducer(first.arcs[0], (0, 0), step, end)


def _silent(_):
    return (), 0.0


def insults() -> Transducer:
    """Insults become marks; each one after the first of a clause weighs more."""
    return transducer(range(6), 0, lambda n, x: (min(n + 1, 2), ("slur",), 0.5 * (n > 0)) if x == INSULT else (n, (x,), 0.0), _silent)


def threats() -> Transducer:
    """Words of threat become marks."""
    return transducer(("slur", *(x for x in range(6) if x != INSULT)), 0, lambda n, x: (0, ("harm",) if x == THREAT else (x,), 0.0), _silent)


def negations() -> Transducer:
    """Up to REACH words after a negation a slur is negated and a threat is none."""

    def step(left, x):
        if x == NEGATION:
            return REACH, (OTHER,), 0.0
        if left and x in ("slur", "harm"):
            return left - 1, ("slur_negated" if x == "slur" else NOTHING,), -1.0
        return max(0, left - 1), (x,), 0.0

    return transducer(("slur", "harm", OTHER, TARGET, NEGATION, REPORT), 0, step, _silent)


def reports() -> Transducer:
    """In the rest of a clause with a word of reported speech a slur is reported and a threat is none."""

    def step(told, x):
        if x == REPORT:
            return 1, (OTHER,), 0.0
        if told and x in ("slur", "harm"):
            return 1, ("slur_reported" if x == "slur" else NOTHING,), -1.0
        return told, (x,), 0.0

    return transducer(("slur", "slur_negated", "harm", NOTHING, OTHER, TARGET, REPORT), 0, step, _silent)


def targets() -> Transducer:
    """One pattern for each mark, in the order of the marks. A mark without a target before it waits up to REACH words for one after it; near targets weigh more."""
    bare = {"slur": "insult", "harm": "threat"}
    fixed = {"slur_negated": "insult_negated", "slur_reported": "insult_reported", NOTHING: NOTHING}

    def step(state, x):
        near, waits, left = state  # words that the last target still reaches, the mark that waits, and how long
        flushed = (bare[waits],) if waits else ()
        if x in bare:
            if near:
                return (near - 1, None, 0), (*flushed, f"{bare[x]}_at_target"), near / REACH
            return (0, x, REACH), flushed, 0.0
        if x in fixed:
            return (max(0, near - 1), None, 0), (*flushed, fixed[x]), 0.0
        if x == TARGET:
            return (REACH, None, 0), (f"{bare[waits]}_at_target",) if waits else (), left / REACH
        if left > 1:
            return (max(0, near - 1), waits, left - 1), (), 0.0
        return (max(0, near - 1), None, 0), flushed, 0.0

    return transducer(("slur", "slur_negated", "slur_reported", "harm", NOTHING, OTHER, TARGET), (0, None, 0), step, lambda state: ((bare[state[1]],) if state[1] else (), 0.0))


@cache
def machine() -> Transducer:
    """The composition of the five."""
    return reduce(compose, (insults(), threats(), negations(), reports(), targets()))


def word_keys(words: list[str]) -> np.ndarray:
    data, at = tx.bytes_of(pa.array(words, pa.string()))
    return tx.span_hashes(tx.prefix_hashes(data, tx.BYTE_VALUES_LOWER), at[:-1], at[1:])


class Grammar:
    """Classes and weights of words, and weights of patterns."""

    def __init__(self, insults: dict[str, float], weights: np.ndarray = PRIOR):
        self.insults, self.weights = dict.fromkeys(SEEDS[INSULT].split(), SEED_WEIGHT) | insults, weights
        words = {w: (k, THREAT_WEIGHT * (k == THREAT)) for k in (REPORT, NEGATION, TARGET, THREAT) for w in SEEDS[k].split()} | {w: (INSULT, x) for w, x in sorted(self.insults.items())}
        keys = word_keys(list(words))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.kinds, self.sizes = (np.array(x)[order] for x in zip(*words.values(), strict=True))

    def classify(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[k] == hashes
        return np.where(known, self.kinds[k], OTHER), np.where(known, self.sizes[k], 0.0)

    def counts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each document the weight of each pattern, the path weights of its clauses, and the logarithm of its words."""
        out = np.zeros((len(at) - 1, len(PATTERNS) + 2))
        starts, ends, first = tx.runs(tx.ALNUM[data], at)
        out[:, -1] = np.log1p(np.diff(first))
        if not len(starts):
            return out
        owner = tx.owners(first, len(starts))
        kinds, sizes = self.classify(tx.span_hashes(tx.prefix_hashes(data, tx.BYTE_VALUES_LOWER), starts, ends))
        # a clause: words with the same number of clause ends before them, in one document
        clause = np.cumsum(CLAUSE_END[data])[starts] + owner
        marks = (kinds == INSULT) | (kinds == THREAT)
        hits = np.unique(clause[marks])
        lo, hi = np.searchsorted(clause, hits, "left"), np.searchsorted(clause, hits, "right")
        read = machine().read
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            patterns, weight = read(kinds[a:b].tolist())
            row = out[owner[a]]
            # one pattern for each mark, in their order
            for p, size in zip(patterns, sizes[a:b][marks[a:b]].tolist(), strict=True):
                if p != NOTHING:
                    row[PATTERNS.index(p)] += size
            row[-2] += weight
        out[:, :-1] = np.clip(out[:, :-1], -MOST, MOST)
        return out

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] + counts @ self.weights[1:])))


def fit_weights(counts: np.ndarray, y: np.ndarray, pull: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of most posterior probability around PRIOR (Newton's method)."""
    x = np.hstack([np.ones((len(y), 1)), counts])
    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (y - p) - pull * (w - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w = w + np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, most: int = 8_000, least: int = 5, odds: float = 12.0) -> Grammar:
    """Grammar for labels (doc_id, toxic). A word of `least` contexts in toxic texts, `odds` times the share in others, is learned as an insult."""
    rows = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    picked = chosen_texts(docs, rows, most)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            label = np.array(chunk.column(2).to_pylist())
            data, at = tx.bytes_of(chunk.column(1))
            starts, ends, first = tx.runs(tx.ALNUM[data], at)
            if not len(starts):
                continue
            low = tx.LOWER[data]
            owner = tx.owners(first, len(starts))
            keys = tx.span_hashes(tx.prefix_hashes(low), starts, ends)
            # the words beside it in its document; zero beyond the ends
            before, after = np.zeros_like(keys), np.zeros_like(keys)
            same = owner[1:] == owner[:-1]
            before[1:][same] = keys[:-1][same]
            after[:-1][same] = keys[1:][same]
            place = tx.mix(before * np.uint64(3) + after)
            once = np.flatnonzero(~tx.later(tx.mix(keys + place) ^ label[owner].astype(np.uint64)))
            raw = low.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[once].tolist(), ends[once].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(place[once].view(np.int64)), pa.array(label[owner[once]], pa.int32())], ["word", "place", "label"])

    table = picked.mapInArrow(contexts, "word string, place long, label int").distinct()
    table = table.groupBy("word").agg(F.sum(F.col("label")).alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    total = cut(table)
    toxic, clean = (max(1, x or 0) for x in total.agg(F.sum("toxic"), F.sum("clean")).first())
    ratio = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * F.lit(clean / toxic)
    # each learned word has `least` contexts of its own in the sample, so there are few
    found = {r.word: min(9.0, math.log(r.ratio)) ** 2 / SHARPNESS for r in total.withColumn("ratio", ratio).where((F.col("toxic") >= least) & (F.col("ratio") >= odds)).collect()}
    grammar = Grammar(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            got = grammar.counts(*tx.bytes_of(chunk.column(1)))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * got.shape[1], pa.int32()), pa.array(got.ravel())), chunk.column(2)], ["x", "label"])

    rows = picked.mapInArrow(count, "x array<double>, label int").toArrow()  # bounded by `most`
    x = np.array(rows.column(0).to_pylist(), float).reshape(-1, len(PATTERNS) + 2)
    y = rows.column(1).to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same sums however rows arrive
    x, y = x[order], y[order]
    return Grammar(found, fit_weights(x, y) if len(y) else PRIOR)


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score, matches) of each row of docs (doc_id, text); matches holds the weight of each of PATTERNS, the path weight and the logarithm of the words."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # a word list

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            counts = shared.value.counts(*tx.bytes_of(chunk.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * counts.shape[1], pa.int32()), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(shared.value.score(counts)), lists], ["doc_id", "score", "matches"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double, matches array<double>")


def report(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, least: float = 0.5) -> DataFrame:
    """score() by a grammar that learns from the labels outside fold `held`."""
    grammar = learn(docs, labels.where(fold(F.col("doc_id"), folds) != held))
    return score(docs, grammar).select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
