"""Personal data by patterns and a skip-chain conditional random field.

Base spans (e-mail addresses, IP addresses, payment cards, phone numbers) come
from linear scans. The field adds spans that the patterns miss but that read and
repeat like personal data. Its nodes are a document's words with a digit, an @ or a
spelt-out (at). Neighbouring nodes share a chain potential. Nodes of equal words, of
one form, or after the same word share a skip potential however far apart they are,
each with the one before it of that sort, so a document has at most four edges for
each node. Loopy belief propagation makes labels consistent over the whole document;
words labelled with high probability whose run has the make-up of its kind become
spans. So a number with a wrong digit is taken as a card where a card stands in the
same document, and not where it stands alone: its failed check weighs against it,
and more such numbers outweigh few cards.

Words inside base spans are given. The field learns by pseudo-likelihood from the
base spans of at most about `most` documents (a parameter); search covers all
documents and whole texts. A word of the make-up of a kind is no example of anything
in a document that has a base span of the kind, and an example of nothing elsewhere.

Defined cases: a null text is an empty text and has no spans; long runs of digits
or letters are scanned in linear time; repeated rows are searched each; an empty
table gives an empty result; report() reads doc_id and text only, redact() keeps
all columns. Offsets count code points.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelloom.llm import _text as tx
from pixelloom.llm._sample import thinned

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is "nothing", label k + 1 is KINDS[k].
LABELS = len(KINDS) + 1
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_EDGE = ".,;:()[]{}<>\"'!?*#$%&|"
_SPELT = re.compile(r"[(\[{][aA][tT][)\]}]")
_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[ord(c) for c in "([{"]] = True
_CLOSE[[ord(c) for c in ")]}"]] = True

DIGIT_OR_AT = np.zeros(256, bool)
DIGIT_OR_AT[[*range(0x30, 0x3A), 0x40]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping for each kind, in order."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        # the local part is the run of its characters before the @, as far as the last address allows
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1  # a later local part can't reach over this @
            at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                    out.append((at, 1, at + size))
                at += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Nodes:
    """The words of one document that the field labels."""

    spans: list[tuple[int, int]]
    words: list[str]
    order: list[int]
    before: list[str]


def candidate_words(data: np.ndarray, at: np.ndarray) -> dict[int, Nodes]:
    """Nodes of each document that has any: words with a digit, an @ or a spelt-out (at).

    Spans are code points without punctuation at the edges; order numbers all of the document's words; before is the word before.
    """
    starts, ends, first = tx.runs(~tx.SPACE[data], at)
    if not len(starts):
        return {}
    owner = tx.owners(first, len(starts))
    mark = DIGIT_OR_AT[data]
    if len(data) > 3:
        mark[:-3] |= _OPEN[data[:-3]] & (tx.LOWER[data[1:-2]] == 0x61) & (tx.LOWER[data[2:-1]] == 0x74) & _CLOSE[data[3:]]
    marks = np.concatenate([[0], np.cumsum(mark)])
    some = np.flatnonzero(marks[ends] > marks[starts])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    raw = data.tobytes()
    out: dict[int, Nodes] = {}
    for d, i, s, e in zip(owner[some].tolist(), some.tolist(), starts[some].tolist(), ends[some].tolist(), strict=True):
        word = raw[s:e].decode("utf-8", "replace")
        bare = word.lstrip(_EDGE)
        begin = int(points[s] - points[at[d]]) + len(word) - len(bare)
        bare = bare.rstrip(_EDGE)
        if not bare:
            continue
        nodes = out.setdefault(d, Nodes([], [], [], []))
        nodes.spans.append((begin, begin + len(bare)))
        nodes.words.append(word)
        nodes.order.append(i)
        nodes.before.append(raw[starts[i - 1] : ends[i - 1]].decode("utf-8", "replace").strip(_EDGE).lower() if i > first[d] else "")
    return out


def plain(word: str) -> str:
    """The word without punctuation at the edges, a spelt-out (at) as @."""
    return _SPELT.sub("@", word).strip(_EDGE)


def features(word: str, bare: str, near_before: bool, near_after: bool) -> list[float]:
    """What a word looks like. Whether its number passes a check is left to doubt(), else the patterns would be all that is learned."""
    n = sum(c.isdigit() for c in bare)
    parts = bare.split(".")
    letters = any(c.isalpha() for c in bare)
    return [
        1.0,
        float("@" in bare),
        float("@" in bare and "." in bare.rsplit("@", 1)[-1]),
        float(len(parts) == 4 and all(p.isdigit() for p in parts)),
        float(len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts)),
        *(float(a <= n <= b) for a, b in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 9), (10, 13), (14, 19), (20, 1 << 60))),
        float(word.lstrip("\"'").startswith("+")),
        float("(" in word and ")" in word),
        float("-" in bare),
        float(letters),
        float(not letters and n == len(bare)),
        float(near_before),
        float(near_after),
        float(len(bare) > 40),
    ]


WIDTH = len(features("x1", "x1", False, False))


def may_be(kind: int, text: str) -> bool:
    """Whether a word, or a run of words, has the make-up of its kind, looser than the pattern has it."""
    digits = sum(c.isdigit() for c in text)
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", _SPELT.sub("@", text)))
    if kind == 1:
        return bool(re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?:[:/][0-9]+)?", text))
    if kind == 2:
        number = re.sub(r"[ .-]", "", text)
        return number.isdecimal() and 13 <= len(number) <= 19
    return 7 <= digits <= 15 and not re.search(r"[^0-9 ().+/-]", text) and bool(re.search(r"[ ()/-]", text.strip("()")))


def doubt(bare: str) -> list[float]:
    """What failed checks of a word's number speak against its labels: of a card's digits, and of the parts of an IP address."""
    out = [0.0] * LABELS
    number = re.sub(r"[ .-]", "", bare)
    if number.isdecimal() and len(number) >= 13 and not luhn(number):
        out[3] = DOUBT
    parts = bare.split(".")
    if len(parts) == 4 and all(p.isdecimal() for p in parts) and any(len(p) > 3 or int(p) > 255 for p in parts):
        out[2] = DOUBT
    return out


@dataclass
class Graph:
    """Nodes of documents end to end. Edges are pairs of nodes; links has the number in LINKS of each skip edge."""

    x: np.ndarray
    doubts: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    links: np.ndarray


def graph(docs: list[Nodes]) -> Graph:
    x, doubts, chain, skip, links, base = [], [], [], [], [], 0
    for nodes in docs:
        last: dict[tuple[int, str], int] = {}
        n = len(nodes.words)
        near = [nodes.order[i + 1] == nodes.order[i] + 1 for i in range(n - 1)]
        for i, word in enumerate(nodes.words):
            bare = plain(word)
            x.append(features(word, bare, i > 0 and near[i - 1], i < n - 1 and near[i]))
            doubts.append(doubt(bare))
            if i and near[i - 1]:
                chain.append((base + i - 1, base + i))
            whole = word.strip(".,;:!?\"'")
            forms = [(0, whole.lower())] if len(whole) > 3 else []
            if sum(c.isdigit() for c in bare) >= 7 or "@" in bare:
                forms.append((1, re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", bare))))
                if nodes.before[i]:
                    forms.append((2, nodes.before[i]))
            linked = set()
            for form in forms:
                j = last.get(form)
                if j is not None and j not in linked and not (i and near[i - 1] and j == i - 1):
                    skip.append((base + j, base + i))
                    links.append(form[0])
                    linked.add(j)
                last[form] = i
        base += n
    return Graph(
        np.array(x, float).reshape(-1, WIDTH), np.array(doubts, float).reshape(-1, LABELS), np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2), np.array(links, np.int64)
    )


@dataclass
class Field:
    unary: np.ndarray
    chain: np.ndarray
    #: One potential for each of LINKS.
    skip: np.ndarray

    def beliefs(self, g: Graph, given: np.ndarray, rounds: int = 16, damping: float = 0.2) -> np.ndarray:
        """Label probabilities of each node by loopy belief propagation. given: labels known from base spans, 0 elsewhere.

        The rounds are fixed, so that a document's labels don't depend on those that it is read with.
        """
        local = g.x @ self.unary + np.where(given[:, None] > 0, GIVEN * np.eye(LABELS)[given], g.doubts)
        edges = np.concatenate([g.chain, g.skip])
        potential = np.concatenate([np.broadcast_to(self.chain, (len(g.chain), LABELS, LABELS)), self.skip[g.links]])
        n, m = len(g.x), len(edges)
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        both = np.concatenate([potential, potential.transpose(0, 2, 1)])  # [edge, label of source, label of target]
        message = np.zeros((2 * m, LABELS))
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        for _ in range(rounds if m else 0):
            total = local.copy()
            np.add.at(total, target, message)
            out = (total[source] - message[back])[:, :, None] + both
            top = out.max(1, keepdims=True)
            new = top[:, 0] + np.log(np.exp(out - top).sum(1))
            new -= new.max(1, keepdims=True)
            message = damping * message + (1 - damping) * new
        total = local.copy()
        np.add.at(total, target, message)
        total -= total.max(1, keepdims=True)
        p = np.exp(total)
        return p / p.sum(1, keepdims=True) if n else p


#: Kinds of skip links: equal words, words of one form, words that follow the same word; and their prior potentials of equal labels.
LINKS, SAME = ("equal", "form", "context"), (2.5, 2.5, 1.0)
#: Weight of a label that a base span gives, and of a number's failed check against its label.
GIVEN, DOUBT = 8.0, -1.8


def train(g: Graph, y: np.ndarray, seen: np.ndarray, steps: int = 400, rate: float = 0.1, pull: float = 0.003) -> Field:
    """Field of most penalised pseudo-likelihood for labels y of the nodes that are seen (Adam); the others say nothing."""
    prior = Field(np.zeros((WIDTH, LABELS)), np.zeros((LABELS, LABELS)), np.array(SAME)[:, None, None] * np.eye(LABELS))
    field = Field(prior.unary.copy(), prior.chain.copy(), prior.skip.copy())
    field.unary[0, 0] = 1.0
    if not len(g.x):
        field.unary[0, 0] = 6.0  # nothing learned: nothing found
        return field
    hot = np.eye(LABELS)[y] * seen[:, None]
    sums = []  # (name, number of the potential, sums of labels to the left and to the right of each node)
    for name, kind, edges in (("chain", ..., g.chain), *(("skip", k, g.skip[g.links == k]) for k in range(len(LINKS)))):
        before, after = np.zeros((len(g.x), LABELS)), np.zeros((len(g.x), LABELS))
        np.add.at(after, edges[:, 1], hot[edges[:, 0]])
        np.add.at(before, edges[:, 0], hot[edges[:, 1]])
        sums.append((name, kind, after, before))
    names = ("unary", "chain", "skip")
    first, second = ({k: np.zeros_like(getattr(field, k)) for k in names} for _ in range(2))
    for t in range(1, steps + 1):
        score = g.x @ field.unary
        for name, kind, left, right in sums:
            potential = getattr(field, name)[kind]
            score += left @ potential + right @ potential.T
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        gap = (hot - p / p.sum(1, keepdims=True)) * seen[:, None]
        slope = {"unary": g.x.T @ gap, "chain": np.zeros_like(field.chain), "skip": np.zeros_like(field.skip)}
        for name, kind, left, right in sums:
            slope[name][kind] = left.T @ gap + gap.T @ right
        # a skip potential favours equal labels, all alike: it brings consistency and no label of its own
        slope["skip"] = slope["skip"].trace(axis1=1, axis2=2)[:, None, None] / LABELS * np.eye(LABELS)
        for k in names:
            grad = slope[k] / len(g.x) - pull * (getattr(field, k) - getattr(prior, k)) / np.sqrt(len(g.x))
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            setattr(field, k, getattr(field, k) + rate * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8))
    return field


def added_spans(texts: list[str], nodes: list[Nodes], base: list[list[tuple[int, int, int]]], field: Field, least: float = 0.75) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to the base spans of each document."""
    given = np.array([k for own, known in zip(nodes, base, strict=True) for k in labelled(own, known)], np.int64)
    p = field.beliefs(graph(nodes), given)
    label, sure = p.argmax(1), p.max(1) >= least
    out, at = [], 0
    for text, own, known in zip(texts, nodes, base, strict=True):
        n, found = len(own.words), []
        i = 0
        while i < n:
            k = int(label[at + i])
            j = i + 1
            # words of given spans belong to those; neighbouring words of a phone number go with one that is sure
            if k and not given[at + i]:
                while j < n and label[at + j] == k and not given[at + j] and own.order[j] == own.order[j - 1] + 1 and k == 4:
                    j += 1
                if not sure[at + i : at + j].any():
                    i = j
                    continue
                start, stop = own.spans[i][0], own.spans[j - 1][1]
                if k == 4 and start and text[start - 1] in "(+":
                    start -= 1
                if may_be(k - 1, text[start:stop]):
                    found.append((start, k - 1, stop))
            i = j
        out.append(found)
        at += n
    return out


def search(data: np.ndarray, at: np.ndarray, field: Field) -> dict[int, tuple[str, list, list]]:
    """(text, base spans, added spans) of the documents that have a candidate word."""
    nodes = candidate_words(data, at)
    which = [d for d in range(len(at) - 1) if d in nodes]
    texts = [data[at[d] : at[d + 1]].tobytes().decode("utf-8", "replace") for d in which]
    base = [base_spans(t) for t in texts]
    added = added_spans(texts, [nodes[d] for d in which], base, field)
    return {d: (t, b, a) for d, t, b, a in zip(which, texts, base, added, strict=True)}


def labelled(nodes: Nodes, base: list[tuple[int, int, int]]) -> list[int]:
    """Label of each node: that of the first base span that it shares a character with, or 0."""
    out = [0] * len(nodes.spans)
    starts, ends = [s for s, _ in nodes.spans], [e for _, e in nodes.spans]
    for a, k, b in base:
        for i in range(bisect_right(ends, a), bisect_left(starts, b)):
            out[i] = out[i] or k + 1
    return out


def observed(nodes: Nodes, labels: list[int]) -> list[bool]:
    """Whether a node's label is known: it is not where a base span of a kind is in the document and another word may be of that kind as well."""
    kinds = {k - 1 for k in labels if k}
    return [bool(y) or not any(may_be(k, plain(w)) for k in kinds) for y, w in zip(labels, nodes.words, strict=True)]


def learn(docs: DataFrame, most: int = 20_000) -> Field:
    """A field that learns from the base spans of a sample of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            data, at = tx.bytes_of(chunk.column(1))
            nodes = candidate_words(data, at)
            rows = []
            for d, own in nodes.items():
                y = labelled(own, base_spans(data[at[d] : at[d + 1]].tobytes().decode("utf-8", "replace")))
                rows.append((chunk.column(0)[d].as_py(), own.words, [i - own.order[0] for i in own.order], own.before, y, observed(own, y)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "words", "place", "before", "y", "seen"])

    sample = thinned(docs.selectExpr("cast(doc_id as long) doc_id", "text"), most, "doc_id", "text")
    found = sample.mapInArrow(run, "doc_id long, words array<string>, place array<long>, before array<string>, y array<long>, seen array<boolean>").toArrow()  # bounded by `most`
    rows = sorted(zip(*(found.column(i).to_pylist() for i in range(6)), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3]))
    g = graph([Nodes([], words, place, before) for _, words, place, before, _, _ in rows])
    return train(g, np.array([k for r in rows for k in r[4]], np.int64), np.array([k for r in rows for k in r[5]], bool))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_NOTHING = hashlib.sha256(b"").hexdigest()


def report(docs: DataFrame, field: Field) -> DataFrame:
    """Counts and digest of the base spans, and all spans, for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            n = chunk.num_rows
            counts, digest, spans = np.zeros((len(KINDS), n), np.int64), [_NOTHING] * n, [""] * n
            for d, (_, base, added) in search(*tx.bytes_of(chunk.column(1)), shared.value).items():
                for _, k, _ in base:
                    counts[k, d] += 1
                digest[d] = hashlib.sha256(_listed(base).encode()).hexdigest()
                spans[d] = _listed(base + added)
            yield pa.RecordBatch.from_arrays([chunk.column(0), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs with each span (overlapping ones as one) replaced by its first kind in brackets; all else stays."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            column = chunk.column(place)
            changed = {}
            for d, (text, base, added) in search(*tx.bytes_of(column), shared.value).items():
                spans = sorted(base + added)
                if spans:
                    parts, at = [], 0
                    for a, k, b in spans:
                        if a >= at:
                            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
                        at = max(at, b)
                    changed[d] = "".join([*parts, text[at:]])
            if changed:
                values = column.to_pylist()
                for d, text in changed.items():
                    values[d] = text
                chunk = chunk.set_column(place, chunk.schema.field(place), pa.array(values, column.type))
            yield chunk

    return docs.mapInArrow(run, docs.schema)
