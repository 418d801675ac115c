import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from pixelloom.llm import _text as tx
from pixelloom.llm import pii_crf as pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    None, "", "mail a.b+c@x-y.example.com, or é@x.com; x@y z@y.z@w.v.u @q.r a@@b.c", "1.2.3.4.5.6.7.8.9 256.1.1.1 001.002.003.0004 1.2.3 1..2.3.4.5",
    "card 4539 1488 0343 6467 and 4539148803436467, 4539-1488-0343-6468 1234", "+1 (017) 555-7713 +44 20 7946 0958. +1 2 +12345678901234567 ++1 800 555 1234",
    "😀 from.55@mail9.example.com é 10.0.0.1 " * 3, "0" * 400 + "@" * 50 + "a" * 400, "9-9 9" * 200, "a.b@c.d" * 40, "1.1.1.1" * 50,
]


def test_base_spans():
    for t in TEXTS:
        assert pii.base_spans(t or "") == brute(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000 + " 1", "1." * 150_000, "a@" * 150_000, "+" * 300_000, "a." * 100_000 + "@"):
        pii.base_spans(t)


def _docs(spark):
    lines = [f"call +1 ({100 + i}) 555-{1000 + 7 * i} or write u{i}@mail{i % 7}.example.com from 10.1.{i}.{i + 3} in {1900 + i} with {i} items (p. {i})" for i in range(120)]
    texts = [*TEXTS, *lines, "ring +1 (321) 555-1234 today. Later: (321) 555-1234 again, in (2019) and 12 pages"]
    return texts, spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, spans string")


def test_report_and_redaction(spark):
    texts, docs = _docs(spark)
    field = pii.learn(docs)
    got = {r.doc_id: r for r in pii.report(docs, field).collect()}
    for i, t in enumerate(texts):
        base = brute(t)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
        assert r.base_sha256 == hashlib.sha256(pii._listed(base).encode()).hexdigest()
        assert set(pii._listed(base).split(",")) <= {"", *r.spans.split(",")}
    # a repeated number without its prefix is found by the field, a year in brackets isn't
    last = texts[-1]
    spans = got[len(texts) - 1].spans.split(",")
    at = last.index("(321) 555-1234 again")
    assert spans == ["phone:5:22", f"phone:{at}:{at + 14}"], spans
    clean = {r.doc_id: r.text for r in pii.redact(docs, field).collect()}
    assert clean[len(texts) - 1] == "ring [PHONE] today. Later: [PHONE] again, in (2019) and 12 pages"
    assert clean[0] is None and clean[1] == ""
    assert pii.report(docs.limit(0), pii.learn(docs.limit(0))).count() == 0


def _graph_of(rng, n, loops):
    """A random graph of n nodes: a chain, and skip links that close `loops` cycles."""
    chain = np.array([(i, i + 1) for i in range(n - 1)], np.int64).reshape(-1, 2)
    pairs = [(i, j) for i in range(n) for j in range(i + 2, n)]
    skip = [pairs[i] for i in rng.permutation(len(pairs))[:loops]]
    return pii.Graph(rng.normal(size=(n, pii.WIDTH)), -rng.random((n, pii.LABELS)), chain, np.array(skip, np.int64).reshape(-1, 2), rng.integers(0, len(pii.LINKS), len(skip)))


def _enumerated(field, g, given):
    """Label probabilities by the sum over all labellings."""
    n = len(g.x)
    local = g.x @ field.unary + np.array([pii.GIVEN * np.eye(pii.LABELS)[k] if k else d for k, d in zip(given, g.doubts, strict=True)])
    out = np.zeros((n, pii.LABELS))
    total = np.zeros([pii.LABELS] * n)
    for i in range(n):
        total = total + local[i].reshape([-1 if k == i else 1 for k in range(n)])
    for (a, b), potential in [*((e, field.chain) for e in g.chain), *((e, field.skip[k]) for e, k in zip(g.skip, g.links, strict=True))]:
        total = total + potential.reshape([pii.LABELS if k in (a, b) else 1 for k in range(n)])
    p = np.exp(total - total.max())
    for i in range(n):
        out[i] = p.sum(tuple(k for k in range(n) if k != i))
    return out / out.sum(1, keepdims=True)


def test_beliefs_are_those_of_enumeration():
    """Exact on trees; with loops the likeliest label where it is clear, and close to it."""
    rng = np.random.default_rng(17)
    for n, loops in [(1, 0), (2, 0), (5, 0), (8, 0), (4, 1), (6, 1), (7, 2), (8, 2)]:
        for _ in range(6):
            s = rng.normal(size=(3, pii.LABELS, pii.LABELS)) * 0.3 + np.eye(pii.LABELS)
            field = pii.Field(rng.normal(size=(pii.WIDTH, pii.LABELS)) * 0.4, rng.normal(size=(pii.LABELS, pii.LABELS)) * 0.5, (s + s.transpose(0, 2, 1)) / 2)
            g = _graph_of(rng, n, loops)
            given = np.where(rng.random(n) < 0.3, rng.integers(1, pii.LABELS, n), 0)
            got, want = field.beliefs(g, given), _enumerated(field, g, given)
            assert np.abs(got - want).max() < (1e-3 if not loops else 0.12)
            clear = want.max(1) > 0.75
            assert (got.argmax(1) == want.argmax(1))[clear].all()


def _card(rng):
    head = [rng.randrange(1, 10), *(rng.randrange(10) for _ in range(14))]
    return next(n for d in range(10) if pii.luhn(n := "".join(map(str, [*head, d]))))


def test_skip_links_make_labels_consistent(spark):
    """A mistyped card is found where a card stands in the document, and not alone, nor without the skip potentials, nor in lists of other numbers."""
    rng = random.Random(13)
    wrong = lambda: (c := _card(rng))[:-1] + str((int(c[-1]) + 3) % 10)
    rows = [(i, f"pay by {_card(rng)} or {_card(rng)} before {1900 + i % 100} with {i} items") for i in range(80)]
    rows += [(200 + i, f"pay by {_card(rng)} before noon or write to u{i}@mail.example.com, {i} items") for i in range(160)]
    rows += [(100 + i, f"order {wrong()} came with {i} items") for i in range(80)]
    field = pii.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    none = pii.Field(field.unary, field.chain, 0 * field.skip)

    def found(text, by=field):
        _, base, added = pii.search(*tx.bytes_of(pa.array([text])), by)[0]
        return [text[a:b] for a, _, b in base], [text[a:b] for a, _, b in added]

    for _ in range(20):
        good, bad = _card(rng), wrong()
        assert found(f"the card {good} failed, so {bad} was tried in 2019") == ([good], [bad])
        assert found(f"the card {good} failed, so {bad} was tried in 2019", none) == ([good], [])
        assert found(f"the number {bad} was tried in 2019") == ([], [])
    lists = [" ".join(f"id {wrong()} ok" for _ in range(11)) + f" id {_card(rng)} ok" for _ in range(20)]
    assert sum(len(found(t)[1]) for t in lists) <= 0.25 * 11 * 20
    assert found("write to jane.d0e(at)example.com") == ([], ["jane.d0e(at)example.com"])


def test_planted_numbers_in_documents(spark):
    """Of documents with two cards or more one digit is changed: most such numbers are found; documents without personal data stay clean."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    field = pii.learn(docs)
    rng = random.Random(5)
    hit = n = 0
    for r in docs.where("text is not null").orderBy("doc_id").limit(300).collect():
        if pii.base_spans(r.text):
            continue
        assert not pii.search(*tx.bytes_of(pa.array([r.text])), field).get(0, ("", [], []))[2]
        good, bad = _card(rng), (c := _card(rng))[:-1] + str((int(c[-1]) + 3) % 10)
        text = f"{good} {r.text} {bad}"
        n += 1
        hit += (len(text) - 16, 2, len(text)) in pii.search(*tx.bytes_of(pa.array([text])), field)[0][2]
    assert n > 200 and hit >= 0.9 * n


def test_labels_of_nodes():
    rng = random.Random(3)
    text = " ".join(rng.choice(["a1", "x@y.zz", "1.2.3.4", "+1 234 567 8901", "w"]) for _ in range(300))
    nodes = pii.candidate_words(*tx.bytes_of(pa.array([text])))[0]
    base = pii.base_spans(text)
    assert pii.labelled(nodes, base) == [next((k + 1 for a, k, b in base if a < e and b > s), 0) for s, e in nodes.spans]


def test_layout_does_not_matter(spark):
    """The same spans however the rows are dealt out; a long text with many candidates is searched whole."""
    rng = random.Random(9)
    texts = [f"pay {_card(rng)} or {''.join(rng.choices('0123456789', k=16))} and mail u{i}@x{i % 3}.example.com" for i in range(60)]
    long = " ".join(texts) * 40
    docs = spark.createDataFrame(list(enumerate([*texts, long])), "doc_id long, text string")
    field = pii.learn(docs)
    want = sorted(map(tuple, pii.report(docs, field).collect()))
    for parts in (1, 7):
        again = docs.repartition(parts, "doc_id")
        assert sorted(map(tuple, pii.report(again, pii.learn(again)).collect())) == want
    assert dict((r[0], r[1]) for r in want)[len(texts)] == 40 * len(texts)
