import hashlib
import random
import re

import pytest

from pixelloom.llm import decontam


def brute(docs, items, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc, text in docs:
        w, hit, ids = cut(text), set(), set()
        for item, t in items:
            x = cut(t)
            size = min(n, len(x))
            wins = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if size else set()
            for i in range(len(w) - size + 1):
                if size and tuple(w[i : i + size]) in wins:
                    hit |= set(range(i, i + size))
                    ids.add(str(item))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_matches(spark, block_words, monkeypatch):
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta eins zwei drei vier Élan naïve x1 y2 z3 foo bar baz qux quux corge".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 7, 10, 12, 40])))) for i in range(30) if i % 7]
    items += [(100, items[3][1]), (101, None), (102, ""), (9, "twice twice"), (103, "twice Twice")]
    docs = []
    for d in range(120):
        t = " ".join(word() for _ in range(rng.randrange(60)))
        if d % 3 == 0:
            t += ", ".join(["", rng.choice(items)[1] or ""]) + "\n" + " ".join(word() for _ in range(5))
        docs.append((d, t.upper() if d % 5 == 0 else t))
    docs += [(500, None), (501, ""), (502, "twice twice twice"), (503, items[-6][1] or "a"), (0, docs[0][1]), (3, docs[3][1]), (3, docs[3][1]), (None, docs[6][1]), (None, docs[6][1]), (None, None)]
    frame = spark.createDataFrame([(d, t, 9) for d, t in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    real = decontam.matches
    monkeypatch.setattr(decontam, "matches", lambda *a: real(*a, block_words=block_words))
    got = sorted(map(tuple, decontam.report(frame, bench).collect()), key=str)
    assert got == sorted(brute(docs, items), key=str)
    if block_words > 40:
        assert decontam.report(frame, bench.limit(0)).where("contaminated").count() == 0
        assert decontam.report(frame.limit(0), bench).count() == 0


@pytest.mark.parametrize("block_words", [200_000, 5])
def test_items_without_an_id(spark, block_words, monkeypatch):
    """They are hits, and one item of null id, as in the SQL."""
    named, bare, other = ("alpha beta gamma delta", "eins zwei drei vier", "uno due tre quattro")
    docs = spark.createDataFrame([(1, f"{named} x {bare} y {other}"), (2, f"x {bare} y"), (3, "clean words only")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, named), (None, bare), (None, other)], "item_id long, text string")
    real = decontam.matches
    monkeypatch.setattr(decontam, "matches", lambda *a: real(*a, block_words=block_words))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(map(tuple, decontam.report(docs, bench).collect()))
    assert got == [(1, 14, 12, 2, sha("7"), True), (2, 6, 4, 1, sha(""), True), (3, 3, 0, 0, sha(""), False)]
    assert [r.doc_id for r in decontam.clean_documents(docs, bench, block_words=block_words).collect()] == [3]
