import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pixelloom.llm import _text as tx
from pixelloom.llm import simhash


def brute_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, budget=2):
    """rows: (doc_id, fingerprint)."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    prints = sorted({fp for _, fp in rows})
    for i, a in enumerate(prints):
        for b in prints[i:]:
            if (a ^ b).bit_count() <= budget:
                up[root(a)] = root(b)
    least = {}
    for doc, fp in rows:
        least[root(fp)] = min(doc, least.get(root(fp), doc))
    return [(doc, fp, least[root(fp)]) for doc, fp in rows]


TEXTS = ["", None, " \n", "One", "one two", "One two THREE four five", "Ünï ödd wörds ÀÉ ok", "x " * 700, "a\tb\x0bc\x0cd  e\n\nf g", "\x1c y z q " * 300]


def test_fingerprints():
    found = simhash.fingerprints(*tx.bytes_of(pa.array(TEXTS)), 3)
    assert found.tolist() == [brute_print(t) for t in TEXTS]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_components(spark, hot):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(base[rng.integers(60)]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(500)]
    near += [int(base[0]) ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    prints = sorted({*near, 0, 1, 3, 2**64 - 1})
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in prints]
    edges = simhash.link_forest(spark.createDataFrame(signed, "fp long"), 2, hot)
    roots = dict((r.node, r.root) for r in simhash.components(edges).collect())
    got, want = {}, {}
    for i, (x, (s,)) in enumerate(zip(prints, signed, strict=True)):
        got.setdefault(roots.get(s, s), []).append(i)
    for i, _, low in brute_components([(i, x) for i, x in enumerate(prints)]):
        want.setdefault(low, []).append(i)
    assert sorted(got.values()) == sorted(want.values())


def test_documents(spark):
    base = "the quick brown fox jumps over the lazy dog and then some more words follow it here"
    texts = [*TEXTS, base, base.upper(), base, base + " tail"]
    rows = [(7 * i % 101, t, "x") for i, t in enumerate(texts)] + [(3, base, "y"), (3, base, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == sorted(brute_components([(d, brute_print(t)) for d, t, _ in rows]))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [50_000, 20])
def test_similar_texts_leave_one(spark, hot):
    """Copies with some words changed go, texts that share a part stay."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 7)))
    base = [[word() for _ in range(int(rng.integers(80, 300)))] for _ in range(60)]
    rows, groups = [], {}
    for g, words in enumerate(base):
        for copy in range(1 + 3 * (g % 4 == 0) + 60 * (g == 0)):
            own = list(words)
            if copy:
                own[int(rng.integers(len(own)))] = word()
            rows.append((1000 * g + copy, " ".join(own)))
            groups[1000 * g + copy] = g
    half = [(70_000 + g, " ".join(base[g][: len(base[g]) // 2] + [word() for _ in range(len(base[g]))])) for g in range(1, 20)]
    docs = spark.createDataFrame(rows + half, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(docs, hot=hot).collect())
    assert kept == sorted([1000 * g for g in range(60)] + [d for d, _ in half])


def test_wide_prints_differ_as_similarity_says():
    rng = np.random.default_rng(5)
    for similarity in (0.8, 0.9):
        shared = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
        gaps = []
        for k in range(40):
            common = shared[k * 400 : k * 400 + 400]
            rest = int(400 * (1 / similarity - 1) / 2)
            a, b = (np.concatenate([common, rng.integers(0, 1 << 63, rest, dtype=np.uint64)]) for _ in range(2))
            prints = [np.array([simhash.majority(tx.mix(h + np.uint64(i * 7)), np.array([0, len(h)]))[0] for i in range(simhash.WIDE)]) for h in (a, b)]
            gaps.append(int(simhash.popcount(prints[0] ^ prints[1]).sum()))
        limit = simhash.most_bits(similarity)
        assert np.mean(np.array(gaps) <= limit) > 0.7 and np.mean(gaps) < limit < np.mean(gaps) + 25


def _jaccard(a, b, n=5):
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("group", [250, 30])
def test_texts_of_one_template_stay(spark, group, monkeypatch):
    """Many texts below the similarity share a long passage: all stay, while a copy at the similarity goes."""
    monkeypatch.setattr(simhash._gone, "__defaults__", (group,))
    rng = np.random.default_rng(21)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    shared = words(246)
    texts = [" ".join(shared + words(44)) for _ in range(100)]
    assert 0.7 < _jaccard(texts[0], texts[1]) < 0.8
    near = " ".join([*texts[7].split()[:-20], *words(20)])
    assert _jaccard(texts[7], near) >= 0.8
    docs = spark.createDataFrame([*enumerate(texts), (500, near)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == list(range(100))


def test_jaccard_forest_links_all_pairs():
    rng = np.random.default_rng(22)
    sets = [np.unique(rng.choice(60, 40 + int(rng.integers(8)), replace=False)).astype(np.uint64) for _ in range(30)]
    sets += [np.append(s, np.uint64(100 + i)) for i, s in enumerate(sets[:8])] + [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    at = np.cumsum([0, *map(len, sets)])
    for parts in (np.full(len(sets), -1), np.arange(len(sets)) % 2):
        want = simhash.Forest(len(sets))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if (parts[i] < 0 or parts[i] != parts[j]) and (both >= 0.7 * (len(a) + len(b) - both)):
                    want.add(np.array([i]), np.array([j]))
        got = simhash.jaccard_forest(np.concatenate(sets), at, parts, 0.7)
        every = np.arange(len(sets))
        assert np.array_equal(got.roots(every), want.roots(every))


def test_repeated_ids_with_other_texts(spark):
    """An id that stands on two texts doesn't make one group of them."""
    a, b = ("first text of its own " * 3).strip(), ("wholly other words stand here now " * 3).strip()
    docs = spark.createDataFrame([(5, a), (5, b), (7, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == [(5, a), (5, b)]


def _linked(texts, similarity=0.8, n=5):
    """Pairs of texts (id, text) of at least the similarity, by counting the shingles that they share."""
    sets, holders, shared = {}, {}, {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
        for g in sets[i]:
            for j in holders.setdefault(g, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            holders[g].append(i)
    pairs = {(a, b) for (a, b), k in shared.items() if k >= similarity * (len(sets[a]) + len(sets[b]) - k) - 1e-9}
    empty = [i for i, s in sets.items() if not s]
    return pairs | set(zip(empty, empty[1:], strict=False))


def test_documents_against_all_pairs(spark):
    """On real documents: nothing goes that has no text of the similarity, and 0.9 of those that should go do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    forest = simhash.Forest(len(texts))
    place = {d: k for k, (d, _) in enumerate(texts)}
    pairs = _linked(texts)
    for a, b in pairs:
        forest.add(np.array([place[a]]), np.array([place[b]]))
    roots = forest.roots(np.arange(len(texts)))
    should = {texts[k][0] for k in range(len(texts)) if roots[k] != k}
    gone = {d for d, _ in texts} - {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()}
    assert gone <= should and len(gone) >= 0.9 * len(should) > 20


@pytest.mark.parametrize(("hot", "group"), [(50_000, 250), (15, 20)])
def test_large_group_of_near_copies(spark, hot, group, monkeypatch):
    """A third of the rows are near copies of one text, unlike each other by parts: pivots and pairs of pieces find what all pairs find."""
    monkeypatch.setattr(simhash._gone, "__defaults__", (group,))
    rng = np.random.default_rng(31)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    base = word(200)
    rows = []
    for i in range(120):
        own = list(base)
        for k in rng.choice(200, int(rng.integers(0, 7)), replace=False):
            own[int(k)] = word(1)[0]
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(word(100))) for i in range(200)] + [(3000, ""), (3001, None), (3002, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    forest, pairs = simhash.Forest(len(rows)), _linked(rows)
    place = {d: k for k, (d, _) in enumerate(rows)}
    for a, b in pairs:
        forest.add(np.array([place[a]]), np.array([place[b]]))
    roots = forest.roots(np.arange(len(rows)))
    want = [rows[k][0] for k in range(len(rows)) if roots[k] == k]
    got = sorted(r.doc_id for r in simhash.keep_one(docs, hot=hot).collect())
    assert got == want and len(want) < 310


def test_heads_meet():
    """Words of a band that differ in three bits at the most share a head at every level; parents are those of the level above."""
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 32, 300, dtype=np.uint64)
    for bits in range(4):
        other = words.copy()
        for i in range(len(other)):
            for b in rng.choice(32, bits, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        for level in range(3):
            a, b = (np.stack([h for _, h in simhash.heads_of(w, 5, level)]) for w in (words, other))
            assert (a == b).any(0).all() and (a & np.uint64(15) == 5).all()
    parents = np.concatenate([p for p, _ in simhash.heads_of(words, 5, 1)])
    assert set(parents.tolist()) == set(np.concatenate([h for _, h in simhash.heads_of(words, 5, 0)]).tolist())


def test_no_links_take_no_rounds(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert simhash.components(none).count() == 0


def test_a_long_text(spark):
    rows = [(1, "a b c d e f " * 300_000), (2, "A b c d e f " * 300_000), (3, "x" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()) == [1, 3]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[1] == got[2] == 1
