import collections
import random
import zlib

import numpy as np

from pixelloom.llm import sharding


def test_shards(spark):
    rng = random.Random(6)
    texts = ["word " * rng.randint(1, 60) + str(i) for i in range(3000)] + ["the same text again"] * 1500 + [None, ""] * 20 + ["long " * 4000]
    rows = [(i % 4400, t, 1) for i, t in enumerate(texts)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, size int"), shards=10).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert len(by) == 10 and max(sizes) / np.mean(sizes) < 1.02
    # rows of a text of few rows stay together
    homes = collections.defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    assert max(len(homes[zlib.crc32(t.encode())]) for t in texts[:3000]) == 1


def test_groups_have_one_home(spark):
    """Every group that is smaller than an even shard has one home, those above are cut, and sizes are even."""
    rng = random.Random(11)
    texts = [("w%d " % i) * rng.randint(20, 90) for i in range(1500)]
    rows = [t for t in texts for _ in range(rng.choice([1, 1, 2, 3, 8]))] + ["large group " * 10] * 260 + ["half a shard " * 20] * 60 + [""] * 150
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sharding.assign_shards(docs, shards=20).collect()
    homes, sizes, n = collections.defaultdict(set), collections.Counter(), collections.Counter()
    for r in got:
        homes[rows[r.doc_id]].add(r.shard)
        sizes[r.shard] += r.size
        n[rows[r.doc_id]] += 1
    words = {t: len(t.split()) for t in n}
    total = [sum(len(t) + 16 for t in rows), sum(map(len, (t.split() for t in rows))), len(rows)]
    for t, k in n.items():
        share = max(k * (len(t) + 16) / total[0], k * words[t] / total[1], k / total[2]) * 20
        assert len(homes[t]) == 1 or share > 1, (t[:20], k)
    assert len(homes["large group " * 10]) > 1 and len(homes["half a shard " * 20]) == 1
    assert max(sizes.values()) / (total[0] / 20) < 1.01
    again = sharding.assign_shards(docs.repartition(5), shards=20).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def _brute_pack(vectors, shards, slack=1.002):
    """The packing said item by item, shard by shard."""
    total = [sum(v[k] for v in vectors) or 1 for k in range(3)]
    items = [[v[k] / total[k] * shards for k in range(3)] for v in vectors]
    left, out = [[1.0] * 3 for _ in range(shards)], [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-max(items[i]), -items[i][0], i)):
        best = None
        for s in range(shards):
            if left[s][0] + slack - 1 >= items[i][0] and min(left[s]) > -0.05:
                score = sum(a * b for a, b in zip(left[s], items[i], strict=True))
                if best is None or score > best[0] + 1e-12:
                    best = (score, s)
        if best is None:
            best = max(((left[s][0], s) for s in range(shards)), key=lambda x: (x[0], -x[1]))
        out[i] = best[1]
        left[best[1]] = [a - b for a, b in zip(left[best[1]], items[i], strict=True)]
    return out


def test_pack_is_the_greedy_rule():
    rng = np.random.default_rng(8)
    for shards, n in ((3, 40), (7, 200), (5, 3)):
        vectors = rng.lognormal(2, 1, (n, 3))
        assert sharding.pack(vectors, shards).tolist() == _brute_pack(vectors.tolist(), shards)


def test_long_texts_and_one_text_for_all(spark):
    docs = spark.createDataFrame([(i, "z " * 1_500_000) for i in range(3)] + [(i, "w") for i in range(3, 40)], "doc_id long, text string")
    got = sharding.assign_shards(docs, shards=4).collect()
    assert len(got) == 40 and {r.size for r in got} == {3_000_016, 17}
    same = spark.range(20_000).selectExpr("id doc_id", "'the same' text")
    counts = collections.Counter(r.shard for r in sharding.assign_shards(same, shards=8).collect())
    assert len(counts) == 8 and max(counts.values()) < 1.02 * 2500


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id long, text string")
    got = sharding.assign_shards(docs).collect()
    assert len(got) == 3 and all(0 <= r.shard < 40 and r.slot >= 0 for r in got)
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_packing_balances_all_dimensions():
    rng = np.random.default_rng(4)
    items = rng.lognormal(3, 1, (4000, 3))
    shard = sharding.pack(items, 16)
    loads = np.stack([np.bincount(shard, items[:, k], 16) for k in range(3)], 1)
    assert (loads.max(0) / loads.mean(0) < 1.05).all()
