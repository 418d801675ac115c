"""Held-out accuracy and defined cases of the learned operators."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import _text as tx
from pixelloom.llm import langid, quality_gbdt, toxicity

SYLLABLES = {"en": ["the", "ing", "wh", "tion", "and", "ly", "ou"], "de": ["sch", "ung", "ein", "keit", "der", "ü", "pf"], "es": ["ción", "ado", "ll", "rr", "que", "ñ", "os"]}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        words = [word(rng, lang) for _ in range(rng.randint(20, 120))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.25
        if not good:
            words = [w + rng.choice(["$$$", "###", "&&&"]) for w in words]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "blorkface", "grimwit"]))
        rows.append((i, " ".join(words) + ".", lang, 0.0))
        labels.append((i, int(good), int(toxic)))
    extra = [(1000, None, "en", 0.0), (1001, "", None, 0.0), (1002, "123 !?", "de", 0.0), (1003, "the and", None, 0.0), (None, "the and the", "en", 0.0), (7, rows[7][1], rows[7][2], 0.0)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame(labels + [(5, None, None), (5, labels[5][1], labels[5][2]), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    return docs.cache(), marks.cache(), dict((r[0], r) for r in rows), dict((r[0], r) for r in labels)


def test_language(corpus):
    docs, _, rows, _ = corpus
    got = langid.report(docs, per_lang=60).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert held and all(fold(r.doc_id, 4) == 2 for r in held)
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "en" and 0 <= by[1003].score <= 1
    assert langid.report(docs.limit(0)).count() == 0
    none = langid.report(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_code_lengths_are_those_of_the_trees():
    """Against a walk of the context tree, byte by byte."""
    counts = {}
    for lang, text in (("a", "abracadabra abra cad"), ("b", "banana bandana ban")):
        data, at = tx.bytes_of(pa.array([text]))
        counts[lang] = {}
        for n in range(1, 5):
            keys, c = np.unique(langid.grams(data, at, n)[1], return_counts=True)
            counts[lang] |= dict(zip(keys.tolist(), c.tolist(), strict=True))
    models = langid.Models(counts)

    def cost(lang, context, byte):
        n = len(context) + 1
        key = int.from_bytes(bytes([n]) + context + bytes([byte]), "big")
        follow = {k & 255: v for k, v in counts[lang].items() if k >> 8 == key >> 8}
        total, kinds = sum(follow.values()), len(follow)
        if byte in follow:
            return -math.log2(follow[byte] / (total + kinds))
        escape = -math.log2(kinds / (total + kinds)) if total else 0.0
        return escape + (cost(lang, context[1:], byte) if context else 8.0)

    texts = ["abracadabra", "bandana", "xyz abqé", "", "a"]
    got = models.lengths(*tx.bytes_of(pa.array(texts)))
    for i, t in enumerate(texts):
        raw = t.encode()
        for j, lang in enumerate(models.langs):
            want = sum(cost(lang, raw[max(0, k - 3) : k], raw[k]) for k in range(len(raw)))
            assert got[i, j] == pytest.approx(want, rel=1e-5)


def test_quality(corpus):
    docs, marks, _, labels = corpus
    got = quality_gbdt.report(docs, marks).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in held]) > 0.95
    assert quality_gbdt.report(docs.limit(0), marks).count() == 0
    alone = quality_gbdt.report(docs.limit(3), marks.limit(0)).collect()
    assert {r.score for r in alone} == {0.5}


def test_trees_walk_as_they_say():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(quality_gbdt.FEATURES)))
    y = (x[:, 3] * x[:, 5] > 0).astype(float)
    trees = quality_gbdt.train(x, y, trees=30, depth=3)

    def walk(row):
        margin = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            margin += leaf[node - len(f)]
        return 1 / (1 + math.exp(-margin))

    assert np.allclose(trees.score(x), [walk(r) for r in x])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9


def test_toxicity(corpus):
    docs, marks, _, labels = corpus
    got = toxicity.report(docs, marks).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert held and all(fold(r.doc_id, 5) == 0 for r in held)
    assert np.mean([r.predicted == labels[r.doc_id][2] for r in held]) > 0.95
    assert toxicity.report(docs.limit(0), marks).count() == 0


@pytest.mark.parametrize(
    ("clause", "pattern"),
    [("what an idiot", "insult"), ("you are an idiot", "insult_at_target"), ("idiot that you are", "insult_at_target"), ("he is not an idiot", "insult_negated"), ("they called this idiot a friend", "insult_reported"), ("i will kill you", "threat_at_target"), ("to kill time", "threat")],
)
def test_grammar(clause, pattern):
    grammar = toxicity.Grammar({})
    found = grammar.counts(*tx.bytes_of(pa.array([clause.upper() + ". nothing else here"])))[0]
    assert [p for p, v in zip(toxicity.PATTERNS, found, strict=False) if v] == [pattern]
    plain, negated = (grammar.score(grammar.counts(*tx.bytes_of(pa.array([t]))))[0] for t in ("such an idiot", "not an idiot"))
    assert plain > negated


def _in_turn(symbols):
    """What the five transducers write and weigh, one after the other."""
    total = 0.0
    for t in (toxicity.insults(), toxicity.threats(), toxicity.negations(), toxicity.reports(), toxicity.targets()):
        symbols, weight = t.read(symbols)
        total += weight
    return symbols, total


def test_composition_is_reading_in_turn():
    """All clauses of up to five words, and random longer ones; one pattern for each mark."""
    rng = random.Random(2)
    clauses = [c for n in range(6) for c in itertools.product(range(6), repeat=n)]
    clauses += [tuple(rng.choices(range(6), k=rng.randint(6, 40))) for _ in range(500)]
    for c in clauses:
        patterns, weight = toxicity.machine().read(c)
        want, total = _in_turn(c)
        assert patterns == want and abs(weight - total) < 1e-9, c
        assert len(patterns) == sum(k in (toxicity.INSULT, toxicity.THREAT) for k in c)


def _brute_patterns(kinds):
    """The pattern of each mark of a clause, said word by word."""
    t, out = toxicity, []
    for i, k in enumerate(kinds):
        if k not in (t.INSULT, t.THREAT):
            continue
        before = kinds[:i]
        negated = t.NEGATION in before[-t.REACH :]
        reported = t.REPORT in before
        at = t.TARGET in before[-t.REACH :]
        if not at:  # a target after it, before any other mark
            for later in kinds[i + 1 : i + 1 + t.REACH]:
                if later in (t.INSULT, t.THREAT):
                    break
                if later == t.TARGET:
                    at = True
                    break
        kind = "insult" if k == t.INSULT else "threat"
        if negated or reported:
            out.append(t.NOTHING if k == t.THREAT else "insult_negated" if negated else "insult_reported")
        else:
            out.append(f"{kind}_at_target" if at else kind)
    return out


def test_grammar_against_words_said_one_by_one():
    rng = random.Random(4)
    clauses = [c for n in range(6) for c in itertools.product(range(6), repeat=n)] + [tuple(rng.choices(range(6), k=rng.randint(6, 30))) for _ in range(2000)]
    for c in clauses:
        assert toxicity.machine().read(c)[0] == _brute_patterns(c), c


def test_learned_words_and_layout(corpus, spark):
    """The learned words as counted one by one, and the same scores however rows are dealt out."""
    docs, marks, rows, labels = corpus
    train = marks.where("doc_id < 1000")
    grammar = toxicity.learn(docs.where("doc_id < 1000"), train)
    places = {0: {}, 1: {}}
    for r in docs.where("doc_id < 1000").collect():
        for label in {m.toxic for m in train.where(f"doc_id = {r.doc_id}").collect()} if r.doc_id in (5, 7) else {labels[r.doc_id][2]}:
            words = [""] + re.findall(r"[0-9a-z\u0080-\U0010ffff]+", r.text.lower()) + [""]
            for a, w, b in zip(words, words[1:], words[2:]) if label is not None else ():
                places[label].setdefault(w, set()).add((a, b))
    count = {label: {w: len(p) for w, p in own.items()} for label, own in places.items()}
    toxic, clean = (sum(count[k].values()) for k in (1, 0))
    want = {w for w, n in count[1].items() if n >= 5 and (n + 0.5) / (count[0].get(w, 0) + 0.5) * clean / toxic >= 12.0}
    assert want and set(grammar.insults) == want | set(toxicity.SEEDS[toxicity.INSULT].split())
    got = [sorted((r.doc_id or -1, r.score, r.held_out) for r in toxicity.report(docs.repartition(n), marks).collect()) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2]


def test_long_texts(corpus, spark):
    """Half a million words of one text are scored whole by the learned operators."""
    docs, marks, *_ = corpus
    clean = "the andly wh ing " * 150_000
    rows = spark.createDataFrame([(1, clean + "you are an idiot"), (2, clean), (3, "x" * 3_000_000)], "doc_id long, text string")
    grammar = toxicity.Grammar({})
    scores = {r.doc_id: r.matches for r in toxicity.score(rows, grammar).collect()}
    assert scores[1][1] > 0 and not any(scores[2][:-1]) and not any(scores[3][:-1])
    trees = quality_gbdt.learn(docs, marks)
    assert len(quality_gbdt.score(rows, trees).collect()) == 3
    got = {r.doc_id: r.lang_pred for r in langid.report(docs.select("doc_id", "text", "lang").union(rows.selectExpr("doc_id + 5000", "text", "cast(null as string)")), per_lang=60).where("doc_id > 5000").collect()}
    assert got[5001] == got[5002] == "en" and len(got) == 3


def test_repeated_and_null_ids_in_training(corpus, spark):
    """Ids that repeat give a row for each, null ids teach nothing, and samples stay bounded."""
    from pixelloom.llm import _sample

    docs, marks, *_ = corpus
    many = docs.where("doc_id = 7").crossJoin(spark.range(500)).drop("id")
    both = docs.union(many).union(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    labels = marks.where("quality is not null").select("doc_id", F.col("quality").alias("label"))
    picked = _sample.chosen_texts(both, labels, 10_000)
    assert picked.where("doc_id is null").count() == 0 and picked.where("doc_id = 7").count() >= 501
    assert _sample.chosen_texts(both, labels, 100).count() <= 200
    same = spark.range(5000).selectExpr("cast(1 as long) doc_id", "'x' text")
    assert _sample.thinned(same, 100, "doc_id", "text").count() <= 200
    assert _sample.thinned(same.limit(0), 100, "doc_id").count() == 0
    assert 60 <= _sample.thinned(spark.range(5000), 100, "id").count() <= 150
    assert len(quality_gbdt.report(both, marks).collect()) == both.count()
    assert len(toxicity.report(both, marks).collect()) == both.count()
