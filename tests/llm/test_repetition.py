import random
import re

import pyarrow as pa

from pixelloom.llm import _text as tx
from pixelloom.llm import repetition


def brute(text, rules=repetition.Rules()):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def inside(n):
        places = {}
        for i in range(len(words) - n + 1):
            places.setdefault(tuple(words[i : i + n]), []).append(i)
        return {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + n)}

    seen, lines, chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own:
            if line in seen:
                lines, chars = lines + 1, chars + sum(map(len, own))
            seen.add(line)
    total = sum(map(len, words))
    three = len(inside(3))
    failed = len(words) < 50 or 100 * three > 50 * len(words)
    cover = [sum(len(words[j]) for j in inside(n)) / max(total, 1) for n, _ in rules.coverage]
    kept = not failed and chars / max(total, 1) <= rules.line_coverage and all(c <= m for c, (_, m) in zip(cover, rules.coverage, strict=True))
    return (len(words), total, len(re.findall(r"[#*$%&|<>]", text)), lines, three, failed, kept)


def _texts():
    rng = random.Random(2)
    out = [None, "", "\n \n", "a", "é é é é é", "x " * 500, "one line\n" * 30, "w" * 200_000]
    vocabulary = ["alpha", "beta", "gamma", "δέλτα", "ei#n", "zw|ei", "<drei>", "v"]
    for _ in range(150):
        size = rng.choice([3, 8, 8000])
        out.append("".join(rng.choice(vocabulary[:size]) + (str(rng.randrange(size)) if size > 8 else "") + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(rng.randrange(200))))
    return out


def test_measures():
    texts = _texts()
    found = repetition.measure(*tx.bytes_of(pa.array(texts)))
    for i, t in enumerate(texts):
        assert tuple(found[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) == brute(t)


def test_documents(spark):
    texts = [*_texts()[:30], _texts()[20]]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    got = sorted(map(tuple, repetition.repetition_rules(docs).drop("line_coverage", "coverage").collect()))
    assert got == [(i, *brute(t)) for i, t in enumerate(texts)]
    kept = repetition.keep_documents(docs)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts) if brute(t)[-1]]
    assert repetition.repetition_rules(docs.limit(0)).count() == 0
