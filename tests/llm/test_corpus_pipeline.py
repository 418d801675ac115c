import hashlib
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def _texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ten", "sur", "be", "ru"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(14)
    base = prose(200)
    clean = [prose(120) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(10, base), (11, base), (11, base), (12, base.upper()), (20, prose(60) + " " + item + " " + prose(60)), (30, "same words again " * 60), (31, None), (32, ""), (33, "short")]
    rows += [(40, prose(70) + " mail me at a.b@c.example.com or +1 (222) 555-1234 " + prose(10)), (None, prose(90)), (None, prose(80))]
    return rows, item, clean


def test_stages(spark, tmp_path):
    import tiktoken

    from pixelloom.llm import bpe, queries

    rows, item, clean = _texts()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1.5) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _rows double")
    spark.createDataFrame([(1, item), (2, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        if name != "token_ids":
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        found[name] = kept.collect()
    ids = lambda name: sorted((r.doc_id for r in found[name]), key=lambda x: (x is None, x))
    assert ids("quality_rules") == [0, 1, 2, 3, 4, 5, 10, 11, 11, 12, 20, 40, None, None]
    assert ids("near_dedup") == [0, 1, 2, 3, 4, 5, 10, 20, 40, None, None]
    assert ids("decontamination") == [0, 1, 2, 3, 4, 5, 10, 40, None, None]
    texts = {r.doc_id: r.text for r in found["personal_data"]}
    assert [texts[i] for i in range(6)] == clean
    assert "mail me at [EMAIL] or [PHONE] " in texts[40]
    v = bpe.Vocabulary.load(queries.tokenizer_path())
    import public_tokenizers

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    for r in found["token_ids"]:
        if r.doc_id is not None:
            assert r.token_ids == library.encode_ordinary(texts[r.doc_id])
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_repeated_rows_leave_one(spark):
    from pixelloom.llm import simhash

    docs = spark.createDataFrame([(5, "a b c d", 1), (5, "a b c d", 1), (5, "other words here now", 2), (3, "other words here now", 3), (None, None, 4), (None, "", 5)], "doc_id long, text string, component_id int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.keep_one(docs).collect())
    assert got == [(False, 3, "other words here now"), (False, 5, "a b c d"), (True, 0, "")]


def test_empty_tables_and_clashing_names(spark, tmp_path):
    """Every stage on no rows, and on rows whose other columns are named like a stage's own."""
    names = "doc_id long, text string, fp long, head long, number long, digest long, row string, shingles string, root long, n long, text_crc32 long"
    empty = spark.createDataFrame([], names)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "token_ids" or out.columns == empty.columns), name
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(120))
    full = spark.createDataFrame([(i, text if i < 3 else text[::-1], *[7] * 4, "r", "s", 1, 2, 3) for i in range(4)], names)
    for name, stage in corpus_pipeline.STAGES:
        full = stage(spark, full, str(tmp_path))
        full.write.parquet(f"{tmp_path}/full_{name}")
        full = spark.read.parquet(f"{tmp_path}/full_{name}")
    assert sorted(r.doc_id for r in full.collect()) == [0, 3]


def test_long_text_through_all_stages(spark, tmp_path):
    rng = random.Random(4)
    long = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(150_000))
    spark.createDataFrame([(1, "aa bb cc")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, long[::-1] + " write to a@b.cc")], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert {r.doc_id: r.n_tokens > 150_000 for r in docs.collect()} == {1: True, 3: True}


def test_null_ids_decode_to_nothing(spark):
    from pixelloom.llm import bpe, queries

    v = bpe.Vocabulary.load(queries.tokenizer_path())
    rows = spark.createDataFrame([(1, None), (2, []), (3, [65, 66])], "doc_id long, token_ids array<int>")
    got = {r.doc_id: bytes(r.data) for r in bpe.decode_documents(rows, v).collect()}
    assert got[1] == got[2] == b"" and len(got[3]) >= 2
