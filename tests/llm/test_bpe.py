import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from pixelloom.llm import _text as tx
from pixelloom.llm import bpe, queries


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(queries.tokenizer_path())


@pytest.fixture(scope="module")
def library(vocabulary):
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


PIECES = ["'", "'s", "'ll", "'re", " ", "  ", "\n", "\t", "　", "a", "don't", "é", "中", "١", "Ⅷ", "!", "''", "_", "😀", "​", "\x1c", "\x85", "I'M", " '", "x" * 300, "²", "́", "<|endoftext|>"]


def texts():
    rng = random.Random(5)
    return ["", *("".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(3000)), "ab" * 60_000, " " * 9000, "z" * 20_000 + " q"]


def test_encodes_as_the_library(vocabulary, library):
    codec = bpe.Codec(vocabulary, kept=50)
    many = texts()
    data, at = tx.bytes_of(pa.array(many))
    ids, first = codec.encode(data, at)
    for d, t in enumerate(many):
        assert ids[first[d] : first[d + 1]].tolist() == library.encode_ordinary(t)
    assert codec.decode(ids).tobytes() == "".join(many).encode()


def test_hash_is_minimal_and_perfect(vocabulary):
    assert sorted(vocabulary.entry.tolist()) == list(range(len(vocabulary.ranks)))
    found = vocabulary.find(vocabulary.keys, vocabulary.blob, vocabulary.at[:-1], vocabulary.at[1:])
    assert (found == np.arange(len(found))).all()


def test_documents(spark, vocabulary, library):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello world's end", "c"), (3, "Hello world's end", "c"), (None, "é" * 50, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.round_trip(docs, vocabulary).collect()), key=str)
    want = []
    for d, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode_documents(bpe.encode_documents(docs, vocabulary), vocabulary)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.round_trip(docs.limit(0), vocabulary).count() == 0


def test_unknown_ids_are_errors(vocabulary):
    with pytest.raises(ValueError):
        bpe.Codec(vocabulary).decode(np.array([50_256], np.uint32))
