"""Tree encoding against the sequential encoder."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb").read())
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODERS = {leaf: bpe.TreeBPE(RANKS, public_tokenizers.PATTERN, leaf) for leaf in (2, 3, 7, 64)}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200), st.sampled_from(sorted(CODERS)))
def test_any_text(text, leaf):
    coder = CODERS[leaf]
    ids = coder.encode(text)
    assert ids == PLAIN.encode_ordinary(text) and coder.decode(ids) == text.encode()


@pytest.mark.parametrize("alphabet", ["abcdefgh", "  ab", "'sretllve ", "\n\t \x1c\x85　ab", "0123 .,!'", "éßñ中😀a", "aA1. '\n", "the of and "])
@pytest.mark.parametrize("leaf", sorted(CODERS))
def test_texts_of_few_characters(alphabet, leaf):
    rnd = random.Random(leaf)
    for _ in range(300):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, rnd.choice([5, 40, 200]))))
        assert CODERS[leaf].encode(text) == PLAIN.encode_ordinary(text)


def test_a_long_word_and_a_long_run():
    rnd = random.Random(1)
    for text in ("".join(rnd.choice("abcdefghijklm") for _ in range(30_000)), "a" * 20_000, " " * 20_000, "1234567890" * 2000, "\n" * 9000 + "x", "!?" * 9000):
        coder = bpe.TreeBPE(RANKS, public_tokenizers.PATTERN)
        assert coder.encode(text) == PLAIN.encode_ordinary(text)


@pytest.mark.parametrize("alphabet", ["0123456789", "!?#*$%&|", "abc0123", "ab'12.!", "é中9٣a'"])
def test_runs_are_joined_where_they_are_cut(alphabet):
    """Long runs without white space: the same tokens, and little more text than the run goes to the sequential encoder."""
    rnd = random.Random(2)
    text = "".join(rnd.choice(alphabet) for _ in range(60_000))
    coder = bpe.TreeBPE(RANKS, public_tokenizers.PATTERN)
    asked = []

    class Counting:
        def __getattr__(self, name):
            return getattr(PLAIN, name)

        def encode_ordinary(self, part):
            asked.append(len(part))
            return PLAIN.encode_ordinary(part)

    coder.sequential = Counting()
    assert coder.encode(text) == PLAIN.encode_ordinary(text) and sum(asked) < 1.5 * len(text)


def test_operators(spark):
    rows = [(1, "Hello  world's 12\n"), (None, None), (3, ""), (3, "naïve 中文 😀 " * 400), (4, "<|endoftext|>")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    tokens = bpe.encode(docs, PATH)
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in tokens.collect()) == sorted((i or 0, PLAIN.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in bpe.decode(tokens, PATH).collect()) == sorted((i or 0, (t or "").encode()) for i, t in rows)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_query(spark):
    got = {r["doc_id"]: r for r in bpe.query(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array(PLAIN.encode_ordinary(d["text"] or ""), "<u4")
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
