import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depthframe.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb").read())
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("ab cdeéß日🙂\n\t0123'stre.!  ", max_size=60), max_size=5))
def test_same_ids_as_the_library_and_back(texts):
    for text, data in zip(texts, OURS.encode(texts), strict=True):
        assert ids(data) == PLAIN.encode_ordinary(text) and OURS.decode(data) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, "ab" * 3000, "\x00\x01\x7f", "<|endoftext|>", "aaaaaaa " * 100])
def test_long_words(text):
    assert ids(OURS.encode([text])[0]) == PLAIN.encode_ordinary(text)
    assert all(len(w) <= bpe.LONGEST_CACHED for w in OURS.known)


def test_a_pair_of_lower_rank_that_a_merge_makes_goes_first():
    # abc has a lower rank than ab has neighbours to come: the replay must not merge all ab first.
    toy = {bytes([i]): i + 10 for i in range(256)} | {b"ab": 300, b"aba": 1, b"ba": 400, b"cab": 2}
    words = [b"ababab", b"abab", b"cabab", b"abaab", b"abababababab"]
    vocabulary = bpe.Vocabulary(toy, ".+")
    merged = [ids(w) for w in vocabulary.replay(words)]

    def one(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            ranked = [(toy[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in toy]
            if not ranked:
                return [toy[p] for p in parts]
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    assert merged == [one(w) for w in words] == [vocabulary.alone(w) for w in words]


def test_both_engines_split_alike(documents):
    for _, text, *_ in documents:
        assert OURS.quick.findall(text) == OURS.pattern.findall(text) and bpe._PLAIN.fullmatch(text)
    for text in ("I'll 've  x\t\n y 12a!?\x0b\x0c é's  ", "''s'''t", " \r\n\r\n a"):
        assert bpe._PLAIN.fullmatch(text) and OURS.quick.findall(text) == OURS.pattern.findall(text)
    assert not bpe._PLAIN.fullmatch("ª") and not bpe._PLAIN.fullmatch("\x1c") and not bpe._PLAIN.fullmatch("²")


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.binary(min_size=2, max_size=4).map(lambda b: bytes(97 + c % 3 for c in b)), st.integers(0, 10_000), max_size=25), st.lists(st.binary(max_size=14).map(lambda b: bytes(97 + c % 3 for c in b)), max_size=6))
def test_any_ranks_are_replayed_as_word_by_word(more, words):
    ranks = {bytes([i]): 20_000 + i for i in range(256)} | {t: 30_000 + k for k, t in enumerate(sorted(more, key=lambda t: (more[t], t)))}
    vocabulary = bpe.Vocabulary(ranks, ".+")
    expected = [[ranks[w]] if w in ranks else vocabulary.alone(w) for w in words]
    assert [ids(w) for w in vocabulary.replay(words)] == expected


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 100)
    small = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    for text in ("the quick brown fox", "jumps over the lazy dog", "the quick brown fox"):
        assert ids(small.encode([text])[0]) == PLAIN.encode_ordinary(text)


def test_query_over_all_documents(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op3_bpe(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for doc_id, text, *_ in documents:
        expected = PLAIN.encode_ordinary(text)
        r = got[doc_id]
        assert r["n_tokens"] == len(expected) and r["ids_sha256"] == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_messy_rows(messy, nothing):
    got = bpe.encode(messy, PATH, public_tokenizers.PATTERN, keep=("source", "ids", "label"), decoded_col="decoded")
    assert got.columns == ["doc_id", "source", "label", "ids", "decoded"]
    both = sorted((bytes(r["decoded"]) for r in got.collect()))
    assert both == sorted((r["text"] or "").encode() for r in messy.collect())
    back = bpe.decode(got.drop("decoded"), PATH, public_tokenizers.PATTERN)
    assert back.where(F.octet_length("decoded") > 0).count() == sum(bool(r["text"]) for r in messy.collect())
    assert bpe.encode(nothing, PATH, public_tokenizers.PATTERN).count() == 0
