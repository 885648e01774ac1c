"""Token counts and sampled segmentations against the libraries and by enumeration."""

import math

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from guichet.llm import segment_sampling as sampling, token_counts
from guichet.llm.queries import BYTE_BPE, PIECE_MODEL
from guichet.llm.text_bytes import mix

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
TEXTS = [
    None, "", " ", "a", "the  the\n\n", "x<|endoftext|>y <|endoftext|>", "é 𝄞 ﬁ\t", "word " * 3000, "a" * 5000,
    "ab" * 2000 + "\n" * 50, "don't I'll we've 12345 !!!??", "日本語 текст", "don't I'll we've 12345 !!!??",
]


@pytest.fixture(scope="module")
def counter():
    with open(BYTE_BPE, encoding="utf-8") as file:
        return token_counts._counter(file.read())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_counts_equal_library(counter, text):
    assert counter(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_long_text_piece_by_piece(counter, monkeypatch):
    text = "the quick brown  fox\n" * 200 + "z" * 900
    want = counter(text)
    monkeypatch.setattr(token_counts, "AT_ONCE", 10)
    assert counter(text) == want


def test_memory_of_counts_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    text = " ".join(f"w{i}q" for i in range(100))
    assert counter(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_count_tokens(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "two words", "clash"), (3, "a", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts.count_tokens(docs, BYTE_BPE, limit=3).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 3))
    assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(docs.limit(0), BYTE_BPE).collect() == []


@pytest.fixture(scope="module")
def vocabulary():
    with open(PIECE_MODEL, "rb") as file:
        return sampling.Vocabulary(file.read())


def every_way(vocabulary, text):
    """All segmentations of a short text with their log weights."""
    marked = sampling.SPACE + text.replace(" ", sampling.SPACE)
    normal = {PIECES.id_to_piece(i): i for i in np.flatnonzero(np.isfinite(vocabulary.log_prob)).tolist()}

    def from_(at):
        if at == len(marked):
            yield (), 0.0
            return
        for end in range(at + 1, min(len(marked), at + vocabulary.longest) + 1):
            if marked[at:end] in normal:
                i = normal[marked[at:end]]
                for rest, weight in from_(end):
                    yield (i, *rest), weight + vocabulary.log_prob[i]
        if marked[at] not in normal:
            data = marked[at].encode()
            for rest, weight in from_(at + 1):
                yield (*vocabulary.bytes[list(data)].tolist(), *rest), weight + vocabulary.byte_log_prob * len(data)

    ways = dict(from_(0))
    total = math.log(sum(map(math.exp, ways.values())))
    return {k: v - total for k, v in ways.items()}


def test_probabilities_and_inclusion(vocabulary):
    text, n = "the é\n𝄞 of", 3000
    ways = every_way(vocabulary, text)
    keys = mix(np.arange(n, dtype=np.uint64) + np.uint64(5))
    estimate, firsts = 0.0, {}
    for found in sampling.sample_texts(vocabulary, [text] * n, keys, 3):
        assert len({tuple(ids.tolist()) for ids, _, _ in found}) == 3
        for ids, log_prob, log_inclusion in found:
            assert log_prob == pytest.approx(ways[tuple(ids.tolist())], abs=1e-9)
            assert log_inclusion <= 0
            # Horvitz-Thompson: probabilities over inclusion probabilities add up to one.
            estimate += math.exp(log_prob - log_inclusion) / n
        first = tuple(found[0][0].tolist())
        firsts[first] = firsts.get(first, 0) + 1 / n
    assert estimate == pytest.approx(1.0, abs=0.02)
    best = max(ways, key=ways.get)
    assert firsts[best] == pytest.approx(math.exp(ways[best]), abs=0.03)


@pytest.mark.parametrize("text", ["a", "ab", "the", "  x", "日\n"])
def test_all_segmentations_of_a_short_text(vocabulary, text):
    ways = every_way(vocabulary, text)
    (found,) = sampling.sample_texts(vocabulary, [text], np.array([7], np.uint64), len(ways) + 5)
    assert {tuple(ids.tolist()) for ids, _, _ in found} == set(ways)
    assert all(log_inclusion == 0 for _, _, log_inclusion in found)


def test_samples_do_not_depend_on_the_batch(vocabulary):
    texts = [t or "" for t in TEXTS]
    keys = mix(np.arange(len(texts), dtype=np.uint64))
    together = sampling.sample_texts(vocabulary, texts, keys, 3)
    for i, text in enumerate(texts):
        (alone,) = sampling.sample_texts(vocabulary, [text], keys[i : i + 1], 3)
        assert [ids.tolist() for ids, _, _ in alone] == [ids.tolist() for ids, _, _ in together[i]]
        assert all(PIECES.decode(ids.tolist()) == text == vocabulary.decode(ids) for ids, _, _ in alone)


def test_sample_segmentations(spark, vocabulary):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", 1), (3, "a", 1), (50, "marked ▁ space", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sample int")
    found = sampling.sample_segmentations(docs, PIECE_MODEL, k=2)
    got = sorted(found.collect(), key=repr)
    again = sorted(sampling.sample_segmentations(docs.repartition(5), PIECE_MODEL, k=2).collect(), key=repr)
    assert got == again
    empty = [r for r in got if r["doc_id"] in (0, 1)]
    assert [(r["sample"], r["ids"], r["log_prob"], r["log_inclusion"]) for r in empty] == [(1, [], 0.0, 0.0)] * 2
    assert all(r["round_trip"] == (r["doc_id"] != 50) for r in got)
    decoded = {(r["doc_id"], r["text"]) for r in sampling.decode(found, PIECE_MODEL).collect()}
    assert decoded == {(i, (t or "").replace("▁", " ")) for i, t, _ in rows}
    assert sampling.sample_segmentations(docs.limit(0), PIECE_MODEL).collect() == []
