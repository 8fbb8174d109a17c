"""The automaton that carries last tokens along words: what it finds, and the calls that it takes."""

import random
import sys

import pytest

pytest.importorskip("public_tokenizers")
from public_tokenizers import path

from tallyspark.llm import bpe
from tallyspark.llm.token_counts import PrefixCounts
from tallyspark.llm.word_bpe import TrieEncoder

BYTE, WORD = path("byte_bpe_50k.json"), path("word_bpe_49k.json")


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(("en", "st", "io", "q", "ß", "é", "the", "ation", "x", "漢", "0", "zz")) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def calls(walk, asked):
    count = [0]
    sys.setprofile(lambda frame, event, arg: count.__setitem__(0, count[0] + (event == "call")))
    try:
        for _ in walk(asked):
            pass
    finally:
        sys.setprofile(None)
    return count[0]


@pytest.mark.parametrize("make, path", [(PrefixCounts, BYTE), (TrieEncoder, WORD)])
def test_a_word_takes_a_few_calls_whatever_its_length(make, path):
    coder, asked = make(path), sorted({*words(400, 1)})
    for _ in coder.walk(asked):  # what the words share is worked out once
        pass
    assert calls(coder.walk, asked) < 6 * len(asked) < sum(map(len, asked))


@pytest.mark.parametrize("pairs", [5, 300_000])
@pytest.mark.parametrize("path, mark", [(BYTE, ""), (WORD, bpe.END)])
def test_steps_find_the_last_tokens(monkeypatch, pairs, path, mark):
    monkeypatch.setattr(bpe, "MOST_PAIRS", pairs)
    m = bpe.Merges(path)
    for word in words(300, 2):
        word = m.symbols(word)
        nodes, rights, starts, last = [m.root], [{}], [0], [""]
        m.extend(word + mark, nodes, rights, starts)
        for end in range(1, len(word) + 1):
            start = m.last_start(word, end, last)
            last.append(word[start:end])
            assert starts[end] == start
        assert starts[-1] == m.last_start(word, len(word), last, mark)
        assert sum(map(len, m.rights.values())) <= pairs
