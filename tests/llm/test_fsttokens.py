"""Counts of the compiled transducers against the tokenizers library."""
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from schemaloom.llm import fsttokens as ft
from schemaloom.llm.bpe import Vocabulary
from schemaloom.llm.queries import BYTE_BPE, WORD_BPE, vocabulary

from .test_tokens import fuzz


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(vocabulary(WORD_BPE))


def hostile():
    rng = random.Random(5)
    out = ["".join(rng.choice("aeinrst'lv re!2") for _ in range(rng.randrange(300)))
           for _ in range(800)]
    out += ["a" * n for n in range(1, 120)] + ["ha" * n for n in range(60)]
    out += ["'" * n + s for n in range(5) for s in ("re", "r", "r e", "ll", "l", "'ve", "v'e", "s", "1")]
    out += ["".join(rng.choice(["lol", "the", "ing", "er", "aa", "!!", "ß", "é"]) for _ in range(400))
            for _ in range(60)]
    return out


def test_counts_equal_library(lib, odd_rows, monkeypatch):
    values = fuzz(600) + hostile() + [t or "" for _, t in odd_rows]
    want = [len(lib.encode(v, add_special_tokens=False).ids) for v in values]
    coder = ft.Counter(Vocabulary(vocabulary(WORD_BPE)))
    assert coder.count(values) == want
    assert coder.count(values) == want  # from the tables
    monkeypatch.setattr(ft, "SEGMENT", 50)  # pieces and contractions cut anywhere
    monkeypatch.setattr(ft, "STATES", 20)  # tables that start anew all the time
    monkeypatch.setattr(ft, "CACHE", 5)
    coder.machine.clear()
    short = [k for k, v in enumerate(values) if len(v) < 500][::4] + [len(values) - 5]
    assert coder.count([values[k] for k in short]) == [want[k] for k in short]


def test_pieces_equal_pattern():
    """Chunks of 64 characters cut words, contractions and runs at any place."""
    classes = ft.character_classes()
    for value in hostile() + ["x" * 1000 + "'re" * 200]:
        begin, end = ft.pieces(value + " ", classes)
        assert [(m.start(), m.end()) for m in regex.finditer(ft.PATTERN, value)] == list(
            zip(begin.tolist(), end.tolist()))


def test_state_maps_compose():
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, 10, 10_000).astype(np.uint8)
    state, want = ft.CLOSED, []
    for k in kinds:
        want.append(ft.SAYS[state, k])
        state = ft.NEXT[state, k]
    assert ft.scan(kinds).tolist() == want


def test_frames(docs_of, odd_rows, lib):
    docs = docs_of(odd_rows).withColumn("n_tokens", F.lit("x")).withColumn("n_bytes", F.lit(-1))
    got = sorted(repr(tuple(r)) for r in
                 ft.count_tokens(docs, vocabulary(WORD_BPE), limit=1000).collect())
    want = []
    for i, t in odd_rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append(repr((i, len((t or "").encode()), n, n > 1000)))
    assert got == sorted(want)
    assert ft.count_tokens(docs_of([]), vocabulary(WORD_BPE)).collect() == []


def test_rejects_other_patterns():
    with pytest.raises(ValueError):
        ft.Counter(Vocabulary(vocabulary(BYTE_BPE)))
