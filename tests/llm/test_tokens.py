"""BPE against the tokenizers library; token files read back."""
import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from schemaloom.llm import bpe, tokenfiles
from schemaloom.llm.queries import BYTE_BPE, WORD_BPE, vocabulary


def fuzz(n=400):
    rng = random.Random(3)
    span = [(32, 127), (32, 127), (1, 0x250), (0x370, 0x3000), (0x4E00, 0x9FFF), (0x1F300, 0x1F6FF)]
    out = ["".join(chr(rng.randrange(*rng.choice(span))) for _ in range(rng.randrange(60)))
           for _ in range(n)]
    return out + ["<|endoftext|>a <|startoftext|><|ENDOFTEXT|>", "ΑΣ ΣΑΣ. İ ǅ", "they'RE don't",
                  "\x1c\x85​ x", "\U0001e8c0 \U00031350y", "é á", "aaaa" * 40, "ab" * 33]


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
def test_encoder_equals_library(name, odd_rows):
    lib, coder = Tokenizer.from_file(vocabulary(name)), bpe.Encoder(bpe.Vocabulary(vocabulary(name)))
    values = fuzz() + [t or "" for _, t in odd_rows]
    for at in range(0, len(values), 50):  # slices: remembered words
        part = values[at:at + 50]
        for value, (ids, text) in zip(part, coder.encode(part)):
            want = lib.encode(value, add_special_tokens=False).ids
            assert ids.tolist() == want, value[:80]
            assert text == lib.decode(want, skip_special_tokens=False)


def test_rejects_merges_out_of_order(tmp_path):
    with open(vocabulary(WORD_BPE)) as file:
        spec = json.load(file)
    spec["model"]["merges"].reverse()
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "t.json"))


def test_encode_and_decode_frames(docs_of, odd_rows):
    lib = Tokenizer.from_file(vocabulary(WORD_BPE))
    coded = bpe.encode(docs_of(odd_rows), vocabulary(WORD_BPE))
    got = sorted(repr(tuple(r)) for r in coded.collect())
    want = []
    for i, t in odd_rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(map(repr, want))
    back = bpe.decode(coded, vocabulary(WORD_BPE)).collect()
    assert sorted(map(repr, [(r.doc_id, r.text) for r in back])) == sorted(
        repr((i, d)) for i, _, d in want)


def test_bpe_empty_table(docs_of):
    assert bpe.encode(docs_of([]), vocabulary(WORD_BPE)).collect() == []


def test_token_files(docs_of, odd_rows, spark, tmp_path):
    lib = Tokenizer.from_file(vocabulary(BYTE_BPE))
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(fuzz(60))]
    root = f"file://{tmp_path}/t"
    manifest = tokenfiles.write(docs_of(rows), vocabulary(BYTE_BPE), root, partitions=4).collect()
    assert sum(m.docs for m in manifest) == len(rows) and len(manifest) > 1
    got = sorted(tokenfiles.read(spark, root).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode())))
    at = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_files_empty(docs_of):
    assert tokenfiles.round_trip(docs_of([]), vocabulary(BYTE_BPE)).collect() == []
