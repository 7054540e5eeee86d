"""BPE encoding and decoding with a pair occurrence index.

Distinct words of a slice of a partition lie in one flat array of symbols.
An index maps each mergeable pair (by its rank) to all its positions; active
ranks are taken in ascending order, every occurrence of a rank is merged at
once, and only the neighbours of merged positions enter the lists of other
ranks. Because a merge makes only pairs of higher rank (checked when the
vocabulary is loaded), this gives the same symbols as merging word by word.

Texts never leave their partition: no shuffle, memory bounded by SLICE bytes
of text and CACHE words.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, texts, unassigned

SLICE = 16 << 20
CACHE = 400_000
OUT = 2 << 20  # bytes of text per output batch

#: Fixed value: the pattern of byte-level vocabularies.
BYTE_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                r"|\s+(?!\S)|\s+")
_NONE = np.int64(1 << 40)


def byte_chars() -> list[str]:
    """Character that stands for each byte: itself where it is visible in
    Latin-1, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """A BPE tokenizer file (JSON of the tokenizers library)."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        split = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        self.pattern = regex.compile(split[0] if split else BYTE_PATTERN)
        self.byte_level = (spec["decoder"] or {}).get("type") == "ByteLevel"
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")"
                                   if self.special else r"(?!)")
        ids = model["vocab"]
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        chars = byte_chars()
        self.of_byte = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([ids[c] for c in chars], np.int32)
        self.last = np.array([ids[c + self.suffix] for c in chars], np.int32)

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        self.right = np.array([ids[b] for _, b in pairs], np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        born = {int(t): r for r, t in enumerate(self.made)}  # the last rank that makes a token
        if any(born.get(int(t), -1) > r for r in range(len(pairs))
               for t in (self.left[r], self.right[r])):
            raise ValueError("a merge uses a token that a later merge makes")
        self.base = np.int64(len(self.tokens))
        keys = self.left.astype(np.int64) * self.base + self.right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; _NONE where it doesn't merge."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.base + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def normal(self, text: str) -> str:
        if not self.lower:
            return text
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        # one character at a time where Python would look at the context
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def words(self, text: str) -> list[str]:
        """Pieces that are merged on their own; special tokens stay whole."""
        if not any(mark in text for mark in self.special):
            return self.pattern.findall(self.normal(text))
        out: list[str] = []
        for i, part in enumerate(self.marks.split(text)):
            out += [part] if i % 2 else self.pattern.findall(self.normal(part))
        return out

    def library_words(self, text: str) -> list[str]:
        """The same pieces by the tokenizers library, whose Unicode tables decide
        about code points that Python's tables don't have."""
        from tokenizers import Tokenizer
        lib = Tokenizer.from_file(self.path)
        out: list[str] = []
        for i, part in enumerate(self.marks.split(text) if self.special else [text]):
            if i % 2:
                out.append(part)
                continue
            part = lib.normalizer.normalize_str(part) if lib.normalizer else part
            out += [bytes(map(self.of_byte.get, piece)).decode()
                    for piece, _ in lib.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def decode(self, ids) -> str:
        """Text of token ids, special tokens included."""
        tokens = [self.tokens[i] for i in ids]
        if not self.byte_level:
            return " ".join(tokens)
        return b"".join(t.encode() if t in self.special else bytes(map(self.of_byte.get, t))
                        for t in tokens).decode("utf-8", "replace")


def _starts(length: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)


def merge_words(vocab: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in one array, and how many each word has."""
    raw = [w.encode() for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0", np.uint8)
    gap = np.concatenate([[0], np.cumsum(size + 1)])
    sym = vocab.inner[data]
    sym[gap[1:] - 1] = vocab.last[data[gap[1:] - 1]]
    sym[gap] = -1
    after = np.arange(1, len(sym) + 1)
    before = np.arange(-1, len(sym) - 1)

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        rank = vocab.ranks(sym[at], sym[after[at]])
        own = rank < _NONE
        if not own.any():
            return
        at, rank = at[own], rank[own]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(part)

    enter(np.arange(len(sym) - 1))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        at = at[sym[at] == vocab.left[r]]
        at = at[sym[after[at]] == vocab.right[r]]
        if not len(at):
            continue
        if vocab.left[r] == vocab.right[r]:  # runs: from the left, without overlap
            kept, used = [], -1
            for p, q in zip(at.tolist(), after[at].tolist()):
                if p != used:
                    kept.append(p)
                    used = q
            at = np.array(kept)
        gone = after[at]
        following = after[gone]
        sym[at] = vocab.made[r]
        sym[gone] = -2
        after[at] = following
        before[following] = at
        enter(np.unique(np.concatenate([before[at], at])))
    alive = np.flatnonzero(sym >= 0)
    count = np.diff(np.searchsorted(alive, gap))
    return sym[alive], count


class Encoder:
    """Encodes texts slice by slice; remembers up to CACHE words."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.strange: set[str] = set()  # words whose texts the library splits
        self.text: list[str] = []
        self.flat = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode new words, in the order of their numbers."""
        special = self.vocab.special
        mark = np.array([w in special for w in words], bool)
        plain = [w for w in words if w not in special]
        ids, n = (merge_words(self.vocab, plain) if plain
                  else (np.zeros(0, np.int32), np.zeros(0, np.int64)))
        count = np.ones(len(words), np.int64)
        count[~mark] = n
        flat = np.empty(count.sum(), np.int32)
        inside = np.repeat(~mark, count)
        flat[inside] = ids
        flat[~inside] = [special[w] for w in words if w in special]
        tokens, values, at = self.vocab.tokens, flat.tolist(), 0
        for n in count.tolist():
            self.text.append(" ".join([tokens[i] for i in values[at:at + n]]))
            at += n
        self.flat = np.concatenate([self.flat, flat])
        self.count = np.concatenate([self.count, count])
        self.start = _starts(self.count)

    def encode(self, values: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Token ids and decoded text of each value. Words are held as numbers,
        not as strings, while the new ones of all values are encoded together."""
        if len(self.number) > CACHE:
            self.forget()
        numbers, fresh = [], []
        for value in values:
            words = self.vocab.words(value)
            new = set(words).difference(self.number)
            odd = unassigned(new)
            if odd or not self.strange.isdisjoint(words):
                self.strange |= odd
                words = self.vocab.library_words(value)
                new = set(words).difference(self.number)
                self.strange |= unassigned(new)
            for w in sorted(new):
                self.number[w] = len(self.number)
                fresh.append(w)
            numbers.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        if fresh:
            self.learn(fresh)
        for no in numbers:
            n = self.count[no]
            ids = self.flat[np.repeat(self.start[no] - _starts(n), n) + np.arange(n.sum())] \
                if len(no) else self.flat[:0]
            if self.vocab.byte_level:
                yield ids, self.vocab.decode(ids.tolist())
            else:  # tokens are joined by a blank, so words may be decoded once each
                yield ids, " ".join(map(self.text.__getitem__, no.tolist()))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded of every row: the token ids of the whole text and
    the text that these ids decode to.

    ``path``: tokenizer file, read once per task on the executors. Null texts
    are empty: no ids, decoded ''. Rows are kept as they are, repeated ones
    too; other columns are ignored. Special tokens that a text holds become
    their ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(Vocabulary(path))
        for batch in chunks(batches, "text", SLICE):
            ids, decoded, held, at = [], [], 0, 0
            for one, text in coder.encode(texts(batch)):
                ids.append(one)
                decoded.append(text)
                held += len(text)
                if held > OUT:
                    yield packed(batch.slice(at, len(ids)), ids, decoded)
                    at += len(ids)
                    ids, decoded, held = [], [], 0
            if ids:
                yield packed(batch.slice(at, len(ids)), ids, decoded)

    def packed(batch, ids, decoded):
        ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32())),
             pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])
    own = docs.select("doc_id", "text")
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, ids array<int>, "
                               "decoded string")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with ``ids`` (null: empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array([vocab.decode(i or []) for i in batch.column("ids").to_pylist()],
                          pa.string())], names=["doc_id", "text"])
    own = tokens.select("doc_id", "ids")
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, text string")
