"""Token counts by deterministic finite-state transducers compiled from a BPE file.

Two transducers run one after the other.

*Pieces.* A transducer over character classes finds where pieces (the units
that are merged on their own) begin; contractions such as 're need a look one
character back, so its output says "a piece begins here" or "began one back".
Texts are cut in chunks of CHUNK characters, whatever stands there. For every
chunk its state map is computed, the end state for each of the seven possible
start states, all chunks at once; the maps are composed by a parallel prefix
scan (doubling), which gives the true start state of every chunk; then all
chunks are replayed at once from these.

*Tokens.* BPE within a piece is compiled to a transducer over its symbols. A
state holds, for every position from which a token may still run on, the place
in the vocabulary's trie, the token that ends there and how many tokens came
after it. A transition finds the one token that can end at the new symbol (it
must be one that BPE keeps whole, and must not merge with the token before it)
and is annotated with the change in the number of tokens, which may be
negative: a longer token replaces several. States and transitions are made
when they are first met and remembered, so a piece costs one table step a
symbol, and a piece of any length needs constant memory.

Texts never leave their partition; memory is bounded by SLICE bytes of text
(or the longest text), CACHE pieces and STATES transducer states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import Vocabulary
from .common import chunks, texts, unassigned

SLICE = 4 << 20
SEGMENT = 2 << 20  # characters that one scan takes
CHUNK = 64
CACHE = 400_000  # pieces remembered
LONG = 200  # characters from which a piece is not remembered
STATES = 300_000  # transducer states held before the tables start anew

#: Fixed value: the pattern of pieces that the transducer below accepts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# ---- pieces ----------------------------------------------------------------

SPACE, NUMBER, OTHER, APOSTROPHE, STMD, R, V, L, E, LETTER = range(10)
# what the piece so far is: closed, letters, others, an apostrophe that began
# it, and that with r, v or l
CLOSED, WORD, MARKS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
HERE, BACK = 1, 2  # a piece begins at this character; began at the one before
_LETTERS = (STMD, R, V, L, E, LETTER)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output of every (state, class)."""
    then, says = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    fresh = {NUMBER: CLOSED, OTHER: MARKS, APOSTROPHE: QUOTE, **dict.fromkeys(_LETTERS, WORD)}
    for state in range(7):
        for kind, target in fresh.items():
            then[state, kind], says[state, kind] = target, HERE
    for kind in _LETTERS:
        says[WORD, kind] = 0
    for kind in (OTHER, APOSTROPHE):
        for state in (MARKS, QUOTE):
            then[state, kind], says[state, kind] = MARKS, 0
    then[QUOTE, STMD], says[QUOTE, STMD] = CLOSED, 0
    for kind, state in ((R, QUOTE_R), (V, QUOTE_V), (L, QUOTE_L)):
        then[QUOTE, kind], says[QUOTE, kind] = state, 0
    for state, end in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        says[state] |= BACK  # the letter is a piece of its own, unless the contraction ends
        for kind in _LETTERS:
            says[state, kind] = BACK
        then[state, end], says[state, end] = CLOSED, 0
    return then, says


NEXT, SAYS = _machine()


def character_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    for kind, of in ((APOSTROPHE, "'"), (STMD, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e")):
        out[[ord(c) for c in of]] = kind
    return out


def scan(kinds: np.ndarray) -> np.ndarray:
    """Output at every character of a text that starts CLOSED."""
    n = len(kinds)
    rows = max(1, -(-n // CHUNK))
    grid = np.full(rows * CHUNK, SPACE, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    flat = NEXT.ravel()
    maps = np.tile(np.arange(7, dtype=np.uint8), (rows, 1))
    for kind in grid:  # every chunk from every state, a character at a time
        maps = flat[maps * np.uint8(10) + kind[:, None]]
    reach = 1
    while reach < rows:  # prefix scan: a map after that of the chunks before
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)
        reach *= 2
    state = np.concatenate([[CLOSED], maps[:-1, CLOSED]]).astype(np.uint8)
    said = np.empty((CHUNK, rows), np.uint8)
    for i, kind in enumerate(grid):
        at = state * np.uint8(10) + kind
        said[i] = SAYS.ravel()[at]
        state = flat[at]
    return np.ascontiguousarray(said.T).ravel()[:n]


def pieces(text: str, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of each piece; ``text`` ends in a space."""
    kinds = classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    said = scan(kinds)
    begin = said & HERE > 0
    begin[:-1] |= said[1:] & BACK > 0
    edge = np.flatnonzero(begin | (kinds == SPACE))
    first = begin[edge]
    return edge[first], edge[1:][first[:-1]]


# ---- tokens ----------------------------------------------------------------

class Transducer:
    """Symbols of a piece to the number of its tokens, compiled when met.

    Symbols are the single-byte tokens, those of the last byte with the end
    mark of the vocabulary.
    """

    def __init__(self, vocab: Vocabulary):
        self.size = int(vocab.base)
        self.rank = {}  # token -> rank of the merge that makes it
        self.halves = {}
        self.pair = {}
        base = set(map(int, [*vocab.inner, *vocab.last]))
        symbols = {t: (t,) for t in base}
        # a merge makes its token only if BPE gets that far with its two halves
        for r, (a, b, made) in enumerate(zip(vocab.left.tolist(), vocab.right.tolist(),
                                             vocab.made.tolist())):
            self.pair[a * self.size + b] = r
        for r, (a, b, made) in enumerate(zip(vocab.left.tolist(), vocab.right.tolist(),
                                             vocab.made.tolist())):
            if (a in symbols and b in symbols and made not in symbols
                    and not self.merge_across(a, b, r)):
                self.rank[made], self.halves[made] = r, (a, b)
                symbols[made] = symbols[a] + symbols[b]
        # trie of the symbols of all tokens that BPE can make
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner: list[bool] = [False]  # has children
        for t, parts in symbols.items():
            node = 0
            for s in parts:
                key = node * self.size + s
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = self.child[key]
            self.token[node] = t
        self.apart: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.number = {((0, -1, 0),): 0}
        self.states = [((0, -1, 0),)]
        self.step: dict[int, tuple[int, int]] = {}  # state and symbol -> state, emitted

    def merge_across(self, a: int, b: int, end: int) -> bool:
        """Whether BPE merges over the border between tokens a and b before
        rank ``end``. Beside the border lie, as ranks go up, the right spine of
        a and the left spine of b, each symbol from the rank that makes it
        to the rank that takes it in."""
        left, right = self.spine(a, 1, end), self.spine(b, 0, end)
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = left[i], right[j]
            r = self.pair.get(x * self.size + y)
            # of two merges of one rank the left one comes first
            if r is not None and r < x_end and (r <= y_end if y_end < end else r < y_end):
                return True
            if x_end >= end and y_end >= end:
                return False
            if x_end <= y_end:
                i += 1
            if y_end <= x_end:
                j += 1

    def spine(self, token: int, side: int, end: int) -> list[tuple[int, int]]:
        """(symbol, rank that takes it in) along one side, the earliest first."""
        out, until = [], end
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out[::-1]
            until = self.rank[token]
            token = self.halves[token][side]

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b side by side (a = -1: b comes first)."""
        if a < 0:
            return True
        key = a * self.size + b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 4 * STATES:
                self.apart.clear()
            known = self.apart[key] = not self.merge_across(a, b, 1 << 60)
        return known

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """The transition of a state: its target, and the tokens it emits."""
        kept, found = [], None
        for node, last, back in self.states[state]:
            node = self.child.get(node * self.size + symbol)
            if node is None:
                continue
            token = self.token[node]
            if found is None and token >= 0 and self.follows(last, token):
                found = token, 1 - back
            if self.inner[node]:
                kept.append((node, last, back))
        if found is None:
            raise ValueError("not a vocabulary of byte-pair merges")
        token, emitted = found
        target = (*[(n, t, back + emitted) for n, t, back in kept], (0, token, 0))
        if target not in self.number:
            self.number[target] = len(self.states)
            self.states.append(target)
        move = self.step[state * self.size + symbol] = self.number[target], emitted
        return move

    def count(self, symbols) -> int:
        """Tokens of one piece."""
        state = total = 0
        known, size = self.step.get, self.size
        for s in symbols:
            move = known(state * size + s)
            if move is None:
                if len(self.states) > STATES:  # tables start anew, from this state on
                    here = self.states[state]
                    self.clear()
                    state = self.number.setdefault(here, len(self.states))
                    if state == len(self.states):
                        self.states.append(here)
                    known = self.step.get
                move = self.compile(state, s)
            state, emitted = move
            total += emitted
        return total


class Counter:
    """Counts the tokens of texts; remembers up to CACHE pieces."""

    def __init__(self, vocab: Vocabulary):
        if vocab.pattern.pattern != PATTERN or not vocab.lower:
            raise ValueError(f"{vocab.path}: not a vocabulary of this pattern of pieces")
        self.vocab = vocab
        self.machine = Transducer(vocab)
        self.classes = character_classes()
        self.inner, self.last = vocab.inner.tolist(), vocab.last.tolist()
        self.known: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        raw = piece.encode()
        inner = self.inner
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return self.machine.count(symbols)

    def learn(self, words: list[str]) -> None:
        known = self.known
        for word in set(words):
            if word not in known:
                known[word] = self.tokens(word)

    def plain(self, values: list[str]) -> np.ndarray:
        """Tokens of normal texts without special tokens, cut in segments."""
        out = np.zeros(len(values), np.int64)
        text = " ".join(values) + " "
        ends = np.cumsum([len(v) + 1 for v in values])
        at = 0
        while at < len(text):
            # a piece that a segment cuts is taken up by the next one
            to = min(at + SEGMENT, len(text))
            begin, end = pieces(text[at:to] + " ", self.classes)
            if to < len(text) and len(end) and at + end[-1] >= to - 2:
                cut = max(0, len(end) - 3)  # the last ones may be parts of another
                if at + begin[cut] == at:  # one piece as long as the segment
                    to = self.piece_end(text, at)
                    begin, end = pieces(text[at:to] + " ", self.classes)
                else:
                    to = at + int(begin[cut])
                    begin, end = begin[:cut], end[:cut]
            if len(begin):
                n = self.counts(text, (begin + at).tolist(), (end + at).tolist())
                np.add.at(out, np.searchsorted(ends, begin + at, "right"), n)
            at = to
        return out

    def piece_end(self, text: str, at: int) -> int:
        """A place behind ``at`` where white space ends any piece."""
        while at < len(text):
            window = self.classes[np.frombuffer(
                text[at:at + SEGMENT].encode("utf-32-le", "surrogatepass"), np.uint32)]
            space = np.flatnonzero(window == SPACE)
            if len(space):
                return at + int(space[0]) + 1
            at += SEGMENT
        return len(text)

    def counts(self, text: str, begin: list[int], end: list[int]) -> np.ndarray:
        words = [text[a:b] if b - a < LONG else "" for a, b in zip(begin, end)]
        if len(self.known) > CACHE:
            self.known.clear()
        self.known[""] = 0
        try:
            n = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.learn(words)
            n = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        for i, (a, b) in enumerate(zip(begin, end)):
            if b - a >= LONG:
                n[i] = self.tokens(text[a:b])
        return n

    def count(self, values: list[str]) -> list[int]:
        """Tokens of each text; special tokens in a text are one each."""
        vocab, flat, owner = self.vocab, [], []
        out = np.zeros(len(values), np.int64)
        for i, value in enumerate(values):
            marked = any(mark in value for mark in vocab.special)
            parts = vocab.marks.split(value) if marked else [value]
            out[i] = len(parts) // 2
            normal = [vocab.normal(p) for p in parts[::2]]
            if not value.isascii() and unassigned(normal):
                # code points that only the library's tables know
                words = [w for w in vocab.library_words(value) if w not in vocab.special]
                out[i] += sum(map(self.tokens, words))
                continue
            flat += normal
            owner += [i] * len(normal)
        np.add.at(out, np.array(owner, np.int64), self.plain(flat) if flat else 0)
        return out.tolist()


_counters: dict[str, Counter] = {}  # of this worker process: compiled tables are kept


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(Vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``.

    ``path``: tokenizer file (JSON of the tokenizers library, with the pattern
    of pieces above), read once per worker. Null texts are empty: no bytes, no
    tokens. Rows are kept as they are, repeated ones and those without doc_id
    too; other columns are ignored. Special tokens that a text holds count as
    one each. ``over_limit``: more than ``limit`` tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in chunks(batches, "text", SLICE):
            values = texts(batch)
            n = own.count(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array([len(v.encode("utf-8", "surrogatepass")) for v in values], pa.int64()),
                 pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    own = docs.select("doc_id", "text")
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, n_bytes long, n_tokens long, "
                               "over_limit boolean")
