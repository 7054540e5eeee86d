"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of the labelled documents (PER_CLASS of each
label, smallest hash of the id first). Terms are whole words and the
character 4- and 5-grams of words with their ends marked, known by 64-bit
hashes; every term of the examples has a place in the vector space. Vectors are
TF-IDF ((1 + log tf) * idf), compared by cosine. So that names and topics do not
drown the vocabulary that matters, a term's idf is multiplied by how far it goes
with the label: the absolute phi coefficient (square root of chi-square over the
number of examples, so it does not grow with the sample) plus 1 / examples.
Plain idf finds too few of the toxic documents (README).

Nothing of that passes through the driver but counts, two numbers an example,
WIDTH numbers a shard and paths: tasks count the terms, a grouping weighs them,
and the examples are cut in shards with at most SHARD bytes of text (a longer
example is a shard by itself), each written as vectors by one task to the shared
folder; the weights, 20 bytes a distinct term, are a file beside them. Like
examples share shards: their projections to WIDTH signs a term are grouped by
k-means in one task. Scoring tasks index the shards, search one after the other
for a slice of texts, nearest texts together and the likeliest shard first, and
merge the K best.

A shard keeps postings and, for every block of BLOCK examples, the largest weight
of each term that 1 example in COMMON holds and the largest length of the rest. A
search of many texts at once leaves out the texts whose bounds do not reach the
k-th product of the shards before. For the others, terms whose postings many of
these texts share are made rows of a matrix, whose product adds them at once; over
the other terms the postings met are summed. Grouping of texts and choice of rows
only save time. What may be among the k best is then scored in double precision:
the result is exact.
Votes of the K nearest, weighted by their cosine and by how thinly their class
was sampled, plus a prior, give a raw score. A logistic curve turns it into the
score; it is fitted on the examples, each scored without its own vote.
"""

from __future__ import annotations

import io
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import chunks, mix, open_folder, saved, texts, thinned

PER_CLASS = 4000
GRAMS = (4, 5)
BLOCK = 64
K = 15
PRIOR_WEIGHT = 0.2
SHARD = 3 << 20  # bytes of text
HELD = 10  # shards at most that a worker keeps in memory
KNOWN = 100_000  # words whose terms a worker remembers
DENSE = 4096  # terms at most that are rows of a matrix
BOUNDED = 512  # terms at most with block maxima
COMMON = 16  # they are in 1 example in so many
SUMMED = 400  # adding a posting takes as long as so many products of a matrix
TEXTS_AT_ONCE = 128
SLICE = 4 << 20
WIDTH = 64  # numbers of a projection
FREQUENT = 8192  # most frequent terms, which are projected
GROUPS = 8

AT_ONCE = 1 << 16  # postings

#: Terms and weights of many vectors one after the other, and where each begins.
Vectors = tuple[np.ndarray, np.ndarray, np.ndarray]

_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of each word and the place of the word: the
    word in marks < and >, and its 4- and 5-grams (a marked word of that length
    is its own gram). Grams may repeat; in no order."""
    marked = [f"<{x}>" for x in some]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"),
                         np.uint32).astype(np.uint64) + np.uint64(1)
    size = np.array([len(x) for x in marked], np.int64)
    word = np.repeat(np.arange(len(some)), size)
    other = np.flatnonzero(~np.isin(size, GRAMS))
    hashes = [np.array([xxhash.xxh64_intdigest(marked[i].encode("utf-8", "surrogatepass"))
                        for i in other.tolist()], np.uint64)]
    owner = [other]
    for n in GRAMS:
        m = max(len(code) - n + 1, 0)
        total = np.full(m, np.uint64(n))
        for j in range(n):
            total *= _STEP
            total += code[j:j + m]
        at = np.flatnonzero(word[:m] == word[n - 1:][:m])
        hashes.append(mix(total[at]))
        owner.append(word[at])
    return np.concatenate(hashes).view(np.int64), np.concatenate(owner)


def term_hashes(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms of each word, word after word, and their
    number for each."""
    h, word = _grams(some)
    order = np.lexsort((h, word))
    h, word = h[order], word[order]
    first = np.append(True, (h[1:] != h[:-1]) | (word[1:] != word[:-1]))[:len(h)]
    return h[first], np.bincount(word[first], minlength=len(some))


def _summed(at: np.ndarray, tf: np.ndarray, kind: str | None = "stable"
            ) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``at``, ascending, and the sums of their ``tf``."""
    order = np.argsort(at, kind=kind)
    at, tf = at[order], tf[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[:len(at)])
    return at[first], np.add.reduceat(tf, first) if len(first) else tf


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + n[0] - 1, start[1] .. and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class BlockMaxIndex:
    """Unit vectors (kept in single precision) as postings, with block maxima of
    the common terms. Weights are positive."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int,
                 block: int = BLOCK):
        self.n = len(vectors)
        same: dict[bytes, list[int]] = {}
        for i, (at, w) in enumerate(vectors):
            if len(at):
                same.setdefault(np.asarray(at, np.int32).tobytes()
                                + np.asarray(w, np.float32).tobytes(), []).append(i)
        # equal examples are one row: the numbers of row i are member[first[i]:first[i + 1]]
        self.member = np.array([i for x in same.values() for i in x], np.int64)
        self.first = np.cumsum([0, *map(len, same.values())])
        own = [vectors[x[0]] for x in same.values()]
        m = self.m = len(own)
        size = np.array([len(v[0]) for v in own], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.at = np.zeros(self.start[-1], np.int32)
        self.w = np.zeros(self.start[-1], np.float32)
        for i, (at, w) in enumerate(own):
            self.at[self.start[i]:self.start[i + 1]] = at
            self.w[self.start[i]:self.start[i + 1]] = w
        doc = np.repeat(np.arange(m, dtype=np.min_scalar_type(max(m, 1))), size)
        order = np.argsort(self.at, kind="stable")
        self.doc, self.weight = doc[order], self.w[order]
        self.df = np.bincount(self.at, minlength=n_terms).astype(np.int32)
        self.lists = np.cumsum(self.df, dtype=np.int32) - self.df
        self.several = np.flatnonzero(self.df > m // 200)

        common = np.argsort(-self.df, kind="stable")[:BOUNDED]
        self.dense = common[self.df[common] * COMMON > m]  # the terms with block maxima
        self.slot = np.full(n_terms, -1, np.int16)
        self.slot[self.dense] = np.arange(len(self.dense))
        blocks = -(-m // block)
        slot = self.slot[self.at]
        cell = slot[slot >= 0].astype(np.int64) * blocks + doc[slot >= 0] // block
        self.high = np.zeros((len(self.dense), blocks), np.float32)
        np.maximum.at(self.high.reshape(-1), cell, self.w[slot >= 0])
        # the largest length of a block's vectors without their common terms
        self.rest = np.sqrt(np.bincount(doc[slot < 0], self.w[slot < 0].astype(np.float64) ** 2,
                                        minlength=blocks * block)
                            ).reshape(blocks, block).max(axis=1, initial=0)
        self.slack = 2 * (min(DENSE, n_terms) + n_terms.bit_length() + 64) * 2.0 ** -23

    def search(self, at: np.ndarray, w: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Examples and products of the k largest positive products, ties to
        the smaller number."""
        return self.search_all((at, w, np.array([0, len(at)])), k, np.zeros(len(self.slot)))[0]

    def search_all(self, queries: Vectors, k: int, table: np.ndarray,
                   floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``search`` of each query; products below its ``floor`` may be left
        out. ``table``: a zero for every term, for use inside."""
        n = len(queries[2]) - 1
        best = np.zeros((n, k), np.float32)
        if floor is not None:
            best += floor[:, None].astype(np.float32)
        near = self.candidates(queries, best)
        return [(number[top], cos[top]) for number, cos in self.exact(queries, *near[:2], k, table)
                for top in [_ranked(cos, number, k)]]

    def candidates(self, queries: Vectors, best: np.ndarray
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, rows and products in single precision of what may be among
        the best; ``best`` has the largest products of each query so far, and
        gets those that are found."""
        at, w, cut = queries
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        query = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        if not self.m or not len(at):
            return none
        rows = self._reaching(at, w, query, best.min(axis=1) * (1 - self.slack))
        if not len(rows):
            return none
        row = np.full(len(cut) - 1, -1)
        row[rows] = np.arange(len(rows))
        held = np.flatnonzero((self.df[at] > 0) & (row[query] >= 0))
        score = self._products(at[held], w[held].astype(np.float32), row[query[held]], len(rows))
        k = best.shape[1]
        best[rows] = np.partition(np.concatenate([best[rows], score], axis=1), self.m,
                                  axis=1)[:, -k:]
        floor = best[rows].min(axis=1) * (1 - self.slack)
        i, j = np.nonzero((score > 0) & (score >= floor[:, None]))
        return rows[i], j, score[i, j]

    def _reaching(self, at: np.ndarray, w: np.ndarray, query: np.ndarray,
                  floor: np.ndarray) -> np.ndarray:
        """Queries of which a block's bound reaches the floor: common terms are
        bounded by block maxima, the others by the lengths of both sides."""
        slot = self.slot[at]
        common = slot >= 0
        left = np.zeros((len(floor), len(self.high)), np.float32)
        left[query[common], slot[common]] = w[common]
        length = np.sqrt(np.bincount(query[~common], w[~common] ** 2, minlength=len(floor)))
        bound = (left @ self.high).astype(np.float64) + np.outer(length, self.rest)
        return np.flatnonzero((bound * (1 + self.slack)).max(axis=1) >= floor)

    def _products(self, at: np.ndarray, w: np.ndarray, query: np.ndarray, n: int) -> np.ndarray:
        """Products of ``n`` queries with all rows, by a matrix of the terms that
        many of the queries share and by the postings of the others."""
        met = np.bincount(at, minlength=len(self.df))[self.several]
        df = self.df[self.several]
        gain = met * df * float(SUMMED) - (n * self.m + df * float(SUMMED))
        chosen = np.flatnonzero(gain > 0)
        if len(chosen) > DENSE:
            chosen = chosen[np.argpartition(-gain[chosen], DENSE)[:DENSE]]
        terms, df = self.several[chosen], df[chosen]
        place = np.full(len(self.df), -1, np.int16)
        place[terms] = np.arange(len(terms))
        slot = place[at]
        dense = slot >= 0
        left = np.zeros((n, len(terms)), np.float32)
        left[query[dense], slot[dense]] = w[dense]
        right = np.zeros((len(terms), self.m), np.float32)
        posting = _ranges(self.lists[terms].astype(np.int64), df)
        right.reshape(-1)[np.repeat(np.arange(len(terms)) * self.m, df)
                          + self.doc[posting]] = self.weight[posting]
        score = left @ right
        self._add_rare(score, at[~dense], w[~dense], query[~dense])
        return score

    def _add_rare(self, score: np.ndarray, at: np.ndarray, w: np.ndarray,
                  query: np.ndarray) -> None:
        """Adds the products over the terms ``at``, ``w`` of ``query``, about
        AT_ONCE postings at a time, whole queries."""
        n, lists = self.df[at], self.lists[at]
        upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        edge = np.searchsorted(query, np.arange(len(score) + 1))
        first = 0
        while first < len(score):
            to = max(first + 1, int(np.searchsorted(upto[edge], upto[edge[first]] + AT_ONCE,
                                                    "right")) - 1)
            own = slice(edge[first], edge[to])
            if edge[to] > edge[first]:
                base = (lists[own] - (upto[own] - upto[edge[first]])).astype(np.int32)
                place = np.repeat(base, n[own])
                place += np.arange(len(place), dtype=np.int32)
                cell = np.repeat((query[own] - first) * self.m, n[own])
                cell += self.doc.take(place, mode="clip")
                value = np.repeat(w[own], n[own])
                value *= self.weight.take(place, mode="clip")
                score[first:to] += np.bincount(cell, value, minlength=(to - first) * self.m
                                               ).reshape(to - first, self.m)
            first = to

    def exact(self, queries: Vectors, query: np.ndarray, row: np.ndarray, k: int,
              table: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Numbers and products in double precision of the rows of each query
        (``query`` ascending); of equal examples the k first."""
        at, w, cut = queries
        n = len(cut) - 1
        out = [(np.zeros(0, np.int64), np.zeros(0))] * n
        edge = np.searchsorted(query, np.arange(n + 1)).tolist()
        begin, end = self.start[row].tolist(), self.start[row + 1].tolist()
        size = np.minimum(self.first[row + 1] - self.first[row], k)
        for i in np.unique(query).tolist():
            own, mine = slice(edge[i], edge[i + 1]), at[cut[i]:cut[i + 1]]
            table[mine] = w[cut[i]:cut[i + 1]]
            cos = np.array([table.take(self.at[a:b], mode="clip") @ self.w[a:b]
                            for a, b in zip(begin[own], end[own])])
            table[mine] = 0
            out[i] = (self.member[_ranges(self.first[row[own]], size[own])],
                      np.repeat(cos, size[own]))
        return out


def _ranked(value: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest; values that agree to 12 places are ties (rounding)."""
    return np.lexsort((number, -np.round(value, 12)))[:k]


class Space:
    """The terms of the examples (hashes, ascending), their numbers and, by
    number, their weights; weighs texts. Frequent terms have the small numbers,
    so what is looked up often lies close together."""

    def __init__(self, terms: np.ndarray, number: np.ndarray, idf: np.ndarray):
        self.terms, self.number, self.idf = terms, number, idf
        self.known: dict[str, np.ndarray] = {}
        self.table = np.zeros(len(self.terms))
        # where the hashes begin that share their first bits
        self.shift = np.uint64(64 - max(len(terms).bit_length(), 1))
        self.begin = np.searchsorted(self._bits(terms), np.arange((1 << 64 - int(self.shift)) + 1)
                                     ).astype(np.int32)
        self.signs: np.ndarray | None = None

    def _bits(self, h: np.ndarray) -> np.ndarray:
        return ((h.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes in the terms, -1 if they are none."""
        out = np.full(len(h), -1, np.int32)
        bits = self._bits(h)
        at, end = self.begin[bits], self.begin[bits + 1]
        left = np.flatnonzero(at < end)
        at, end, h = at[left], end[left], h[left]
        while len(left):
            hit = self.terms[at] == h
            out[left[hit]] = at[hit]
            at += 1
            more = np.flatnonzero(~hit & (at < end))
            left, at, end, h = left[more], at[more], end[more], h[more]
        return out

    def learn(self, counts: list[Counter]) -> None:
        """Finds the terms of the words that are not remembered."""
        if len(self.known) > KNOWN:
            self.known = {}
        new = list(set().union(*counts).difference(self.known))
        if not new:
            return
        h, word = _grams(new)
        at = self.find(h)
        key = np.sort(word[at >= 0] * len(self.terms) + self.number[at[at >= 0]])
        key = key[np.append(True, key[1:] != key[:-1])[:len(key)]]
        word, found = np.divmod(key, max(len(self.terms), 1))
        found = found.astype(np.int32)
        left = np.searchsorted(word, np.arange(len(new) + 1)).tolist()
        for x, a, b in zip(new, left[:-1], left[1:]):
            self.known[x] = found[a:b]

    def projected(self, vectors: Vectors) -> np.ndarray:
        """Sums of the weights of the frequent terms, each with the signs that its
        hash gives; of unit length. Like vectors have like ones."""
        if self.signs is None:
            h = np.empty(len(self.terms), np.int64)
            h[self.number] = self.terms
            bits = np.unpackbits(mix(h[:FREQUENT].view(np.uint64)).view(np.uint8))
            self.signs = bits.reshape(-1, WIDTH).astype(np.float32) * 2 - 1
        at, w, cut = vectors
        query = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        left = np.zeros((len(cut) - 1, len(self.signs)), np.float32)
        own = at < len(self.signs)
        left[query[own], at[own]] = w[own]
        return _unit(left @ self.signs)

    def vectors(self, counts: list[Counter]) -> Vectors:
        """Vectors of unit length of texts with these words: the distinct known
        terms and their weights. The words must be learnt."""
        own = [self.known[x] for c in counts for x in c]
        size = np.array([len(x) for x in own], np.int64)
        doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        key = (np.repeat(doc * len(self.terms), size)
               + np.concatenate([np.zeros(0, np.int32), *own]))
        tf = np.array([n for c in counts for n in c.values()], np.float64)
        key, tf = _summed(key, np.repeat(tf, size), None)
        doc, at = np.divmod(key, max(len(self.terms), 1))
        w = (1 + np.log(tf)) * self.idf[at]
        norm = np.sqrt(np.bincount(doc, w * w, minlength=len(counts)))
        return (at.astype(np.int32), w / np.where(norm > 0, norm, 1.0)[doc],
                np.searchsorted(doc, np.arange(len(counts) + 1)))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)


def _grouped(rows: np.ndarray) -> np.ndarray:
    """Group of each unit vector by k-means, begun with vectors evenly spaced;
    like groups have numbers next to each other."""
    centre = rows[np.linspace(0, len(rows) - 1, min(GROUPS, len(rows))).astype(int)]
    for _ in range(12):
        group = (rows @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, group, rows)
        centre = np.where((total * total).sum(axis=1, keepdims=True) > 0, _unit(total), centre)
    chain = [0]
    while len(chain) < len(centre):
        near = centre @ centre[chain[-1]]
        near[chain] = -np.inf
        chain.append(int(near.argmax()))
    return (rows @ centre[chain].T).argmax(axis=1)


def _read_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    files, place = open_folder(folder)
    with files.open_input_stream(f"{place}/{name}") as f:
        data = np.load(io.BytesIO(f.read()))
    return {k: data[k] for k in data.files}


def _write_arrays(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Name of the new file. Attempts write under their own names; what the
    committed one reports is read."""
    name = f"part-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:12]}.npz"
    files, place = open_folder(folder, create=True)
    with files.open_output_stream(f"{place}/{name}") as f:
        data = io.BytesIO()
        np.savez(data, **arrays)
        f.write(data.getbuffer())
    return name


class Model:
    """Where the shards lie, and what turns neighbours into a score. A small
    object: shards are read by the workers that score."""

    def __init__(self, folder: str, terms: str | None, shards: list[str], centres: np.ndarray,
                 ids: dict[int, str], weight: np.ndarray, prior: float):
        self.folder, self.terms, self.shards, self.ids = folder, terms, shards, ids
        self.centres = centres
        self.weight, self.prior, self.curve = weight, prior, (1.0, 0.0)
        self.space: Space | None = None
        self.held: dict[str, tuple[np.ndarray, BlockMaxIndex]] = {}

    def __getstate__(self):
        return self.__dict__ | {"space": None, "held": {}}

    def _shard(self, name: str) -> tuple[np.ndarray, BlockMaxIndex]:
        if (found := self.held.get(name)) is None:
            data = _read_arrays(self.folder, name)
            at, w, cut = data["at"], data["w"], data["cut"].tolist()
            found = data["number"], BlockMaxIndex(
                [(at[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:])], len(self.space.terms))
            if len(self.held) < HELD:
                self.held[name] = found
        return found

    def neighbours(self, values: list[str], leave: list[int] | None = None,
                   k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
        """Example numbers (twice the place, plus the label) and cosines of the
        k nearest of each text; without the examples numbered in ``leave``."""
        if not self.terms:  # no example has a term
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(values)
        self.space = self.space or Space(**_read_arrays(self.folder, self.terms))
        more = k + (leave is not None)
        n, queries, near = len(values), [], []
        for first in range(0, n, TEXTS_AT_ONCE):
            counts = [Counter(words(t)) for t in values[first:first + TEXTS_AT_ONCE]]
            self.space.learn(counts)
            queries.append(self.space.vectors(counts))
            near.append(self.space.projected(queries[-1]) @ self.centres.T)
        # texts that are like the same shard are searched together
        near = np.concatenate([np.zeros((0, len(self.shards)), np.float32), *near])
        order = np.argsort(near.argmax(axis=1), kind="stable")
        at, w = (np.concatenate([np.zeros(0, kind), *(q[i] for q in queries)])
                 for i, kind in enumerate((np.int32, np.float64)))
        size = np.concatenate([np.zeros(0, np.int64), *(np.diff(q[2]) for q in queries)])
        start = np.cumsum(size) - size
        del queries
        batches = []
        for first in range(0, n, TEXTS_AT_ONCE):
            own = order[first:first + TEXTS_AT_ONCE]
            place = _ranges(start[own], size[own])
            batches.append((at[place], w[place], np.cumsum([0, *size[own]])))
        del at, w
        if len(self.shards) <= HELD:
            found = [x for i, q in enumerate(batches) for x in self._nearest(
                [q], more, np.argsort(-near[order[i * TEXTS_AT_ONCE:][:TEXTS_AT_ONCE]].sum(axis=0)))]
        else:  # shards that are not kept are read twice for all texts
            found = self._nearest(batches, more, np.arange(len(self.shards)))
        best = [None] * n
        for i, x in zip(order.tolist(), found):
            best[i] = x
        if leave is not None:
            best = [(n[n != no][:k], c[n != no][:k]) for (n, c), no in zip(best, leave)]
        return [(n, np.minimum(c, 1.0)) for n, c in best]

    def _nearest(self, batches: list[Vectors], k: int,
                 shards: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        best = [np.zeros((len(q[2]) - 1, k), np.float32) for q in batches]
        near: list[list] = [[] for _ in batches]
        for s in shards.tolist():
            index = self._shard(self.shards[s])[1]
            for own, q, high in zip(near, batches, best):
                own.append((s, *index.candidates(q, high)))
        found = [[[] for _ in range(len(q[2]) - 1)] for q in batches]
        for pos, s in enumerate(shards.tolist()):
            numbers, index = self._shard(self.shards[s])
            for own, q, high, out in zip(near, batches, best, found):
                query, row, score = own[pos][1:]
                still = score >= high.min(axis=1)[query] * (1 - index.slack)
                if still.any():
                    for i, (place, cos) in enumerate(index.exact(q, query[still], row[still], k,
                                                                 self.space.table)):
                        if len(place):
                            out[i].append((numbers[place], cos))
        return [self._merged(x, k) for out in found for x in out]

    @staticmethod
    def _merged(parts: list[tuple[np.ndarray, np.ndarray]],
                k: int) -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0)
        number, cos = (np.concatenate(x) for x in zip(*parts))
        top = _ranked(cos, number, k)
        return number[top], cos[top]

    def raw(self, number: np.ndarray, cos: np.ndarray) -> float:
        """Share of the toxic votes."""
        y = number % 2
        vote = cos * self.weight[y]
        return float(((vote * y).sum() + PRIOR_WEIGHT * self.prior) / (vote.sum() + PRIOR_WEIGHT))

    def calibrated(self, raw: float) -> float:
        slope, shift = self.curve
        return float(1 / (1 + np.exp(-(slope * _logit(raw) + shift))))

    def score(self, text: str) -> tuple[float, list[tuple[int, float]]]:
        return self.score_all([text])[0]

    def score_all(self, values: list[str]) -> list[tuple[float, list[tuple[int, float]]]]:
        """Score and neighbours (number, cosine) of each text; equal texts are
        scored once."""
        place = {t: i for i, t in enumerate(dict.fromkeys(values))}
        found = [(self.calibrated(self.raw(number, cos)), list(zip(number.tolist(), cos.tolist())))
                 for number, cos in self.neighbours(list(place))]
        return [found[place[t]] for t in values]


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of the curve over logit(raw) that fits the
    labels best. As the labels may be parted without fault, targets are drawn
    in by one case of each label and the slope is held near 1 by a small penalty."""
    if not len(raw) or label.min() == label.max():
        return 1.0, 0.0
    x = np.stack([_logit(raw), np.ones(len(raw))], 1)
    n = np.array([(label == c).sum() for c in (0, 1)])
    target = np.where(label == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = weight / weight.mean()
    beta, ridge = np.array([1.0, 0.0]), np.array([1.0, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ beta)))
        slope = x.T @ (weight * (p - target)) + ridge * (beta - [1, 0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        beta = beta - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def examples(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, text, toxic, no of at most ``per_class`` documents of each label.

    A label counts if toxic is 0 or 1; of several labels of one id the larger
    holds, of several texts of one id the smallest (null only if there is no
    other). Only ids are ranked, after a threshold on their hash that leaves
    about twice as many as wanted; the chosen ones, 2 * per_class at most, are
    broadcast to the documents. ``no`` is twice the rank plus the label.
    """
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    order = Window.partitionBy("toxic").orderBy("_h", "doc_id")
    chosen = (thinned(known, "toxic", F.xxhash64("doc_id"), per_class)
              .withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_class)
              .select("doc_id", "toxic",
                      (F.col("n").cast("long") * 2 + F.col("toxic")).alias("no")))
    return (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "toxic", "no").agg(F.min("text").alias("text")))


def _vector_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms, ascending, and how often they occur."""
    count = Counter(words(text))
    h, n = term_hashes(list(count))
    return _summed(h, np.repeat(np.fromiter(count.values(), np.int64, len(count)), n))


def document_frequency(sample: DataFrame) -> DataFrame:
    """h, n0, n1: examples of each label that hold the term; added up for
    a slice of texts before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SLICE):
            found = [_vector_of(t)[0] for t in texts(batch)]
            y = np.repeat(batch.column("toxic").to_numpy(), [len(x) for x in found])
            h, at = np.unique(np.concatenate(found), return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), *(pa.array(np.bincount(at[y == c], minlength=len(h)))
                                for c in (0, 1))], names=["h", "n0", "n1"])
    return (sample.select("toxic", "text").mapInArrow(run, "h long, n0 long, n1 long")
            .groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def _write_terms(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[b.column(c).to_numpy() for c in ("h", "idf", "df")] for b in batches]
        h, idf, df = (np.concatenate([np.zeros(0, kind), *(r[i] for r in rows)])
                      for i, kind in enumerate((np.int64, np.float64, np.int64)))
        order = np.argsort(h)
        h, idf, df = h[order], idf[order], df[order]
        order = np.argsort(-df, kind="stable")
        number = np.empty(len(h), np.int32)
        number[order] = np.arange(len(h))
        name = _write_arrays(folder, {"terms": h, "number": number, "idf": idf[order]})
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])
    return run


def _write_shard(folder: str, terms: str):
    """Writes the vectors of the examples (no, text) of one shard; gives its name
    and the mean of their projections."""
    def run(rows: pa.Table) -> pa.Table:
        space, found = Space(**_read_arrays(folder, terms)), []
        for no, text in zip(rows.column("no").to_pylist(), rows.column("text").to_pylist()):
            h, tf = _vector_of(text or "")
            at = space.number[np.searchsorted(space.terms, h)]
            order = np.argsort(at)
            at, tf = at[order], tf[order]
            w = (1 + np.log(tf)) * space.idf[at]
            w = (w / (np.sqrt((w * w).sum()) or 1.0)).astype(np.float32)
            # like examples share a block: by label, then by their heaviest terms
            found.append(((no % 2, at[np.lexsort((at, -w))[:3]].tolist(), no), at, w))
        found.sort(key=lambda x: x[0])
        name = _write_arrays(folder, {
            "number": np.array([x[0][2] for x in found], np.int64),
            "cut": np.cumsum([0, *(len(x[1]) for x in found)]),
            "at": np.concatenate([x[1] for x in found]),
            "w": np.concatenate([x[2] for x in found])})
        flat = (np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found]),
                np.cumsum([0, *(len(x[1]) for x in found)]))
        centre = _unit(space.projected(flat).sum(axis=0, keepdims=True))[0]
        return pa.table({"shard": rows.column("shard")[:1], "name": pa.array([name]),
                         "centre": pa.array([centre.tolist()], pa.list_(pa.float32()))})
    return run


def _project(folder: str, terms: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(**_read_arrays(folder, terms))
        for batch in chunks(batches, "text", SLICE):
            counts = [Counter(words(t)) for t in texts(batch)]
            space.learn(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("no"), batch.column("size"),
                 pa.array([x.tobytes() for x in space.projected(space.vectors(counts))])],
                names=["no", "size", "place"])
    return run


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups all examples by their projections, WIDTH numbers each."""
    rows = sorted(x for b in batches for x in zip(*(b.column(c).to_pylist()
                                                    for c in ("no", "size", "place"))))
    if rows:
        place = np.frombuffer(b"".join(x[2] for x in rows), np.float32).reshape(-1, WIDTH)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows]),
             pa.array(_grouped(place))], names=["no", "size", "grp"])


def _idf(size0: int, size1: int):
    """Weight of a term that n0 and n1 examples of the labels hold."""
    n, df = size0 + size1, F.col("n0") + F.col("n1")
    idf = F.log(F.lit(1.0 + n) / (1 + df)) + 1
    phi = (F.abs(F.col("n1") * (size0 - F.col("n0")) - F.col("n0") * (size1 - F.col("n1")))
           / F.sqrt(F.lit(float(max(size0 * size1, 1))) * df * F.greatest(n - df, F.lit(1))))
    return idf * (phi + 1 / max(n, 1))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Model from the labelled documents. Null texts are empty examples, which
    have no vote."""
    sample = saved(examples(docs, labels, per_class), "toxic_examples")
    spark = sample.sparkSession
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    population = {r.toxic: r["n"] for r in
                  labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
                  .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
                  .groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    weight = np.array([population.get(c, 0) / max(size.get(c, 0), 1) for c in (0, 1)])
    folder = scratch_path(spark, "toxic_index")
    weighed = document_frequency(sample).select("h", _idf(n0, n1).alias("idf"),
                                                 (F.col("n0") + F.col("n1")).alias("df"))
    # 20 bytes a distinct term of the examples
    written = saved(weighed.repartition(1).mapInArrow(_write_terms(folder), "name string"),
                    "toxic_terms").collect()
    terms = written[0].name if written else None
    names, centres = [], np.zeros((0, WIDTH), np.float32)
    if terms:
        size_of = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
        # WIDTH numbers for each of the 2 * per_class examples at most in the task that groups
        # them; two numbers for each on the driver
        placed = saved(sample.select("no", "text", size_of)
                       .mapInArrow(_project(folder, terms), "no long, size int, place binary")
                       .repartition(1).mapInArrow(_group, "no long, size long, grp long"),
                       "toxic_groups").collect()
        shard, full, held = [], 0, 0
        for r in sorted(placed, key=lambda r: (r.grp, r.no)):
            if held and held + r.size > SHARD:
                full, held = full + 1, 0
            held += r.size
            shard.append((r.no, full))
        where = spark.createDataFrame(shard, "no long, shard int")
        names = saved(sample.join(F.broadcast(where), "no").select("shard", "no", "text")
                      .groupBy("shard").applyInArrow(_write_shard(folder, terms),
                                                     "shard int, name string, centre array<float>"),
                      "toxic_shards")
        names = sorted(names.collect())
        centres = np.array([r.centre for r in names], np.float32)
        names = [r.name for r in names]
    prior = float((weight[1] * n1 + 0.1) / ((weight * [n0, n1]).sum() + 1.0))
    ids = {r.no: str(r.doc_id) for r in sample.select("no", "doc_id").collect()}
    model = Model(folder, terms, names, centres, ids, weight, prior)
    model.curve = _curve(sample, model)
    return model


def _curve(sample: DataFrame, model: Model) -> tuple[float, float]:
    """Calibration: every example is scored without its own vote, in tasks."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks(batches, "text", SLICE):
            near = model.neighbours(texts(batch), batch.column("no").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("no"), pa.array([model.raw(*x) for x in near], pa.float64())],
                names=["no", "raw"])
    rows = sorted(sample.select("no", "text").repartition(
        sample.sparkSession.sparkContext.defaultParallelism)
        .mapInArrow(run, "no long, raw double").collect())  # 2 * per_class numbers at most
    label = np.array([r.no % 2 for r in rows], np.int64)
    return logistic(np.array([r.raw for r in rows]), label, model.weight[label])


def score(docs: DataFrame, model: Model,
          into: tuple[str, str, str] = ("score", "predicted", "evidence")) -> DataFrame:
    """Adds score (0 to 1), predicted (1 if score >= 0.5) and evidence (id,
    label and cosine of the neighbours that voted) to the columns of ``docs``;
    columns of the names in
    ``into`` are replaced. Null and empty texts have no term and
    get the prior, as do all texts if nothing is labelled. Whole texts are
    read; rows that repeat get the same score each."""
    names = [c for c in docs.columns if c not in into]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.string()), ("label", pa.int32()),
                               ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in chunks(batches, "text", SLICE):
            found = model.score_all(texts(batch))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names),
                 pa.array([s for s, _ in found], pa.float64()),
                 pa.array([int(s >= 0.5) for s, _ in found], pa.int32()),
                 pa.array([[{"doc_id": model.ids[no], "label": no % 2, "cosine": cos}
                            for no, cos in ev] for _, ev in found], kind)],
                names=[*names, *into])
    own = docs.select(*names)
    schema = ", ".join(f"`{c}` {t}" for c, t in own.dtypes)
    return own.mapInArrow(run, f"{schema}, `{into[0]}` double, `{into[1]}` int, `{into[2]}` "
                               "array<struct<doc_id:string,label:int,cosine:double>>")
