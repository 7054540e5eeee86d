"""Vector codes by k-means over parts, with anchors-hierarchy metric trees.

Vectors become integers (floor of 1024 x), cut into PARTS equal parts; every
part position has its own codebook. Rows are packed in blocks; for each block
and part a task builds a metric tree once, middle-out: about sqrt(n) anchors
are found (each new one is the point farthest from the anchor of the widest
ball, and steals what is nearer to it; points nearer to their anchor than half
the distance between the two anchors can't be stolen and are not looked at),
anchors are split further the same way, and then joined in pairs, the tightest
ball first, up to one root. Every ball caches the sum and count of its points.

A round goes down each tree level by level. A ball inherits the candidate
entries of its parent and drops those that a hyperplane test shows to be
farther than the best one from every point of the ball; when one is left the
ball is wholly owned and its cached sum goes to that entry. In leaves the
distances to the candidates left are computed exactly, ties to the smaller
index. Bounds are in floating point with a margin and only drop entries that
are strictly farther, so the result equals that of comparing all entries.

The trees are a table in the shared folder: a lost executor re-reads it. Each
round moves (entries x components) sums a task; the driver holds the codebooks
(ENTRIES vectors), nothing that grows with the rows.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
ROWS = 8192  # rows in a block
BLOCK_BYTES = 8 << 20  # and at most this much of components, as doubles
LEAF = 40  # points in a leaf
MARGIN = 1e-9  # slack of bounds, in parts of the squared extent
BROADCAST_ROWS = 100_000  # labels up to which their sums are broadcast (counted first)
_EXACT = 2.0 ** 52  # squared distances below this are exact as doubles
_LIMB = 40  # bits of a sum that travel in one row


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (array<double>), label of rows whose vector is not null
    and holds no null and no non-finite component."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.where(v.isNotNull() & ~bad)
            .select("vec_id", v.cast("array<double>").alias("vector"), "label"))


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact: int64, or Python integers where they don't fit."""
    if not len(values) or np.abs(values).max() < 2.0 ** 36:
        return np.floor(values * SCALE).astype(np.int64)
    flat = [int(x) * SCALE if abs(x) >= 2.0 ** 52 else int(np.floor(x * SCALE))
            for x in values.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(values.shape)


def extent(*arrays: np.ndarray) -> int:
    """Largest absolute integer (1 at least)."""
    return max([1] + [max(abs(int(a.min())), abs(int(a.max()))) for a in arrays if a.size])


# ---- trees -----------------------------------------------------------------

class Tree:
    """Balls over points in one array, every ball a range ``start:end`` of it.

    ``order``: row of each point; nodes lie level by level, the root first;
    ``parent``/``level`` of each node, ``leaf`` flags, ``centre`` and ``radius``
    (in units of ``unit``), ``total`` (sum of points; the count is the range).
    """

    FIELDS = ("points", "order", "start", "end", "parent", "level", "leaf", "centre", "radius",
              "total")

    def __init__(self, **fields):
        for name in self.FIELDS:
            setattr(self, name, fields[name])
        self.unit = float(extent(self.points))

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        unit = extent(points)
        place = (points / unit).astype(float)
        children: list[tuple] = []  # per node: (left, right) or the rows of a leaf

        def add(node) -> int:
            children.append(node)
            return len(children) - 1

        def ball(rows: np.ndarray) -> tuple[np.ndarray, float]:
            centre = place[rows].mean(axis=0)
            return centre, float(np.sqrt(((place[rows] - centre) ** 2).sum(axis=1).max()))

        def grown(rows: np.ndarray) -> int:
            """Node over ``rows``: anchors found, split further, joined in pairs."""
            groups = (anchors(place[rows], int(np.ceil(np.sqrt(len(rows)))))
                      if len(rows) > LEAF else [])
            if len(groups) < 2:
                return add(rows)
            nodes = [grown(rows[g]) for g in groups]
            return joined(nodes, [ball(rows[g]) for g in groups], [len(g) for g in groups])

        def joined(nodes, balls, sizes) -> int:
            centre = np.array([c for c, _ in balls])
            radius = np.array([r for _, r in balls])
            size = np.array(sizes, float)
            gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
            width = np.maximum((gap + radius[:, None] + radius) / 2,
                               np.maximum(radius[:, None], radius))
            np.fill_diagonal(width, np.inf)
            nodes = list(nodes)
            for _ in range(len(nodes) - 1):
                a, b = divmod(int(width.argmin()), len(nodes))
                nodes[a] = add((nodes[a], nodes[b]))
                mean = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
                radius[a] = max(np.sqrt(((mean - centre[k]) ** 2).sum()) + radius[k]
                                for k in (a, b))
                centre[a], size[a] = mean, size[a] + size[b]
                width[b, :] = width[:, b] = np.inf
                alive = np.isfinite(width[a])
                gap = np.sqrt(((centre[alive] - mean) ** 2).sum(axis=1))
                width[a, alive] = width[alive, a] = np.maximum(
                    (gap + radius[a] + radius[alive]) / 2, np.maximum(radius[a], radius[alive]))
            return nodes[a] if len(nodes) > 1 else nodes[0]

        root = grown(np.arange(len(points)))
        # ranges: leaves from left to right; then nodes level by level
        order, start, end = [], {}, {}
        stack, at = [(root, False)], 0
        while stack:
            node, done = stack.pop()
            kids = children[node]
            if done:
                start[node], end[node] = start[kids[0]], end[kids[1]]
            elif isinstance(kids, tuple):
                stack += [(node, True), (kids[1], False), (kids[0], False)]
            else:
                start[node], at = at, at + len(kids)
                end[node] = at
                order.append(kids)
        rows = np.concatenate(order)
        points, place = points[rows], place[rows]
        flat, parent, level = [root], [-1], [0]
        for i, node in enumerate(flat):  # grows while it is walked
            if isinstance(children[node], tuple):
                flat += children[node]
                parent += [i, i]
                level += [level[i] + 1] * 2
        begin = np.array([start[n] for n in flat])
        stop = np.array([end[n] for n in flat])
        leaf = np.array([not isinstance(children[n], tuple) for n in flat])
        # cached sums: leaves from the points, the others from their children
        total = np.zeros((len(flat), points.shape[1]), points.dtype)
        for i in range(len(flat) - 1, -1, -1):
            if leaf[i]:
                total[i] = points[begin[i]:stop[i]].sum(axis=0)
            if parent[i] >= 0:
                total[parent[i]] += total[i]
        centre = (total / unit).astype(float) / (stop - begin)[:, None]
        radius = np.array([np.sqrt(((place[a:b] - c) ** 2).sum(axis=1).max())
                           for a, b, c in zip(begin, stop, centre)])
        return cls(points=points, order=rows, start=begin, end=stop, parent=np.array(parent),
                   level=np.array(level), leaf=leaf, centre=centre, radius=radius, total=total)

    def packed(self) -> dict[str, np.ndarray]:
        """Arrays to store: integers in the smallest type, huge ones as text."""
        out = {}
        for name in self.FIELDS:
            a = getattr(self, name)
            if a.dtype == object:
                a = a.astype(str)
            elif a.dtype == np.int64:
                a = a.astype(np.result_type(np.int16, np.min_scalar_type(a.min()),
                                            np.min_scalar_type(a.max()))
                             if a.size and extent(a) < 1 << 31 else np.int64)
            out[name] = a
        return out

    @classmethod
    def unpacked(cls, arrays) -> Tree:
        def numbers(a):
            if a.dtype.kind == "U":
                out = np.empty(a.size, object)
                out[:] = [int(x) for x in a.ravel().tolist()]
                return out.reshape(a.shape)
            return a.astype(np.int64) if a.dtype.kind == "i" else a
        return cls(**{name: numbers(arrays[name]) for name in cls.FIELDS})

    def owners(self, book: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int]]:
        """Ranges (start, end, entry): an entry number for a wholly owned ball,
        else an array with the entry of each point (a leaf)."""
        unit = max(self.unit, float(extent(book)))
        shrink = self.unit / unit
        entry = (book / unit).astype(float)
        norm = (entry ** 2).sum(axis=1)
        apart = np.sqrt(((entry[:, None] - entry[None]) ** 2).sum(axis=2))
        slack = MARGIN * book.shape[1] * 8
        alive = np.ones((1, len(book)), bool)
        seen: set[tuple] = set()
        for j, values in enumerate(map(tuple, book.tolist())):  # a repeated entry never wins
            alive[0, j] = values not in seen
            seen.add(values)
        nodes = np.zeros(1, np.int64)
        while len(nodes):
            centre, radius = self.centre[nodes] * shrink, self.radius[nodes] * shrink
            power = norm - 2 * centre @ entry.T  # squared distance, less that of the centre
            best = np.where(alive, power, np.inf).argmin(axis=1)
            lead = power - power[np.arange(len(nodes)), best][:, None]
            alive = alive & ~(lead - 2 * radius[:, None] * apart[best] > slack)
            owned = alive.sum(axis=1) == 1
            for i in np.flatnonzero(owned):
                yield self.start[nodes[i]], self.end[nodes[i]], int(best[i])
            for i in np.flatnonzero(self.leaf[nodes] & ~owned):
                a, b = self.start[nodes[i]], self.end[nodes[i]]
                some = np.flatnonzero(alive[i])
                yield a, b, some[distances(self.points[a:b], book[some]).argmin(axis=1)]
            open_ = np.flatnonzero(~owned & ~self.leaf[nodes])
            below = np.flatnonzero(np.isin(self.parent, nodes[open_]))
            row = np.empty(len(self.parent), np.int64)
            row[nodes[open_]] = open_
            alive = alive[row[self.parent[below]]]
            nodes = below

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the points of every entry."""
        total, count = np.zeros(book.shape, self.total.dtype), np.zeros(len(book), np.int64)
        node_at = {(a, b): i for i, (a, b) in enumerate(zip(self.start.tolist(), self.end.tolist()))}
        for a, b, entry in self.owners(book):
            if isinstance(entry, int):
                total[entry] += self.total[node_at[int(a), int(b)]]  # cached
                count[entry] += b - a
            else:
                np.add.at(total, entry, self.points[a:b])
                count += np.bincount(entry, minlength=len(book))
        return total, count

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of every row, and its exact squared distance (object integers
        where they may not fit a double)."""
        entry = np.empty(len(self.order), np.int64)
        for a, b, e in self.owners(book):
            entry[a:b] = e
        code = np.empty_like(entry)
        code[self.order] = entry
        fits = 4.0 * book.shape[1] * float(min(extent(self.points, book), 1 << 60)) ** 2 < 2.0 ** 62
        gap = self.points.astype(np.int64 if fits else object) - book[entry]
        error = np.empty(len(gap), np.int64 if fits else object)
        error[self.order] = (gap * gap).sum(axis=1)
        return code, error


def distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances less the points' own squared lengths."""
    if 4.0 * book.shape[1] * float(min(extent(points, book), 1 << 60)) ** 2 < _EXACT:
        points, book = points.astype(float), book.astype(float)
    else:
        points, book = points.astype(object), book.astype(object)
    return (book * book).sum(axis=1) - 2 * (points @ book.T)


def anchors(place: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of at most ``most`` anchors: every point with its nearest anchor."""
    owner = np.zeros(len(place), np.int64)
    dist = np.sqrt(((place - place[0]) ** 2).sum(axis=1))
    chosen = [0]
    while len(chosen) < most:
        far = int(dist.argmax())  # of the widest ball
        if dist[far] <= 0:
            break
        half = np.sqrt(((place[chosen] - place[far]) ** 2).sum(axis=1)) / 2
        near = np.flatnonzero(dist > half[owner] * (1 - 1e-12))
        gap = np.sqrt(((place[near] - place[far]) ** 2).sum(axis=1))
        stolen = gap < dist[near]
        owner[near[stolen]] = len(chosen)
        dist[near[stolen]] = gap[stolen]
        chosen.append(far)
    return [g for g in (np.flatnonzero(owner == k) for k in range(len(chosen))) if len(g)]


# ---- jobs ------------------------------------------------------------------

def width_of(length: int) -> int:
    """Components of a part: the longest vector, padded to a multiple of PARTS."""
    return -(-length // PARTS)


def cut(vectors: list, width: int) -> np.ndarray:
    """(rows, PARTS, width) integers; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), PARTS * width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return integers(out).reshape(len(vectors), PARTS, width)


def grow_trees(rows: DataFrame, width: int) -> DataFrame:
    """One row per block: vec_ids, labels, trees (of its parts, serialised)."""
    kinds = dict(rows.dtypes)
    most = max(1, min(ROWS, BLOCK_BYTES // max(8 * PARTS * width, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = most - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) >= most:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        tab = pa.Table.from_batches(held).combine_chunks()
        parts = cut(tab.column("vector").to_pylist(), width)
        store = io.BytesIO()
        np.savez(store, **{f"{name}{p}": a for p in range(PARTS)
                           for name, a in Tree.build(parts[:, p]).packed().items()})
        span = pa.array([0, tab.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(span, tab.column(c).combine_chunks())
                 for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays(
            [*lists, pa.array([store.getvalue()], pa.binary())], names=["vec_ids", "labels", "trees"])
    return rows.mapInArrow(run, f"vec_ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, "
                                "trees binary")


def trees_of(data: bytes) -> list[Tree]:
    with np.load(io.BytesIO(data)) as arrays:
        return [Tree.unpacked({n: arrays[f"{n}{p}"] for n in Tree.FIELDS}) for p in range(PARTS)]


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as (number, limb): the sum of limb << (_LIMB * number)."""
    at = 0
    while value not in (0, -1):
        low = value & ((1 << _LIMB) - 1)
        if low:
            yield at, low
        value >>= _LIMB
        at += 1
    if value:
        yield at, value


def round_sums(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, entry, place (component; -1: count), limb, total."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.shape, object) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for data in batch.column("trees"):
                for p, tree in enumerate(trees_of(data.as_py())):
                    s, n = tree.sums(books[p])
                    total[p] += s
                    count[p] += n
        rows = [(p, int(e), place, at, low) for p in range(PARTS)
                for e in np.flatnonzero(count[p])
                for place, value in enumerate([int(count[p][e]), *total[p][e].tolist()], -1)
                for at, low in limbs(int(value))]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 4 + [pa.int64()])],
            names=["part", "entry", "place", "limb", "total"])
    return (trees.select("trees").mapInArrow(
                run, "part int, entry int, place int, limb int, total long")
            .groupBy("part", "entry", "place", "limb")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))


def moved(books: list[np.ndarray], trees: DataFrame) -> list[np.ndarray]:
    """Codebooks after one round; entries without points stay."""
    values: dict[tuple[int, int, int], int] = {}
    for p, e, place, limb, total in round_sums(trees, books).collect():  # entries x components
        values[p, e, place] = values.get((p, e, place), 0) + (int(total) << (_LIMB * limb))
    out = [b.astype(object) for b in books]
    for p, e in {(p, e) for p, e, _ in values}:
        count = values[p, e, -1]
        out[p][e] = [values.get((p, e, i), 0) // count for i in range(out[p].shape[1])]
    return [b.astype(np.int64) if extent(b) < 1 << 62 else b for b in out]


def assigned(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of every row. An error that a long doesn't
    hold is null."""
    kinds = dict(trees.dtypes)
    id_type, label_type = kinds["vec_ids"][6:-1], kinds["labels"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = [t.codes(b) for t, b in
                         zip(trees_of(batch.column("trees")[i].as_py()), books)]
                text = ["".join(f"{c:02x}" for c in codes)
                        for codes in zip(*[c.tolist() for c, _ in found])]
                error = [sum(e) for e in zip(*[e.tolist() for _, e in found])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_ids")[i].values, batch.column("labels")[i].values,
                     pa.array(text, pa.string()),
                     pa.array([e if e < 1 << 63 else None for e in error], pa.int64())],
                    names=["vec_id", "label", "code", "error"])
    return trees.mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds label_error: the errors of equal labels summed, nulls together
    (null where it doesn't fit a long). Sums of few labels (counted) are
    broadcast; else those of labels with a thousandth of all rows are, a
    thousand at most, and the others are joined by a shuffle."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = saved(rows.groupBy(F.col("label").alias("_label")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.when(F.count("error") == F.count(F.lit(1)), total).try_cast("long")
        .alias("label_error")), "code_labels")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(sums), same, "left").drop("_label", "_n")
    least = sums.agg(F.sum("_n")).first()[0] / 1000
    hot = sums.where((F.col("_n") >= least) | F.col("_label").isNull())
    few = rows.join(F.broadcast(hot), same)
    rare = sums.where((F.col("_n") < least) & F.col("_label").isNotNull())
    many = (rows.join(F.broadcast(hot), same, "left_anti")
            .join(rare, F.col("label") == F.col("_label")))
    return few.unionByName(many).drop("_label", "_n")


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row.

    ``vectors``: vec_id, embedding, label; other columns are ignored. Rows
    whose vector is null or holds null or non-finite components are dropped.
    The first entries are the parts of the ENTRIES smallest vec_ids (null ids
    last; rows that repeat an id by their vectors), all rows if fewer. Vectors
    shorter than the longest, and lengths that PARTS doesn't divide, are
    filled up with zeros. Repeated rows get a row each; zero vectors count.
    No usable row: no rows.
    """
    rows = usable(vectors)
    length = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = width_of(length)
    first = (rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES)
             .select("vector").collect())
    parts = cut([r.vector for r in first], width)
    books = [parts[:, p] for p in range(PARTS)]
    trees = saved(grow_trees(rows, width), "code_trees")
    for _ in range(ROUNDS if first else 0):
        books = moved(books, trees)
    numbers = ",".join(str(int(x)) for b in books for x in b.ravel().tolist())
    sha = hashlib.sha256(numbers.encode()).hexdigest()
    found = saved(assigned(trees, books), "code_rows")
    return (with_label_error(found).withColumn("codebooks_sha256", F.lit(sha))
            .select("vec_id", "code", "error", "label_error", "codebooks_sha256"))
