"""Hard negatives of anchors by a vertical scan of vectors, dimension by dimension.

Vectors are stored in blocks, a block's dimensions one after the other, with
the least and the greatest value of each dimension. An anchor reads a block's
dimensions by the descending magnitude of its own components. What it has read
and the least and greatest that the others can still add bound each row's score; the
bitmap of candidates shrinks to those whose bounds still reach what is wanted:
first the best positives, then the windows of scores that the positives open
for negatives. What is left at the end has its exact score.

Anchors are a stated query set. They go to the blocks in groups of a bounded
size; each task keeps the best few of each anchor only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookspark.llm._shared import cut

#: Numbers of a block at most: rows x dimensions.
BLOCK = 262_144
#: Numbers of the anchors that are sent to the executors at a time: some 16 MB.
GROUP = 2_000_000
#: Dimensions that are read between two looks at the bounds.
STEP = 8
#: A component whose floor is further from zero can't be scored in a long: the row takes no part.
LARGEST = 2**25
#: Rows a task scans at least, where the table has so many.
TASK_ROWS = 16_384

BLOCKS = "ids binary, labels binary, values binary, dims int, least binary, greatest binary"


def blocks(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: float = 256.0) -> DataFrame:
    """Blocks of the rows that take part: rows by label, values as integers floor(scale * x), a dimension after the other."""

    def pack(ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((ids, labels))
        rows = max(1, BLOCK // max(1, values.shape[1]))
        for k in range(0, len(order), rows):
            at = order[k : k + rows]
            own = np.ascontiguousarray(values[at].T.astype("<i4"))
            ends = [own.min(axis=1), own.max(axis=1)] if own.size else [own[:, :0].reshape(-1)] * 2
            data = [ids[at].astype("<i8"), labels[at].astype("<i8"), own]
            columns = [pa.array([x.tobytes()], pa.binary()) for x in data] + [pa.array([values.shape[1]], pa.int32())] + [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in ends]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "values", "dims", "least", "greatest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dims, rows in _whole(batch, scale):
                own = held.setdefault(dims, [])
                own.append(rows)
                if sum(len(r[0]) for r in own) * max(1, dims) >= 4 * BLOCK:
                    yield from pack(*map(np.concatenate, zip(*held.pop(dims))))
        for own in held.values():
            yield from pack(*map(np.concatenate, zip(*own)))

    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    return rows.where("id is not null and label is not null and x is not null").mapInArrow(run, BLOCKS)


def _whole(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[int, tuple]]:
    """(dimensions, (ids, labels, values)) of the rows of a batch whose components are all there, finite and not too large."""
    lists = batch.column(2)
    ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64) if len(flat) else np.zeros(0)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(scale * values)
        bad = ~np.isfinite(values) | ~(np.abs(whole) <= LARGEST)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    spoilt = np.concatenate([[0], np.cumsum(bad)])
    good = spoilt[starts[1:]] == spoilt[starts[:-1]]
    for dims in np.unique(sizes[good]).tolist():
        at = np.flatnonzero(good & (sizes == dims))
        yield dims, (ids[at], labels[at], whole[starts[at][:, None] + np.arange(dims)].astype(np.int64))


class Block:
    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.values = np.frombuffer(row["values"], "<i4").reshape(row["dims"], len(self.ids)).astype(np.int64)
        self.least, self.greatest = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("least", "greatest"))

    def label(self, label: int) -> tuple[int, int]:
        """The rows of a label: they lie together."""
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))


def remaining(vectors: np.ndarray, orders: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that an anchor's dimensions from the k-th on can add, for each k of 0 to all of them."""
    a, b = vectors * least, vectors * greatest
    out = []
    for ends in (np.minimum(a, b), np.maximum(a, b)):
        ends = np.take_along_axis(ends, orders, axis=1)
        sums = np.cumsum(ends[:, ::-1], axis=1)[:, ::-1]
        out.append(np.concatenate([sums, np.zeros((len(vectors), 1), np.int64)], axis=1))
    return out[0], out[1]


def scan(values: np.ndarray, vector: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray | None, wanted: Callable) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, values read) of the rows whose score may be wanted.

    alive: the candidates at the beginning, or None for all. wanted(scores so
    far, least rest, most rest) gives the bitmap of those to keep.
    """
    n, dims = values.shape[1], len(order)
    rows = None if alive is None or len(alive) == n else alive
    have = n if rows is None else len(rows)
    part, read = np.zeros(have, np.int64), 0
    room = np.empty(have, np.int64)
    for k in range(0, dims, STEP):
        if not have or not vector[order[k]]:
            break  # the other components of the anchor are zero as well
        for d in order[k : k + STEP]:
            column = values[d] if rows is None else values[d][rows]
            np.multiply(column, vector[d], out=room)
            part += room
        read += have * min(STEP, dims - k)
        after = min(k + STEP, dims)
        keep = wanted(part, low[after], high[after])
        count = int(np.count_nonzero(keep))
        if count < 0.8 * have:
            rows = np.flatnonzero(keep) if rows is None else rows[keep]
            part, have, room = part[keep], count, np.empty(count, np.int64)
    # all that was not read adds nothing
    keep = wanted(part, 0, 0)
    return (np.arange(n) if rows is None else rows)[keep], part[keep], read


class Best:
    """The first `most` (score, id) by descending score, then id."""

    def __init__(self, most: int):
        self.most, self.scores, self.ids = most, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int | None:
        """The score that a further row has to reach; None while any will do."""
        return int(self.scores[-1]) if len(self.scores) == self.most else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.most]
        self.scores, self.ids = scores[order], ids[order]


def best_positives(block: Block, label: int, own: int, vector, order, low, high, best: Best) -> int:
    """Adds a block's rows of the anchor's label to its best; values read."""
    start, end = block.label(label)
    rows = np.flatnonzero(block.ids[start:end] != own)
    if not len(rows) or best.floor is not None and high[0] < best.floor:
        return 0

    def wanted(part, least, most):
        floor = best.floor
        if len(part) >= best.most:  # so many rows of this block reach that already
            sure = int(np.partition(part, len(part) - best.most)[len(part) - best.most]) + least
            floor = sure if floor is None else max(floor, sure)
        return np.ones(len(part), bool) if floor is None else part + most >= floor

    found, scores, read = scan(block.values[:, start:end], vector, order, low, high, rows, wanted)
    best.add(scores, block.ids[start:end][found])
    return read


def window_negatives(block: Block, label: int, own: int, vector, order, low, high, windows: list[tuple[int, int, Best]]) -> int:
    """Adds a block's rows of other labels to the best of each window [from, to] of scores; values read."""

    def reach() -> tuple[int, int]:
        return min(a if b.floor is None else max(a, b.floor) for a, _, b in windows), max(z for _, z, _ in windows)

    bottom, top = reach()
    if high[0] < bottom or low[0] > top:
        return 0
    start, end = block.label(label)
    others = None if start == end else np.concatenate([np.arange(start), np.arange(end, len(block.ids))])
    if others is not None and not len(others):
        return 0
    found, scores, read = scan(block.values, vector, order, low, high, others, lambda part, least, most: (part + most >= bottom) & (part + least <= top))
    ids = block.ids[found]
    for a, z, best in windows:
        inside = (scores >= a) & (scores <= z) & (ids != own)
        if inside.any():
            best.add(scores[inside], ids[inside])
    return read


def _anchors(data: DataFrame, every: int) -> DataFrame:
    """(n, id, label, x) of the anchors, n a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                at = np.flatnonzero(block.ids % every == 0)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids[at]), pa.array(block.labels[at]), pa.array([block.values[:, k].astype("<i8").tobytes() for k in at], pa.binary())], names=["id", "label", "x"])

    found = data.mapInArrow(run, "id long, label long, x binary")
    return cut(found.select(F.monotonically_increasing_id().alias("n"), "id", "label", "x"))


def _scanned(data: DataFrame, group: list, schema: str, start: Callable, step: Callable, out: Callable) -> DataFrame:
    """What a group of anchors finds in the blocks: start() makes an anchor's state, step() adds a block, out() gives its rows."""
    sent = data.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dims: dict[int, tuple] = {}
        for a in sent.value:
            by_dims.setdefault(len(a["x"]) // 8, []).append(a)
        for dims, own in by_dims.items():
            vectors = np.array([np.frombuffer(a["x"], "<i8") for a in own]).reshape(len(own), dims)
            by_dims[dims] = own, vectors, np.argsort(-np.abs(vectors), axis=1, kind="stable"), [start(a) for a in own]
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch.slice(k, 1).to_pylist()[0])
                dims = len(block.values)
                if dims in by_dims:
                    own, vectors, orders, states = by_dims[dims]
                    low, high = remaining(vectors, orders, block.least, block.greatest)
                    for j, a in enumerate(own):
                        step(block, a, vectors[j], orders[j], low[j], high[j], states[j])
        for own, _, _, states in by_dims.values():
            rows = [r for a, s in zip(own, states) for r in out(a, s)]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=types)

    names = [c.split()[0] for c in schema.split(", ")]
    types = pa.schema([(n, pa.int64()) for n in names])
    return data.mapInArrow(run, schema)


def _first(rows: DataFrame, most: int, score: str, row: str, *key: str) -> DataFrame:
    """The first of each key's rows by score; Spark cuts before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), row))
    return rows.withColumn("rank", place).where(F.col("rank") <= most)


def windows_of(score: int, least: int, most: int) -> tuple[int, int]:
    """The integers s with least * score <= 100 * s <= most * score."""
    return -(-least * score // 100), most * score // 100


def mine(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | Column = "label", every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors, the rows whose id is divisible by `every`.

    A score is the inner product of floor(scale * x), exact. Of each anchor the
    best `positives` other rows of its label count, and for each of those the best
    `negatives` rows of other labels whose score is `least` to `most` percent of the
    positive's. Ties go to the smaller id.

    Rows with a null id, label, vector or component, or a component that is not
    finite or beyond LARGEST, take no part. Vectors meet those of their own
    length only; those without components score 0. Rows with the anchor's
    own id are no partners of it. Repeated rows each count, as anchors too.
    Anchors without a positive or a negative give no row; an empty table none.
    """
    spark = vectors.sparkSession
    name = label if isinstance(label, str) else "__label"
    rows = vectors if isinstance(label, str) else vectors.select(F.col(f"`{vec_id}`"), F.col(f"`{embedding}`"), label.alias(name))
    count = rows.count()
    tasks = max(spark.sparkContext.defaultParallelism, count // TASK_ROWS)
    data = cut(blocks(rows.coalesce(tasks), vec_id, embedding, name, scale))
    anchors = _anchors(data, every)
    size = anchors.agg(F.sum(F.octet_length("x") / 8 + 4)).first()[0] or 0
    groups = max(1, -int(-size // GROUP))
    found = None
    for g in range(groups):
        group = [r.asDict() for r in anchors.where(F.pmod(F.xxhash64("n"), F.lit(groups)) == g).collect()]
        near = _scanned(
            data, group, "n long, id long, score long",
            lambda a: Best(positives),
            lambda block, a, vector, order, low, high, best: best_positives(block, a["label"], a["id"], vector, order, low, high, best),
            lambda a, best: [(a["n"], i, s) for i, s in zip(best.ids.tolist(), best.scores.tolist())],
        )
        near = cut(_first(near, positives, "score", "id", "n"))
        opened: dict[int, list] = {}
        for r in near.collect():
            opened.setdefault(r["n"], []).append(r["score"])
        group = [a | {"scores": sorted(set(opened[a["n"]]))} for a in group if a["n"] in opened]
        group = [a | {"scores": s} for a in group if (s := [x for x in a["scores"] if windows_of(x, least, most)[0] <= windows_of(x, least, most)[1]])]
        far = _scanned(
            data, group, "n long, score long, negative_id long, negative_score long",
            lambda a: [(*windows_of(s, least, most), Best(negatives)) for s in a["scores"]],
            lambda block, a, vector, order, low, high, state: window_negatives(block, a["label"], a["id"], vector, order, low, high, state),
            lambda a, state: [(a["n"], s, i, v) for s, (_, _, b) in zip(a["scores"], state) for i, v in zip(b.ids.tolist(), b.scores.tolist())],
        )
        far = _first(far, negatives, "negative_score", "negative_id", "n", "score")
        ids = anchors.select("n", F.col("id").alias("anchor_id"))
        pairs = near.select("n", F.col("id").alias("positive_id"), "score").join(far, ["n", "score"]).join(ids, "n")
        own = pairs.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
        found = own if found is None else found.unionAll(own)
    return found
