"""SimHash near-duplicates by a binary trie self-join.

A fingerprint is the bitwise majority of its document's shingle hashes. Equal
fingerprints are one key. The trie of all keys is joined with itself: pairs of
nodes go down together, each differing branch costs one bit, and a pair whose
bits exceed the budget is pruned.

For Spark the upper levels of that join are laid out as rows: of B blocks of
bits, two fingerprints within the budget of k bits differ in at most k, so
B - k blocks agree. For each choice of B - k blocks these come first in the
bit order, and a trie node under which nothing differs yet is one group, the
root of a join over the bits that are left. B follows from the number of
fingerprints so that groups stay small. A group that is large all the same is dealt into parts, and
its pairs of parts are separate groups. A group gives a spanning forest of its
links, not all pairs, and union-find joins the forests.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.llm._shared import add_columns, components, cut, numbered, without

#: Fingerprints that a group of the join has on average, at most, before more blocks are used.
MEAN_GROUP = 16
#: Larger groups are dealt into parts of this size.
PART = 4096
#: Node pairs that a task holds at once.
FRONTIER = 400_000
#: Fingerprints of groups that are joined together.
TOGETHER = 60_000

_WORD = bytes(32 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.translate(_WORD).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(width, len(words)) - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), last)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(documents: DataFrame, text: str = "text", width: int = 4, name: str = "bits") -> DataFrame:
    """documents with the column `name` long, the fingerprint as a signed number; null and empty texts have 0."""

    def make():
        def run(texts):
            return (np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64).tolist(),)

        return run

    return add_columns(documents, text, f"{name} long", make)


def _blocks(count: int, budget: int) -> int:
    blocks = budget + 1
    while blocks < 64 and count / 2 ** (64 * (blocks - budget) / blocks) > MEAN_GROUP and comb(blocks + 1, budget) <= 500:
        blocks += 1
    return blocks


def _masks(blocks: int, budget: int) -> list[int]:
    """For each choice of agreeing blocks, their bits."""
    borders = [64 * k // blocks for k in range(blocks + 1)]
    own = [sum(1 << b for b in range(borders[k], borders[k + 1])) for k in range(blocks)]
    return [sum(own[k] for k in chosen) for chosen in combinations(range(blocks), blocks - budget)]


def links(keys: DataFrame, budget: int = 4) -> DataFrame:
    """keys(bits long, distinct) -> edges (a, b): a spanning forest of all pairs within `budget` bits, group by group."""
    masks = _masks(_blocks(keys.count(), budget), budget)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choices = F.array(*[F.struct(F.lit(k).alias("c"), F.lit(m).cast("long").alias("m")) for k, m in enumerate(signed)])
    rows = keys.select("bits", F.explode(choices).alias("x")).select("bits", F.col("x.c").alias("c"), F.col("bits").bitwiseAND(F.col("x.m")).alias("prefix"))
    large = rows.groupBy("c", "prefix").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    large = cut(large.select("c", "prefix", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    if not large.isEmpty():
        rows = rows.join(large, ["c", "prefix"], "left")
        part = F.pmod(F.xxhash64("bits", "c"), F.col("parts")).cast("int")
        rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part)
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("c", "prefix", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") > F.col("other")).cast("int").alias("right"), "bits")
    else:
        rows = rows.select("c", "prefix", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("right"), "bits")
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "c", "prefix", "p", "q").sortWithinPartitions("c", "prefix", "p", "q")

    def run(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []
        size = 0

        def joined():
            a, b = _forest(np.concatenate(held), masks, budget)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)], axis=1)
            if size > TOGETHER:
                # groups that have ended are joined; the open one is kept
                new = np.flatnonzero((own[:, :4] != held[-1][-1, :4]).any(axis=1))
                if len(new):
                    held.append(own[: new[0]])
                    yield joined()
                    held, size, own = [], 0, own[new[0] :]
            held.append(own)
            size += len(own)
        if held:
            yield joined()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _forest(rows: np.ndarray, masks: list[int], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """rows (c, prefix, p, q, right, bits) of whole groups -> links, at most one for each row."""
    bits = rows[:, 5].astype(np.uint64)
    mask = np.array(masks, np.uint64)[rows[:, 0]]
    keys = np.lexsort((bits & ~mask, rows[:, 4], rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))
    rows, bits = rows[keys], bits[keys]
    rest = bits & ~mask[keys]  # the bits that still count; those of the prefix are equal in a group
    n = len(rows)
    new = np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    split = first + np.add.reduceat(rows[:, 4] == 0, first)
    own = rows[first, 2] == rows[first, 3]
    label = np.arange(n)
    # node pairs: rows [a, b) with rows [c, d), and the bits they differ in
    roots = np.stack([first, np.where(own, last, split), np.where(own, first, split), last, np.zeros(len(first), np.int64)], axis=1)
    stack = [(roots[i : i + FRONTIER], 63) for i in range(0, len(roots), FRONTIER)]
    while stack:
        pairs, bit = stack.pop()
        a, b, c, d, _ = pairs.T
        keep = (a < b) & (c < d) & ~((a == c) & (b - a == 1))
        pairs = pairs[keep]
        a, b, c, d, _ = pairs.T
        leaf = ((b - a == 1) & (d - c == 1)) | (bit < 0)
        ends = pairs[leaf]
        if len(ends):
            near = np.bitwise_count(rest[ends[:, 0]] ^ rest[ends[:, 2]]) <= budget
            _unite(label, ends[near, 0], ends[near, 2])
        pairs = pairs[~leaf]
        if not len(pairs):
            continue
        ones = np.concatenate([[0], np.cumsum((rest >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        a, b, c, d, e = pairs.T
        x, y = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        same = (a == c) & (b == d)
        down = [np.stack([a, x, c, y, e], 1), np.stack([x, b, y, d, e], 1), np.stack([a, x, y, d, e + 1], 1), np.stack([x, b, c, y, e + 1], 1)[~same]]
        down = np.concatenate([p[(p[:, 4] <= budget) & (p[:, 0] < p[:, 1]) & (p[:, 2] < p[:, 3])] for p in down])
        stack += [(down[i : i + FRONTIER], bit - 1) for i in range(0, len(down), FRONTIER)]
    moved = np.flatnonzero(label != np.arange(n))
    signed = bits.view(np.int64)
    return signed[moved], signed[label[moved]]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by the smallest row, until both ends of every link have one label."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:  # every row points at its root
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _grouped(documents: DataFrame, text: str, doc_id: str, budget: int, width: int) -> tuple[DataFrame, DataFrame]:
    """documents with __bits and __id, from the shared folder; and (__key, component_id, __root) of each fingerprint, the root its component's smallest one."""
    found = cut(fingerprints(documents.withColumn("__id", F.col(f"`{doc_id}`")), text, width, "__bits"))
    keys = cut(found.groupBy(F.col("__bits").alias("bits")).agg(F.min("__id").alias("least")))
    groups = components(links(keys.select("bits"), budget))
    named = keys.join(groups, F.col("bits") == F.col("node"), "left").select("bits", "least", F.coalesce("component", "bits").alias("__root"))
    roots = named.groupBy("__root").agg(F.min("least").alias("component_id"))
    return found, named.join(roots, "__root").select(F.col("bits").alias("__key"), "component_id", "__root")


def near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", budget: int = 4, width: int = 4) -> DataFrame:
    """documents with fingerprint (16 hex digits) and component_id, the smallest id reachable by links of `budget` bits.

    Texts without words have fingerprint 0 and are linked like any other.
    Repeated rows stay. A null id is never the smallest unless all ids of its
    component are null. Columns of these names are replaced.
    """
    kept = without(documents, ["fingerprint", "component_id"])
    found, named = _grouped(kept, text, doc_id, budget, width)
    out = found.join(named, F.col("__bits") == F.col("__key"))
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], F.lower(F.lpad(F.hex("__bits"), 16, "0")).alias("fingerprint"), "component_id")


def one_each(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", budget: int = 4, width: int = 4) -> DataFrame:
    """documents with one row of each component: the smallest id, of repeated ids the smallest hash of the text."""
    # a component's rows are told by its root: ids can be null or stand in several components
    plain, text, restored = numbered(documents, text)
    found, named = _grouped(plain, text, plain.columns[documents.columns.index(doc_id)], budget, width)
    # rows are numbered as they lie in the shared folder, which a lost executor doesn't change; the choice is made without texts
    found = found.withColumn("__n", F.monotonically_increasing_id())
    order = F.struct(F.col("__id").isNull().alias("none"), "__id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), "__n")
    narrow = found.select("__bits", order.alias("place"))
    first = narrow.groupBy("__bits").agg(F.min("place").alias("place")).join(named, F.col("__bits") == F.col("__key")).groupBy("__root").agg(F.min("place").alias("place"))
    return found.join(cut(first.select("place.__n")), "__n", "left_semi").select(*restored)
