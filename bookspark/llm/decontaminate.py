"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Words of documents and items are lower-cased A-Z runs. Each item gives
windows of `window` consecutive words; a window is a set of word shingles at
known positions. Shingles are ordered by rarity, counted over all documents.
A window that is wholly contained in a document shares its rarest shingle
with it, so one shingle is its necessary prefix. Documents meet windows on
prefix shingles only; length and positional bounds follow, and then the exact
comparison of every word.

Items are small beside documents: windows go to the tasks in blocks of at
most BLOCK_BYTES, as many blocks as the items need, each against all rows. No
document text is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.llm._shared import add_columns, cut, numbered, without

#: Bytes of window text that are sent to the tasks at a time.
BLOCK_BYTES = 16 << 20
#: Item ids that one row of windows holds at most.
IDS_IN_A_ROW = 1000
#: Words longer than this many bytes are compared by their SHA-256.
LONG_WORD = 64

_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words of letters, digits and non-ASCII characters."""
    found = text.translate(_WORD).split() if text else []
    if text and len(text) > LONG_WORD and any(map(LONG_WORD.__lt__, map(len, found))):
        import hashlib

        found = [w if len(w) <= LONG_WORD else b"=" + hashlib.sha256(w).hexdigest().encode() for w in found]
    return found


def windows_of(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(words, ids): the distinct windows of all items, and the items that have them.

    An item of fewer words, but not none, is one window. Items with a null id
    or no words have no window. Ids of a widespread window fill several rows.
    """

    def make():
        def run(texts):
            out = []
            for t in texts:
                w = [x.decode("utf-8", "replace") for x in words_of(t)]
                out.append([w[i : i + window] for i in range(max(1, len(w) - window + 1))] if w else [])
            return [out]

        return run

    rows = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("id is not null")
    rows = add_columns(rows, "text", "windows array<array<string>>", make)
    rows = rows.select("id", F.explode("windows").alias("words")).distinct()
    salted = rows.withColumn("part", F.floor(F.abs(F.xxhash64("id")) % 64))
    grouped = salted.groupBy("words", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    chunks = F.expr(f"transform(sequence(0, (size(ids) - 1) div {IDS_IN_A_ROW}), i -> slice(ids, int(i) * {IDS_IN_A_ROW} + 1, {IDS_IN_A_ROW}))")
    return grouped.select("words", F.explode(chunks).alias("ids"))


def _index(rows: list, shingle: int) -> dict:
    """Windows of a block as arrays of word numbers; codes of their shingles by shingle size."""
    vocabulary: dict[bytes, int] = {}
    windows = [np.array([vocabulary.setdefault(w.encode(), len(vocabulary) + 1) for w in r["words"]], np.int64) for r in rows]
    sizes: dict[int, list[int]] = {}
    for k, w in enumerate(windows):
        sizes.setdefault(min(shingle, len(w)), []).append(k)
    return {"vocabulary": vocabulary, "windows": windows, "ids": [list(r["ids"]) for r in rows], "sizes": sizes, "codes": {s: np.unique(np.concatenate([_codes(windows[k], s) for k in own])) for s, own in sizes.items()}}


def _codes(numbers: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of each run of `size` word numbers; equal runs have equal codes."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    u = numbers.astype(np.uint64)
    code = np.zeros(n, np.uint64)
    for i in range(size):
        code = code * _PRIME + u[i : i + n]
    return code


def _numbers(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    get = vocabulary.get
    return np.array([get(w, 0) for w in words], np.int64)


def _at(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of codes that are in sorted_codes, and where they are there."""
    if not len(sorted_codes) or not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    hit = np.flatnonzero(sorted_codes[k] == codes)
    return hit, k[hit]


def _frequencies(documents: DataFrame, text: str, shared) -> dict[int, dict[int, int]]:
    """How often each shingle of the block occurs in all documents; at most one row a shingle comes back."""
    import pyarrow as pa

    def run(batches):
        index = shared.value
        counts = {s: np.zeros(len(c), np.int64) for s, c in index["codes"].items()}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                numbers = _numbers(words_of(t), index["vocabulary"])
                for s, codes in index["codes"].items():
                    np.add.at(counts[s], _at(codes, _codes(numbers, s))[1], 1)
        for s, n in counts.items():
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), s)), pa.array(own), pa.array(n[own])], names=["size", "at", "n"])

    rows = documents.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "size long, at long, n long")
    found: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("size", "at").agg(F.sum("n").alias("n")).toLocalIterator():
        found.setdefault(r["size"], {})[r["at"]] = r["n"]
    return found


def _prefixes(index: dict, frequencies: dict[int, dict[int, int]]) -> dict[int, tuple]:
    """By shingle size: the sorted prefix codes, and for each the windows that have it, with its place in them."""
    out = {}
    for s, own in index["sizes"].items():
        counts = np.zeros(len(index["codes"][s]), np.int64)
        for at, n in frequencies.get(s, {}).items():
            counts[at] = n
        picked = []
        for k in own:
            codes = _codes(index["windows"][k], s)
            rare = counts[np.searchsorted(index["codes"][s], codes)]
            j = int(np.lexsort((codes, rare))[0])
            picked.append((int(codes[j]), k, j))
        picked.sort()
        codes = np.array([p[0] for p in picked], np.uint64)
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        out[s] = (codes[first], np.append(first, len(codes)), [p[1] for p in picked], [p[2] for p in picked])
    return out


def _occurrences(numbers: np.ndarray, index: dict) -> list[tuple[int, int, int]]:
    """(start, end, window) of every window in the document."""
    out = []
    n = len(numbers)
    for s, (codes, first, windows, offsets) in index["prefixes"].items():
        for pos, at in zip(*(x.tolist() for x in _at(codes, _codes(numbers, s)))):
            for j in range(first[at], first[at + 1]):
                w = index["windows"][windows[j]]
                start = pos - offsets[j]
                if start >= 0 and start + len(w) <= n and np.array_equal(numbers[start : start + len(w)], w):
                    out.append((start, start + len(w), windows[j]))
    return out


def contamination(documents: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents with n_words, hit_spans (word positions, merged) and hit_items (ids of items with a window that occurs).

    Null and empty texts have no words and no hits; repeated rows stay, each
    with its own result; without items all hits are empty. Columns of these
    names are replaced.
    """
    windows = cut(windows_of(items, window, item_id, item_text))
    size = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 8) + 8 * F.size("ids")
    total = windows.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = without(documents, ["n_words", "hit_spans", "hit_items"])
    spark = documents.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    for b in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()
        index = _index(rows, shingle)
        counted = spark.sparkContext.broadcast({"vocabulary": index["vocabulary"], "codes": index["codes"]})
        index["prefixes"] = _prefixes(index, _frequencies(documents, text, counted) if rows else {})
        counted.unpersist()
        del index["codes"], index["sizes"]
        out = _mark(out, text, kind, spark.sparkContext.broadcast(index), b)
    return out.select(*[F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("n_words", "hit_spans", "hit_items")], *_merged(blocks))


def _merged(blocks: int) -> list:
    if blocks == 1:
        return [F.col("__n0").alias("n_words"), F.col("__s0").alias("hit_spans"), F.col("__i0").alias("hit_items")]
    spans = F.array_sort(F.flatten(F.array(*[F.col(f"__s{b}") for b in range(blocks)])))
    merge = F.aggregate(
        spans, F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda a, s: F.when(F.size(a) == 0, F.array(s)).when(F.element_at(a, -1)["end"] < s["start"], F.concat(a, F.array(s)))
        .otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))))),
    )
    return [F.col("__n0").alias("n_words"), merge.alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"__i{b}") for b in range(blocks)])))).alias("hit_items")]


def _mark(documents: DataFrame, text: str, kind: str, shared, b: int) -> DataFrame:
    def make():
        index = shared.value

        def run(texts):
            lengths, spans, items = [], [], []
            for t in texts:
                words = words_of(t)
                found = sorted(_occurrences(_numbers(words, index["vocabulary"]), index)) if words else []
                own: list[dict] = []
                for start, end, _ in found:
                    if own and start <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], end)
                    else:
                        own.append({"start": start, "end": end})
                lengths.append(len(words))
                spans.append(own)
                items.append(sorted({i for _, _, w in found for i in index["ids"][w]}))
            return lengths, spans, items

        return run

    return add_columns(documents, text, f"__n{b} long, __s{b} array<struct<start: long, end: long>>, __i{b} array<{kind}>", make)


def decontaminate(documents: DataFrame, items: DataFrame, every: int = 20, text: str = "text", **options) -> DataFrame:
    """documents without the contaminated ones: those where a hit covers at least one word in `every`.

    Rows keep their columns, of any name; texts without words stay.
    """
    plain, text, restored = numbered(documents, text)
    marked = contamination(plain, items, text, **options)
    clean = ~((hits() > 0) & (F.lit(every) * hits() >= F.col("n_words")))
    return marked.where(clean).select(*restored)


def hits():
    """Words inside hit_spans."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
