"""Vectors: embedding, cosine and exact nearest neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookspark.session import cut, importable

#: Queries that are compared with a block at a time; decimals that count; what rounding may add to a distance.
TOGETHER, DIGITS, SLACK = 256, 9, 5e-5
#: Pivots; numbers of a block and of the vectors of a pivot that lie together, and of the queries that are sent at a time: 16 MB at most.
PIVOTS, BLOCK, CELL, GROUP = 128, 65_536, 2_000_000, 2_000_000


def embed(documents: DataFrame, dim: int = 256, text: str = "text") -> DataFrame:
    """documents with embedding array<float>: hashed word counts weighed by rarity, of unit length."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
    from pyspark.ml.functions import vector_to_array

    words = Tokenizer(inputCol="__t", outputCol="__w").transform(documents.withColumn("__t", F.coalesce(F.col(text), F.lit(""))))
    counts = HashingTF(inputCol="__w", outputCol="__tf", numFeatures=dim).transform(words)
    weighed = IDF(inputCol="__tf", outputCol="__v").fit(counts).transform(counts)
    # in a column expression the norm would be computed anew for each number of the vector
    unit = Normalizer(inputCol="__v", outputCol="__u").transform(weighed)
    return unit.withColumn("embedding", vector_to_array("__u", "float32")).select(*[c for c in documents.columns if c != "embedding"], "embedding")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null with a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d)


def blocks(vectors: DataFrame, unit: bool = False) -> DataFrame:
    """(vec_id, embedding) -> blocks of near vectors: ids, their numbers as bytes, n, dims, the centre and the largest distance from it.

    Vectors lie with those that have the same nearest pivot; pivots are PIVOTS
    vectors by hash. A pivot with many vectors has several blocks, dealt by hash.
    With `unit`, vectors are brought to length one and zero vectors left out;
    null vectors and those with a null component always are.
    """
    import pandas as pd

    importable(vectors.sparkSession)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where("x is not null and not exists(x, c -> c is null)").withColumn("dims", F.size("x"))
    pivots = [r["x"] for r in rows.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()]

    def near(batches):
        for pdf in batches:
            cell = pd.Series(0, index=pdf.index, dtype="int32")
            for dims in pdf["dims"].unique():
                own = [np.array(p) for p in pivots if len(p) == dims]
                at = pdf.index[pdf["dims"] == dims]
                if own and dims:
                    x, p = _matrix(pdf.loc[at, "x"], unit), np.array(own) / (np.maximum(np.linalg.norm(own, axis=1), 1e-300)[:, None] if unit else 1)
                    cell[at] = squared(x, p).argmin(axis=1).astype("int32")
            yield pdf.assign(cell=cell)

    celled = cut(rows.mapInPandas(near, f"vec_id {kind}, x array<double>, dims int, cell int"))
    sizes = celled.groupBy("dims", "cell").agg(F.count("*").alias("n"))
    dealt = celled.join(sizes, ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") * F.greatest("dims", F.lit(1)) / CELL)).cast("int"))

    def pack(batches):
        held, key = [], None

        def out():
            ids, x = [i for p in held for i in p[0]], np.concatenate([p[1] for p in held])
            if unit and x.size:
                keep = np.linalg.norm(x, axis=1) > 0
                ids, x = [i for i, k in zip(ids, keep) if k], x[keep]
            for k in range(0, len(ids), rows_of(x)):
                own = x[k : k + rows_of(x)]
                centre = own.mean(axis=0)
                yield pd.DataFrame({"ids": [ids[k : k + rows_of(x)]], "v": [own.tobytes()], "n": [len(own)], "dims": [own.shape[1]], "centre": [centre.tobytes()], "radius": [float(np.sqrt(squared(own, centre[None])).max())]})

        for pdf in batches:
            for now, own in pdf.groupby(["dims", "cell", "part"], sort=False):
                if key is not None and now != key or sum(p[1].size for p in held) > BLOCK:
                    yield from out()
                    held = []
                key = now
                held.append((own["vec_id"].tolist(), _matrix(own["x"], unit)))
        if held:
            yield from out()

    rows_of = lambda x: max(1, BLOCK // max(1, x.shape[1]))
    return dealt.repartition("dims", "cell", "part").sortWithinPartitions("dims", "cell", "part").mapInPandas(pack, f"ids array<{kind}>, v binary, n int, dims int, centre binary, radius double")


def _matrix(vectors, unit: bool) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors]).reshape(len(vectors), -1)
    if unit and x.size:
        norms = np.linalg.norm(x, axis=1)
        x = x / np.where(norms > 0, norms, 1)[:, None]
    return x


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T), 0)


def reach(upper: np.ndarray, counts: np.ndarray, k: int) -> float:
    """The distance within which at least k vectors lie, if blocks with so many vectors lie within the given distances; infinite if there are fewer."""
    order = np.argsort(upper, kind="stable")
    enough = np.flatnonzero(np.cumsum(counts[order]) >= k)
    return float(upper[order][enough[0]]) if len(enough) else float("inf")


def still_open(distance: np.ndarray, radius: float, limits: np.ndarray) -> np.ndarray:
    """Which queries, at their distance from a block's centre, may have a vector of it within their limit."""
    return distance - radius <= limits + SLACK


def _best(queries: DataFrame, vectors: DataFrame, k: int, name: str, unit: bool) -> DataFrame:
    """(query_id, rank, vec_id, name): the k nearest of each query, ties by id; values are rounded to DIGITS so that equal vectors tie.

    A stated query set goes to the blocks in groups of a bounded size. First the
    blocks' centres bound how far a query's k-th neighbour can be; then a query is
    compared with the blocks that may have a vector within that, which
    shrinks as a task finds nearer ones. By the triangle inequality none is lost.
    """
    import pandas as pd

    spark = vectors.sparkSession
    data = cut(blocks(vectors, unit))
    asked = cut(queries.select(F.monotonically_increasing_id().alias("q"), "query_id", F.col("query_vector").cast("array<double>").alias("x")).where("x is not null and not exists(x, c -> c is null)"))
    groups = max(1, -int(-(asked.agg(F.sum(F.size("x") + 4)).first()[0] or 0) // GROUP))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = None
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(groups)) == g).select("q", "x").collect()
        by_dims: dict[int, tuple] = {}
        for dims in {len(r["x"]) for r in rows}:
            own = [r for r in rows if len(r["x"]) == dims]
            x = _matrix([r["x"] for r in own], unit)
            keep = np.linalg.norm(x, axis=1) > 0 if unit else np.ones(len(own), bool)
            by_dims[dims] = np.array([r["q"] for r in own])[keep], x[keep]
        sent = spark.sparkContext.broadcast(by_dims)

        def bounds(batches, sent=sent):
            best: dict = {}
            for pdf in batches:
                for dims, own in pdf.groupby("dims"):
                    if dims not in sent.value or not len(sent.value[dims][0]):
                        continue
                    centres = np.array([np.frombuffer(c) for c in own["centre"]]).reshape(len(own), dims)
                    upper = np.sqrt(squared(sent.value[dims][1], centres)) + own["radius"].to_numpy()[None]
                    counts = np.broadcast_to(own["n"].to_numpy(), upper.shape)
                    if dims in best:
                        upper, counts = np.hstack([best[dims][0], upper]), np.hstack([best[dims][1], counts])
                    order = np.argsort(upper, axis=1, kind="stable")[:, :k]
                    best[dims] = np.take_along_axis(upper, order, 1), np.take_along_axis(counts, order, 1)
            for dims, (upper, counts) in best.items():
                yield pd.DataFrame({"q": np.repeat(sent.value[dims][0], upper.shape[1]), "upper": upper.ravel(), "n": counts.ravel()})

        uppers = data.select("dims", "centre", "radius", "n").mapInPandas(bounds, "q long, upper double, n int")
        first = F.row_number().over(Window.partitionBy("q").orderBy("upper"))
        near: dict[int, list] = {}
        for r in uppers.withColumn("p", first).where(F.col("p") <= k).collect():
            near.setdefault(r["q"], []).append((r["upper"], r["n"]))
        limits = spark.sparkContext.broadcast({q: reach(np.array([u for u, _ in own]), np.array([n for _, n in own]), k) for q, own in near.items()})

        def scan(batches, sent=sent, limits=limits):
            state = {dims: ([limits.value.get(int(i), float("inf")) for i in q], [([], np.zeros(0))] * len(q)) for dims, (q, _) in sent.value.items()}
            for pdf in batches:
                for dims, ids, v, centre, radius in zip(pdf["dims"], pdf["ids"], pdf["v"], pdf["centre"], pdf["radius"]):
                    if dims not in state or not len(sent.value[dims][0]):
                        continue
                    asked, (limit, best) = sent.value[dims][1], state[dims]
                    open_ = np.flatnonzero(still_open(np.sqrt(squared(asked, np.frombuffer(centre)[None]))[:, 0], radius, np.array(limit)))
                    own, ids = np.frombuffer(v).reshape(len(ids), dims), np.asarray(ids)
                    for at in range(0, len(open_), TOGETHER):
                        some = open_[at : at + TOGETHER]
                        values = np.round(asked[some] @ own.T if unit else squared(asked[some], own), DIGITS)
                        for j, row in zip(some, -values if unit else values):
                            if len(row) > 4 * k:
                                # only what is as near as the k-th of this block
                                few = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])
                            else:
                                few = np.arange(len(row))
                            all_ids, all_values = [*best[j][0], *ids[few].tolist()], np.concatenate([best[j][1], row[few]])
                            order = sorted(range(len(all_ids)), key=lambda m: (all_values[m], all_ids[m]))[:k]
                            best[j] = [all_ids[m] for m in order], all_values[order]
                            if len(order) == k:
                                last = best[j][1][-1]
                                limit[j] = min(limit[j], float(np.sqrt(max(0, 2 + 2 * last if unit else last))))
            for dims, (_, best) in state.items():
                for i, (own, values) in zip(sent.value[dims][0], best):
                    if own:
                        yield pd.DataFrame({"q": int(i), "vec_id": own, name: -values if unit else values})

        own = data.mapInPandas(scan, f"q long, vec_id {kind}, {name} double")
        found = own if found is None else found.unionAll(own)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(name) if unit else F.asc(name), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).join(asked.select("q", "query_id"), "q").select("query_id", "rank", "vec_id", name)


def cosine_scores(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, query_vector) and (vec_id, embedding) -> (query_id, rank, vec_id, score): the k highest cosines; a zero vector has none."""
    return _best(queries, vectors, k, "score", True)


def knn_l2(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest by squared distance; vectors meet queries of their own length."""
    return _best(queries, vectors, k, "distance", False)
