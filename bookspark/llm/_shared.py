"""What the operators of this subpackage share: session set-up, row-wise Arrow maps, checkpoints, union-find."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows that an Arrow batch holds at most, so that a batch of long texts stays small.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers of a local session import this package, and keep Arrow batches small."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, paths]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset and the session is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bookspark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df from the shared folder: computed once, safe from lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns of these names in any case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as df has columns of the name, so that none clashes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: Numbers that small() sends to all executors, some 40 MB at most.
SMALL = 1_000_000


def small(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """rows of a few numbers, or of lists of `weight` numbers, marked for broadcast if they are SMALL together; give a checkpoint, which is cheap to count."""
    found = rows.limit(SMALL + 1).count() if weight is None else rows.agg(F.sum(weight + 1)).first()[0] or 0
    return F.broadcast(rows) if found <= SMALL else rows


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """df as a Parquet table of the shared folder, deleted at the end or on an error: for rows that are wide, or read by column."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.parquet(path)
    finally:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def numbered(df: DataFrame, text: str) -> tuple[DataFrame, str, list[Column]]:
    """df with columns c0, c1, ..., the name of `text` in it, and the columns to select for df's own names."""
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)])
    return plain, f"c{df.columns.index(text)}", [F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)]


def add_columns(df: DataFrame, source: str | Column, new: str, function: Callable[[], Callable], kind: str = "binary") -> DataFrame:
    """df with the columns of the DDL `new`, made batch by batch.

    function() runs once in a task and returns a function from a list of
    `source` cast to `kind` (the UTF-8 bytes of a text, or None) to one Arrow
    array or list per new column. A column of df with the name of a new one is replaced.
    """
    fields = T.StructType.fromDDL(new).fields
    kept = without(df, [f.name for f in fields])
    source = F.col(f"`{source}`") if isinstance(source, str) else source
    schema = T.StructType([*kept.schema.fields, *fields])
    types = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = function()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = made(batch.column(batch.num_columns - 1).to_pylist())
            arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[f.name for f in schema.fields])

    names = [F.col(f"`{c}`") for c in kept.columns]
    return df.select(*names, source.cast(kind).alias("__source")).mapInArrow(run, schema)


def parts(texts: list, most: int = 3_000_000):
    """Runs of texts of about `most` bytes together, or a longer one alone."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t or b"") > most:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t or b"")
    yield own


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}[kind.typeName()]


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find: edges (a, b) of any one orderable type -> (node, component), component the smallest node.

    Large-star and small-star steps in turn, with a checkpoint after each
    round, until the edges are stars about the smallest nodes. Every step
    groups by node with a partial minimum first; only edges are shuffled.
    Null ends and loops are left out; no edge gives no row.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u > v").distinct())
    state = None
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .where("u > v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        was, state = state, now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
