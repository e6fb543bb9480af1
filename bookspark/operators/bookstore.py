"""Books and topics in a folder, by parts of books: an upsert rewrites the parts that it touches, a read of a book opens one."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookspark.operators.store import upsert
from bookspark.session import cut

#: Parts of a store; a book lies in one of them.
PARTS = 64
#: Rows of a file at most.
FILE_ROWS = 1_000_000


def part_of(book_id: Column, parts: int) -> Column:
    """The part of a book; a null id has one too."""
    return F.pmod(F.xxhash64(F.coalesce(book_id.cast("string"), F.lit(""))), F.lit(parts)).cast("int")


class BookStore:
    """A table (book_id, key, ..., processed_at) in versions.

    data/store_version=V/part=P holds the rows of part P as version V wrote them, sorted by book; manifest/N
    says which version of each part counts. A write makes new files
    and then one new manifest, so readers see all of it or nothing, and files of
    other parts stay as they are. Of two writers at once the second fails.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path, parts

    # --- the manifest ---

    def _files(self, place: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest version; 0 of an empty store."""
        p, fs = self._files("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """part -> version whose files count."""
        version = self.version() if version is None else version
        if not version:
            return {}
        p, fs = self._files(f"manifest/{version:09d}")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text).items()}

    def _publish(self, version: int, manifest: dict[int, int]) -> None:
        draft, fs = self._files(f"manifest/draft-{version}-{id(self)}")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        final, _ = self._files(f"manifest/{version:09d}")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer made version {version}")

    # --- reads ---

    def read(self, version: int | None = None) -> DataFrame | None:
        """The whole table with its column part, by which reads are pruned; None of an empty store."""
        now = self.manifest(version)
        return self._read(now, list(now)) if now else None

    def _read(self, manifest: dict[int, int], parts: list[int]) -> DataFrame:
        paths = [f"{self.path}/data/store_version={manifest[p]}/part={p}" for p in sorted(parts)]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths).drop("store_version")

    def book(self, book_id) -> DataFrame:
        """A book's rows: one part is opened, and within it the files' statistics are asked."""
        own = part_of(F.lit(book_id), self.parts)
        rows = self.read()
        if rows is None:
            raise LookupError("the store is empty")
        return rows.where((F.col("part") == own) & (F.col("book_id") == book_id)).drop("part")

    # --- writes ---

    def upsert(self, updates: DataFrame, key: str, version: str | None = None, now: Column | None = None) -> int:
        """Writes rows by key: the last of a key, by the column `version`, replaces the stored row as a whole and gets a new processed_at.

        A key stays with its book. Only parts that updates touch are read and
        written. Returns the store's new version. No updates make none.
        """
        fields = [c for c in updates.columns if c not in ("processed_at", "part")]
        rows = updates.select(*fields, (F.current_timestamp() if now is None else now).cast(T.TimestampType()).alias("processed_at"), part_of(F.col("book_id"), self.parts).alias("part"))
        rows = cut(rows.withColumn("__v", F.lit(0) if version is None else F.col(version)))
        sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each of self.parts at most
        if not sizes:
            return self.version()
        before = self.version()
        manifest = self.manifest(before)
        stored = [p for p in sizes if p in manifest]
        base = self._read(manifest, stored).withColumn("__v", F.lit(None).cast(rows.schema["__v"].dataType)).select(rows.columns) if stored else rows.limit(0)
        merged = upsert(base, rows, key, "__v").drop("__v")
        new = before + 1
        (
            merged.repartition("part", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("part", "book_id").write.mode("overwrite")
            .option("maxRecordsPerFile", FILE_ROWS).partitionBy("part").parquet(f"{self.path}/data/store_version={new}")
        )
        self._publish(new, manifest | {p: new for p in sizes})
        return new
