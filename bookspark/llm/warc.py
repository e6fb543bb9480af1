"""WARC archives of pages, and a normaliser for archives that are one gzip stream.

Writing gives archives whose records share one gzip member, as many crawlers
leave them: nothing in them can be read without inflating all before it. The
normaliser inflates such a stream once, in pieces, rewrites every record as a
gzip member of its own and writes a sidecar index with each member's place.
Readers then go straight to a record.

Archives are files in the shared folder (spark.checkpoint.dir); each task
attempt has names of its own and only the names that successful tasks return count, so a
lost executor or a second attempt leaves nothing but an unused file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookspark.llm._shared import cut, shared_dir, small

#: Bytes that are read, inflated or written at a time.
PIECE = 1 << 20
#: Bytes of records after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: A record's header is at most so long.
HEADER_BYTES = 1 << 20
GZIP = 31
LEVEL = 3


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the HTTP header of its page but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    digest = _sha1(payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To-Page: {'' if refers_to is None else refers_to}")
    lines += [f"WARC-Page: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def deduplicated(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, revisit, refers_to): which pages repeat an earlier page's payload.

    Of pages with equal payloads of at least least_bytes, that with the
    smallest id (null last, then url) is the response, others revisit it; of repeated
    rows one is the response. Null html is an empty payload.
    """
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    same = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    first = cut(same.groupBy("digest").agg(F.min(F.struct(order.alias("o"), "n")).alias("x"), F.sum("n").alias("all")).where(F.col("all") > 1).select("digest", F.col("x.o").alias("o"), F.col("x.n").alias("n")))
    # payloads stay where they are if few are repeated
    both = rows.join(small(first, F.lit(4) + F.coalesce(F.length("o.url"), F.lit(0)) / 8), "digest", "left")
    is_first = F.col("o").isNotNull() & F.col("page_id").eqNullSafe(F.col("o.page_id")) & F.col("url").eqNullSafe(F.col("o.url"))
    both = both.withColumn("revisit", F.col("o").isNotNull() & ~is_first)
    if not first.where(F.col("n") > 1).isEmpty():
        # the first page itself is repeated: one of its rows stays a response
        tied = is_first & (F.col("n") > 1)
        place = F.row_number().over(Window.partitionBy("digest", "page_id", "url").orderBy("digest"))
        again = both.where(tied).withColumn("revisit", place > 1)
        both = both.where(~F.coalesce(tied, F.lit(False))).unionByName(again)
    return both.select("page_id", "url", "payload", "revisit", F.when(F.col("revisit"), F.col("o.page_id")).alias("refers_to"))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write records as archives of one gzip member each -> (archive, records), computed once."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        store, top = _files(folder)
        store.create_dir(top, recursive=True)
        archives, counts = [], []
        out = packer = None
        size = 0

        def close():
            nonlocal out
            if out is not None:
                out.write(packer.flush())
                out.close()
                out = None

        for batch in batches:
            for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or size > ARCHIVE_BYTES:
                    close()
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(archives):04d}.whole.warc.gz"
                    out, packer, size = store.open_output_stream(f"{top}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0
                    archives.append(name)
                    counts.append(0)
                data = record(page_id, url, payload, refers_to, revisit)
                out.write(packer.compress(data))
                size += len(data)
                counts[-1] += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array(archives, pa.string()), pa.array(counts, pa.int64())], names=["archive", "records"])

    return cut(records.mapInArrow(run, "archive string, records long"))


class _Inflated:
    """The bytes of a gzip file, member after member, in pieces."""

    def __init__(self, stream):
        self.stream, self.state, self.held, self.rest = stream, zlib.decompressobj(GZIP), b"", b""

    def more(self) -> bool:
        while True:
            if self.state.eof:
                self.rest = self.state.unused_data.lstrip(b"\0") if self.state.unused_data else self.rest
                self.state = zlib.decompressobj(GZIP)
                data, self.rest = self.rest, b""
            else:
                data = self.state.unconsumed_tail
            if not data:
                data = self.stream.read(PIECE)
                if not data:
                    return False
            got = self.state.decompress(data, PIECE)
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes to the end of mark; None at the end of the file."""
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > HEADER_BYTES:
                raise ValueError("a record's header doesn't end")
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record's header")
                return None
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends inside a record")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    rows = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if x)
    return {k.strip().lower(): v.strip() for k, _, v in rows}


def normalise_file(store, whole: str, out: str, index: str) -> int:
    """Rewrite one archive with a member for each record, and a JSON line for each in the index."""
    at = n = 0
    with store.open_input_stream(whole, compression=None) as source, store.open_output_stream(out, compression=None) as members, store.open_output_stream(index, compression=None) as places:
        data = _Inflated(source)
        while (head := data.until(b"\r\n\r\n")) is not None:
            head = head.lstrip(b"\r\n")
            if not head:
                continue
            fields = _fields(head)
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
            members.write(packer.compress(head))
            for piece in data.exactly(int(fields["content-length"]) + 4):
                members.write(packer.compress(piece))
            members.write(packer.flush())
            place = members.tell()
            line = {"offset": at, "length": place - at, "type": fields["warc-type"], "id": fields["warc-record-id"]}
            places.write(json.dumps(line).encode() + b"\n")
            at = place
            n += 1
    return n


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, ...) of one-stream archives -> (archive, index, records) of the rewritten ones, computed once."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, top = _files(folder)
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                out = f"{name.removesuffix('.whole.warc.gz')}-{TaskContext.get().taskAttemptId()}.warc.gz"
                index = out.removesuffix(".warc.gz") + ".index.jsonl"
                rows.append((out, index, normalise_file(store, f"{top}/{name}", f"{top}/{out}", f"{top}/{index}")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["archive", "index", "records"])

    return cut(_spread(archives.select("archive")).mapInArrow(run, "archive string, index string, records long"))


def _spread(names: DataFrame) -> DataFrame:
    """Archive names over as many tasks as the session shuffles to: the files are the work."""
    return names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read(archives: DataFrame, folder: str, limit: int = 256) -> DataFrame:
    """(archive, index) -> (page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive, offset), by the index.

    A response's size and digest are of the payload read; a revisit's are
    those of its header. A digest that doesn't fit its payload is an error.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]
        store, top = _files(folder)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for name, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with store.open_input_file(f"{top}/{name}") as members, store.open_input_stream(f"{top}/{index}", compression=None) as places:
                    for place in _lines(places):
                        members.seek(place["offset"])
                        rows.append((*_read_record(zlib.decompress(members.read(place["length"]), GZIP)), name, place["offset"]))
                        if len(rows) == limit:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return _spread(archives.select("archive", "index")).mapInArrow(run, schema)


def _lines(stream) -> Iterator[dict]:
    rest = b""
    while piece := stream.read(PIECE):
        *whole, rest = (rest + piece).split(b"\n")
        yield from map(json.loads, whole)
    if rest:
        yield json.loads(rest)


def _read_record(data: bytes) -> tuple:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        size = len(payload)
        if _sha1(payload) != digest:
            raise ValueError(f"{fields['warc-record-id']}: the payload doesn't fit its digest")
    else:
        size = int(_fields(http)["content-length"])
    number = lambda x: int(x) if x else None
    return number(fields["warc-page"]), fields.get("warc-target-uri"), size, digest, fields["warc-type"], number(fields.get("warc-refers-to-page"))


def round_trip(spark: SparkSession, pages: DataFrame, **columns) -> DataFrame:
    """Write pages as one-stream archives, normalise these, and read all records back by their index."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    whole = write(deduplicated(pages, **columns), folder)
    return read(normalise(whole, folder), folder)
