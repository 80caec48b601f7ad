"""WARC archives: a writer, and a sequential reader with one gzip member per record.

The writer stores each page's html (null: empty) in UTF-8. Of records with equal
payloads of at least ``least`` bytes the one with the smallest page_id is the
response, the others are revisit records that refer to it and carry no payload;
smaller payloads are all responses. The reader walks an archive from its start:
it inflates one gzip member at a time, in bounded steps, frames the record by its
content length and verifies block and payload digests. A truncated member, a
wrong length or a wrong digest raises.

Each task writes an archive of its own name, and only archives named in the
committed manifest are read, so a task that runs twice does no harm. Repeated
rows of one page_id: one of them is the response, the others revisit that
page_id. A null page_id sorts before all others. Null urls are written as an
empty target. An empty table gives no rows. Payloads of any length are written and
read whole, one record at a time. Only page_id, url and html are read, so extra
columns of any name do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.lookups import fair_share, lookup, maybe
from rankloom.llm.stores import create_file, open_file
from rankloom.llm.work import new_path, table

LEAST = 100
CHUNK = 1 << 16
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
EPOCH = "1970-01-01T00:00:00Z"  # the tables carry no capture time
ARCHIVED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def record(kind: str, page: str, url: str, payload: bytes, refers: str | None) -> bytes:
    """One record as a gzip member of its own. A revisit carries the HTTP head only."""
    block = HTTP + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", "".join(c for c in url if c >= " ")),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("X-Payload-Length", str(len(payload))),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}>")] if kind == "revisit" else []),
        ("Content-Length", str(len(block))),
    ]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8") + block + b"\r\n\r\n") + z.flush()


def members(source) -> Iterator[Iterator[bytes]]:
    """The inflated chunks of each gzip member; a member is read up before the next begins."""
    rest = source.read(CHUNK)
    while rest:
        state = {"rest": rest, "done": False}

        def chunks(state=state) -> Iterator[bytes]:
            z = zlib.decompressobj(31)
            data = state["rest"]
            while True:
                if data:
                    if out := z.decompress(data, CHUNK):
                        yield out
                    if z.eof:
                        state["rest"], state["done"] = z.unused_data, True
                        return
                    data = z.unconsumed_tail
                if not data and not (data := source.read(CHUNK)):
                    raise EOFError("the archive ends inside a gzip member")

        it = chunks()
        yield it
        for _ in it:
            pass
        rest = state["rest"] or source.read(CHUNK)


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record, framed by its content length, digests verified."""
    for chunks in members(source):
        held = bytearray()
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not (more := next(chunks, b"")):
                raise ValueError("a record without the end of its header")
            held += more
        lines = held[:at].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        header = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        length = int(header["content-length"])
        block = bytearray(held[at + 4 :])
        for more in chunks:
            block += more
            if len(block) > length + 4:
                raise ValueError("a record longer than its content length")
        if len(block) != length + 4 or block[length:] != b"\r\n\r\n":
            raise ValueError("a record that doesn't match its content length")
        body = bytes(block[:length])
        if digest(body) != header["warc-block-digest"]:
            raise ValueError("a block that doesn't match its digest")
        if header["warc-type"] == "response" and digest(body.partition(b"\r\n\r\n")[2]) != header["warc-payload-digest"]:
            raise ValueError("a payload that doesn't match its digest")
        yield header, body


def write_archives(df: DataFrame, least: int = LEAST) -> DataFrame:
    """Write every page; the manifest (path, n_records) is committed as a table.

    Only pages that may share a digest are joined to the digests that occur more
    than once; a digest of very many pages is broadcast to them (see
    :mod:`rankloom.llm.lookups`). The others are written where they are read.
    """
    folder = new_path(df.sparkSession, "warc")
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.withColumn("key", F.when(F.octet_length("html") >= least, F.sha2(F.col("html").cast("binary"), 256)))
    of_page = keyed.select("page_id", "key").where("key IS NOT NULL").groupBy("key", "page_id").agg(F.count("*").alias("rows"))
    of_key = of_page.groupBy("key").agg(F.sum("rows").alias("n"), F.min(F.struct("page_id", "rows")).alias("lead")).where("n > 1")
    shared = table(of_key.select("key", "n", F.col("lead.page_id").alias("first"), F.col("lead.rows").alias("leads"), F.lit(True).alias("shared")), "warc-shared")
    n = shared.agg(F.count("*").alias("keys"), F.sum("n").alias("rows"), F.coalesce(F.max("leads"), F.lit(0)).alias("leads")).first()
    told = maybe(keyed, F.xxhash64("key"), shared, F.xxhash64("key"), n["keys"])
    some = told.where("_maybe AND key IS NOT NULL").drop("_maybe")
    alone = told.where("NOT _maybe OR key IS NULL").select("page_id", "url", "html", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("first"))
    found = lookup(some, shared, "key", fair_share(n["rows"] or 0, df)).withColumn("shared", F.coalesce("shared", F.lit(False)))
    leads = F.col("page_id").eqNullSafe(F.col("first"))
    if n["leads"] > 1:  # several rows with the responding page's id: one of them is the response, by url
        found = found.withColumn("several", F.col("shared") & leads & (F.col("leads") > 1))
        again = found.where("several").withColumn("again", F.row_number().over(Window.partitionBy("key").orderBy("url")))
        found = found.where("NOT several").withColumn("again", F.lit(1)).unionByName(again)
    else:
        found = found.withColumn("again", F.lit(1))
    revisit = F.col("shared") & (~leads | (F.col("again") > 1))
    ready = alone.unionByName(found.select("page_id", "url", "html", revisit.alias("revisit"), "first"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        sink, n = None, 0
        name = lambda p: "" if p is None else str(p)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for row in batch.slice(i, 64).to_pylist():
                    sink = sink or create_file(path)
                    sink.write(record("revisit" if row["revisit"] else "response", name(row["page_id"]), row["url"], row["html"].encode("utf-8"), name(row["first"])))
                    n += 1
        if sink:
            sink.close()
            yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])

    return table(ready.mapInArrow(run, "path string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type, refers_to and url of every record in the archives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = lambda v: None if v is None or v == "<urn:page:>" else int(v[10:-1])
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            out.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path) as source:
                    for head, body in records(source):
                        size = int(head["x-payload-length"])
                        if head["warc-type"] == "response" and size != len(body) - body.index(b"\r\n\r\n") - 4:
                            raise ValueError("a payload that doesn't match its length")
                        coded = head["warc-payload-digest"].removeprefix("sha256:")
                        hexed = base64.b32decode(coded + "=" * (-len(coded) % 8)).hex()
                        out.append((page(head["warc-record-id"]), size, hexed, head["warc-type"], page(head.get("warc-refers-to")), head["warc-target-uri"]))
                        if len(out) >= 2000:
                            yield flush()
        if out:
            yield flush()

    return a_task_each(manifest).mapInArrow(run, ARCHIVED)


def a_task_each(manifest: DataFrame) -> DataFrame:
    """The paths of a manifest, each in a partition of its own."""
    numbered = manifest.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("at"))  # a row an archive
    return numbered.repartitionById(max(1, manifest.count()), F.col("at")).select("path")
