"""Operator 4: a deterministic sharded WARC writer and its reader.

Records are sorted by ranges of their id; each shard rolls files by compressed size. Headers, lengths and digests are
made anew from the payload. A file is written under a temporary name and renamed; each shard, and then the whole, ends
with a manifest, so that what no manifest names doesn't count. The same table gives the same bytes, however its rows are
dealt, for the same number of shards.
"""
from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, commit_file, open_fs, order_bounds, partitions, shard_of, trimmed, utf8, written

#: Compressed bytes at which a file is closed; compression level; payloads from this size on are deduplicated.
ROLL, LEVEL, DEDUP_FROM = 64 << 20, 4, 100
#: Bytes of payload in a shard at most, but for one id's equal payloads.
SHARD_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
SALTS = 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: int | None, digest: str, copy: int) -> str:
    """A URI made of what the record is: its page, payload and, for repeated rows, their count."""
    return f"<urn:page:{'null' if page is None else page}:{digest[:32]}:{copy}>"


def warc_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int = 0, date: str = DATE) -> bytes:
    """One record, uncompressed: a response with its payload or, if refers_to is given, a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:none")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_record_id(page, digest, copy)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to, digest, 0)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without a time or name, so that equal records are equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Files:
    """Rolls the files of one shard and commits each under its final name."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.where = open_fs(folder)
        self.shard, self.roll, self.done = shard, roll, []
        ctx = TaskContext.get()
        self.attempt = ctx.taskAttemptId() if ctx else 0
        self.out = None

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{len(self.done):05d}.warc.gz"
            self.out, self.size, self.n, self.sha = self.fs.open_output_stream(f"{self.where}/.{self.name}.tmp-{self.attempt}", compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.n += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            commit_file(self.fs, f"{self.where}/.{self.name}.tmp-{self.attempt}", f"{self.where}/{self.name}")
            self.done.append((self.name, self.n, self.size, self.sha.hexdigest()))
            self.out = None

    def finish(self) -> tuple[int, int, int, int]:
        """Writes the shard's manifest; its (shard, files, records, bytes)."""
        self.close()
        tmp = f"{self.where}/.{_manifest(self.shard)}.tmp-{self.attempt}"
        with self.fs.open_output_stream(tmp) as f:
            f.write(json.dumps(self.done).encode())
        commit_file(self.fs, tmp, f"{self.where}/{_manifest(self.shard)}")
        return self.shard, len(self.done), sum(x[1] for x in self.done), sum(x[2] for x in self.done)


def _manifest(shard: int) -> str:
    return f"shard-{shard:06d}.json"


def first_of_equal(pages: DataFrame, dedup_from: int) -> DataFrame:
    """(page_id, digest, first): for payloads that stand on several rows, the smallest page_id with the payload.

    Only ids and digests are shuffled; a digest that holds a third of all rows is spread over salts.
    """
    keyed = pages.where(F.octet_length("payload") >= dedup_from).select("page_id", F.sha2("payload", 256).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    first = written(first, "warc-first").select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return keyed.join(first, ["digest", "salt"]).groupBy("page_id", "digest").agg(F.min("first").alias("first"))


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll: int = ROLL, dedup_from: int = DEDUP_FROM,
               shards: int | None = None) -> list[tuple[int, int, int, int]]:
    """Writes a record for each row and returns each shard's (shard, files, records, bytes), also in manifest.json; a
    shard's own manifest names its files with (file, records, bytes, sha256).

    Of rows with equal payloads of at least dedup_from bytes the one with the smallest id is a response and the others
    revisit it; of repeated ids the first by (digest, url). A null payload is empty; a null url is urn:none; null ids come
    first and are responses unless an id has their payload. An empty table gives a manifest without shards. There are
    `shards` of them, else as many as the session has shuffle partitions, more where one would pass SHARD_BYTES; an id that
    holds more than a shard is cut by its payloads' digests. Payloads are shuffled once, by ranges of the id; verdicts
    travel beside them and meet them in the sorted shard.
    """
    spark = df.sparkSession
    fs, where = open_fs(folder)
    fs.create_dir(where, recursive=True)
    pages = bounded_batches(df).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), utf8(F.col(payload_col)).alias("payload"))
    upper = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")  # in the order of the digests
    keyed = pages.select(F.col("page_id").alias("id"), F.sha2("payload", 256).alias("digest"), (F.octet_length("payload") + 64).cast("long").alias("size")).select("id", upper.alias("h"), "size")
    bounds = order_bounds(keyed, shards or partitions(spark), SHARD_BYTES)
    count = len(bounds[0]) + 1
    refs = first_of_equal(pages, dedup_from)
    null = lambda kind: F.lit(None).cast(kind)
    both = refs.select("page_id", "digest", F.lit(0).alias("kind"), null("string").alias("url"), null("binary").alias("payload"), "first").unionByName(
        pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.lit(1).alias("kind"), "url", "payload", null("long").alias("first")))
    both = both.withColumn("h", upper)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(bounds, b.column(0), b.column(6)), pa.int32()), *b.columns[:6]], names=["shard", *b.schema.names[:6]])

    dealt = both.mapInArrow(lambda x: trimmed(place(x)), "shard int, page_id long, digest string, kind int, url string, payload binary, first long")
    dealt = dealt.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, shard, key, first, copy, done = None, -1, None, None, 0, []
        for b in batches:
            for k, page, digest, kind, url, payload, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != shard:
                    done += [files.finish()] if files else []
                    files, shard = _Files(folder, k, roll), k
                if (page, digest) != key:
                    key, first, copy = (page, digest), None, 0
                if kind == 0:
                    first = ref
                    continue
                to = first if first is not None and (page != first or copy) else None
                files.add(gzip_member(warc_record(page, url, payload, digest, to, copy)))
                copy += 1
        done += [files.finish()] if files else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*done, strict=True)], names=["shard", "files", "records", "bytes"])

    got = sorted(tuple(r) for r in dealt.mapInArrow(lambda x: trimmed(write(x)), "shard long, files long, records long, bytes long").collect())
    with fs.open_output_stream(f"{where}/.manifest.json.tmp") as f:
        f.write(json.dumps(got).encode())
    commit_file(fs, f"{where}/.manifest.json.tmp", f"{where}/manifest.json")
    return got


def _members(f: pa.NativeFile) -> Iterator[bytes]:
    """The uncompressed members of a gzip file, read in parts."""
    part, d = b"", zlib.decompressobj(31)
    out: list[bytes] = []
    while True:
        part = part or f.read(1 << 20)
        if not part:
            return
        out.append(d.decompress(part))
        part = d.unused_data
        if d.eof:
            yield b"".join(out)
            out, d = [], zlib.decompressobj(31)


def parse_record(data: bytes) -> dict:
    """A record's headers, block and payload; raises ValueError where a length or digest doesn't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    block = rest[:size]
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    if fields["WARC-Type"] == "response" and (len(payload) != length or f"sha256:{hashlib.sha256(payload).hexdigest()}" != fields["WARC-Payload-Digest"]):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    return {"fields": fields, "payload": payload, "length": length}


def _page(uri: str) -> int | None:
    page = uri.strip("<>").split(":")[2]
    return None if page == "null" else int(page)


def files_of(fs: pafs.FileSystem, where: str, shard: int) -> list[str]:
    with fs.open_input_stream(f"{where}/{_manifest(shard)}") as f:
        return [x[0] for x in json.loads(f.read())]


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record that the manifests name: (page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]).

    A task reads a shard's files in parts and checks its records' lengths and digests. A revisit's payload is null, its length
    and digest are those of the full payload.
    """
    fs, where = open_fs(folder)
    with fs.open_input_stream(f"{where}/manifest.json") as f:
        shards = [x[0] for x in json.loads(f.read())]
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    if not shards:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for name in (x for shard in b.column(0).to_pylist() for x in files_of(fs, where, shard)):
                rows, size = [], 0
                with fs.open_input_stream(f"{where}/{name}", compression=None) as f:
                    for data in _members(f):
                        r = parse_record(data)
                        h = r["fields"]
                        own = h["WARC-Type"] == "response"
                        row = (_page(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], r["length"], h["WARC-Payload-Digest"].removeprefix("sha256:"),
                               None if own else _page(h["WARC-Refers-To"]))
                        rows.append((*row, r["payload"] if own else None) if with_payload else row)
                        size += len(data)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    todo = spark.createDataFrame(list(enumerate(shards)), "at int, shard long")
    return todo.repartitionById(len(shards), F.col("at")).select("shard").mapInArrow(read, schema)
