"""WARC archives: a deterministic sharded writer and its reader.

Pages are sorted by id. Every shard_records pages in that order, by exact ranks of (id, digest), are a shard, and one
task writes a shard's files, which roll at a compressed size. A record is one gzip member, compressed before the shuffle,
so that payloads move once and compressed. Files first get temporary names, so a lost or repeated task leaves nothing
that counts; further tasks then rename what the first ones' manifest rows list, and the manifest is written last. Names, bounds and
bytes follow from the pages alone, so equal inputs give equal archives however they are partitioned.

Of records with equal payloads of at least min_revisit_bytes, the one with the smallest id is the response and the
others are revisits that name it. Nulls: a null page is an empty payload, a null URL an empty one. A row with a null id
is a response without Page-ID, and no other refers to it. Repeated ids are written once each; of equal payloads with
the same smallest id all are responses. Columns other than page_id, url and html take no part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import nothing_kept, staged

DATE = "1970-01-01T00:00:00Z"  # a fixed capture date keeps the bytes reproducible
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string"
SLICE = 1 << 16  # bytes that are unpacked at a time
LEAST = -(1 << 63)  # in comparisons, a null id


def described(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and digest (both binary)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"))


def revisits(ids: DataFrame, min_revisit_bytes: int, salts: int = 16) -> DataFrame:
    """page_id, digest and refers_to of the pages to be written as revisits, from page_id, digest and size.

    The smallest id of each digest is found by a partial aggregate, and only digests of two pages or more are joined
    back, salted, so a payload that a third of all pages share meets in no single task.
    """
    rows = ids.filter((F.col("size") >= min_revisit_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    shared = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    wide = shared.select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    return salted.join(wide, ["digest", "salt"]).filter("page_id <> refers_to").select("page_id", "digest", "refers_to")


def bounds(ids: DataFrame, shard_records: int) -> list[tuple[int, bytes]]:
    """The first (id, digest) of each shard: a row for every shard_records pages."""
    order = (F.asc_nulls_first("page_id"), F.asc("digest"))
    ordered = ids.select("page_id", "digest").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = staged(ordered.withColumn("at", F.monotonically_increasing_id()), "warc-order")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    base, total = [], 0
    for r in sorted(ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row for each partition
        base.append((r.part, total))
        total += r.n
    bases = ids.sparkSession.createDataFrame(base, "part long, base long")
    ranked = ordered.withColumn("part", part).join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + row)
    firsts = sorted(ranked.filter(F.col("rank") % shard_records == 0).select("rank", "page_id", "digest").collect(), key=lambda r: r.rank)
    return [(LEAST if r.page_id is None else r.page_id, bytes(r.digest)) for r in firsts]


def record(page_id: int | None, url: str, size: int, payload: bytes, digest: bytes, refers_to: int | None = None) -> bytes:
    """One WARC record, as a gzip member; a revisit has the size and digest of its payload only."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    sha = lambda d: "sha256:" + base64.b32encode(d).decode()
    named = lambda n: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{n}:{digest.hex()}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{named(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(c for c in url if c >= ' ')}",
        f"WARC-Payload-Digest: {sha(digest)}",
        f"WARC-Block-Digest: {sha(hashlib.sha256(block).digest())}",
        *([] if page_id is None else [f"Page-ID: {page_id}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{named(refers_to)}>",
            f"Refers-To-Page-ID: {refers_to}",
        ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def members(rows: DataFrame, firsts: list[tuple[int, bytes]]) -> DataFrame:
    """rows with shard and, for those with a payload, their response record (member) in its place; size is the payload's."""
    shared = rows.sparkSession.sparkContext.broadcast(firsts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        firsts, names = shared.value, ["shard", "page_id", "digest", "refers_to", "url", "size", "member"]
        ids = np.array([f[0] for f in firsts], np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                digests = [d.as_py() for d in batch.column("digest")]
                own = batch.column("page_id").fill_null(LEAST).to_numpy()
                low, high = np.searchsorted(ids, own, side="left"), np.searchsorted(ids, own, side="right")
                shard = [bisect_right(firsts, (i, d), a, b) - 1 if a < b else b - 1 for i, d, a, b in zip(own.tolist(), digests, low.tolist(), high.tolist())]
                payloads = [p.as_py() for p in batch.column("payload")]
                sizes = [None if p is None else len(p) for p in payloads]
                made = zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), sizes, payloads, digests)
                packed = [None if p is None else record(i, u, n, p, d) for i, u, n, p, d in made]
                arrays = [pa.array(shard, pa.int32()), batch.column("page_id"), batch.column("digest"), batch.column("refers_to"), batch.column("url"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, "shard int, page_id long, digest binary, refers_to long, url string, size long, member binary")


def write(pages: DataFrame, folder: str, *, shard_records: int = 5000, roll_bytes: int = 32 << 20, min_revisit_bytes: int = 100) -> DataFrame:
    """Writes all pages under folder (a URI that all executors reach) and returns the manifest: path, records, bytes, sha256."""
    spark = pages.sparkSession
    rows = described(pages)
    ids = staged(rows.select("page_id", "digest", F.octet_length("payload").alias("size")), "warc-ids")
    marks = revisits(ids, min_revisit_bytes)  # they come before the records that they turn into revisits
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True)
    order = ("shard", F.asc_nulls_first("page_id"), "digest", F.asc_nulls_last("refers_to"), "url")
    ordered = members(both.select("page_id", "digest", "refers_to", "url", "payload"), bounds(ids, shard_records)).repartition("shard").sortWithinPartitions(*order)

    def write_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        out, mark, done = None, None, []

        def close() -> None:
            out.pop("file").close()
            out["sha256"] = out["sha256"].hexdigest()
            done.append(out)

        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "page_id", "digest", "refers_to", "url", "size", "member")]
            for row in zip(*columns):
                shard, page_id, digest, refers_to, url, size, member = (x.as_py() for x in row)
                if refers_to is not None:
                    mark = (page_id, digest, refers_to)
                    continue
                if mark and mark[:2] == (page_id, digest):
                    member = record(page_id, url, size, b"", digest, mark[2])
                if out and (out["shard"] != shard or out["bytes"] + len(member) > roll_bytes):
                    close()
                    out = {"shard": shard, "part": out["part"] + 1 if out["shard"] == shard else 0}
                elif not out:
                    out = {"shard": shard, "part": 0}
                if "file" not in out:
                    path = f"{root}/_temporary/{shard}-{out['part']}-{uuid.uuid4().hex}"
                    out |= {"file": fs.open_output_stream(path), "path": path, "records": 0, "bytes": 0, "sha256": hashlib.sha256()}
                out["file"].write(member)
                out["sha256"].update(member)
                out["records"] += 1
                out["bytes"] += len(member)
        if out:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    def place_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths = []
            for shard, part, path in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "path"))):
                name = f"part-{shard:08d}-{part:04d}.warc.gz"
                if fs.get_file_info(path).type == pyarrow.fs.FileType.File:  # else an earlier try of this task has moved it
                    fs.move(path, f"{root}/{name}")
                paths.append(f"{folder.rstrip('/')}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(batch.column(c) for c in ("records", "bytes", "sha256"))], ["path", "records", "bytes", "sha256"])

    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    files = staged(ordered.mapInArrow(write_shards, "shard int, part int, path string, records long, bytes long, sha256 string"), "warc-files")
    placed = files.repartitionByRange("shard", "part").mapInArrow(place_files, "path string, records long, bytes long, sha256 string")
    manifest = staged(placed, "warc-manifest")
    fs.delete_dir(f"{root}/_temporary")
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        for f in manifest.orderBy("path").toLocalIterator():  # a partition of it at a time
            out.write(f"{json.dumps(f.asDict())}\n".encode())
    return manifest


def unpacked(archive: bytes | memoryview) -> Iterator[bytes]:
    """The gzip members of an archive, each unpacked, in time proportional to its size."""
    archive, at = memoryview(archive), 0
    while at < len(archive):
        unzip, parts = zlib.decompressobj(wbits=31), []
        while not unzip.eof:
            if at >= len(archive):
                raise ValueError("the archive ends within a record")
            parts.append(unzip.decompress(archive[at : at + SLICE]))
            at += min(SLICE, len(archive) - at) - len(unzip.unused_data)
        yield b"".join(parts)


def _headers(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:] if ": " in line)


def parse(archive: bytes | memoryview) -> Iterator[tuple]:
    """The records of one archive file, as in RECORDS; raises ValueError where a digest is wrong."""
    for member in unpacked(archive):
        head, _, rest = member.partition(b"\r\n\r\n")
        h = _headers(head)
        block = memoryview(rest)[: int(h["Content-Length"])]
        if h["WARC-Block-Digest"] != "sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode():
            raise ValueError(f"block digest of {h['WARC-Record-ID']}")
        end = rest.index(b"\r\n\r\n")
        digest = base64.b32decode(h["WARC-Payload-Digest"].split(":")[1]).hex()
        if h["WARC-Type"] == "response" and hashlib.sha256(block[end + 4 :]).hexdigest() != digest:
            raise ValueError(f"payload digest of {h['WARC-Record-ID']}")
        page_id, refers = h.get("Page-ID"), h.get("Refers-To-Page-ID")
        size = int(_headers(rest[:end])["Content-Length"])
        yield None if page_id is None else int(page_id), size, digest, h["WARC-Type"], None if refers is None else int(refers), h.get("WARC-Target-URI", "")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the archives under folder; a task holds one file at a time, which the writer's roll size bounds."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for r in parse(content.as_buffer()):
                    rows.append(r)
                    if len(rows) == 5000:
                        yield given(rows)
                        rows = []
                if rows:
                    yield given(rows)

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.mapInArrow(run, RECORDS)
