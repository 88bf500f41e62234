"""WARC archives: a deterministic sharded writer, and a reader.

Writing. Records are sorted by page id over shards, and each shard is written in order into gzip files,
one member per record, starting a new file when the compressed size passes `roll_bytes`. The shards'
bounds are page ids that follow from the records alone: a histogram of payload bytes over blocks of ids,
refined where a block holds too much, is cut into shards of about `shard_bytes` (of the MAX_SHARDS-th part
of all bytes, if that is more). Headers, lengths, block and payload digests are generated anew, and dates
come from a parameter, so equal tables give equal files however their rows are dealt and in whatever
session. Of records with equal payloads of at least `revisit_min_bytes`, that with the largest page id is
a response and the others are revisits without payload.

Committing. A task writes under temporary names of its own attempt in `<path>/_temporary` and returns a
manifest row per file. Spark's committer keeps the rows of one attempt per task; the files they name
are then moved to `shard-<shard>-<number>.warc.gz`, the manifest with each shard's first page id is
written, and `_SUCCESS` last. Moves can be repeated. Files of lost or repeated attempts are in no manifest and go with the folder.

Files are opened with pyarrow's file systems (file, hdfs, s3, gs); the folder has to be one that all
executors share.

A null payload is empty. A null page id sorts first and counts as the least. Rows with equal page id
and payload are records of their own: the first is written as the response, the rest as its revisits.
A null url leaves out the target header; one with white space or control characters, which a header cannot
hold, stands whole in a header of its own as JSON. Extra columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, lean, materialize, scratch, small_batches

REVISIT_MIN_BYTES = 1000
ROLL_BYTES = 128 << 20
#: Payload bytes of a shard, and a bound of their number (beyond it shards grow).
SHARD_BYTES = 32 << 20
MAX_SHARDS = 100_000
#: Blocks of ids in one histogram, for each shard.
BLOCKS = 8
_NO_ID = -(1 << 63)  # stands for no id, before all others
DATE = "2024-01-01T00:00:00Z"
#: Copies of the rows that tell where a payload's response is; a payload's pages are spread over them.
SALTS = 16
_LEVEL = 6
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_EXACT = "Tessera-Target-JSON"  # a url that a header line cannot hold
_MANIFEST = "shard long, number long, first_page long, file string, temporary string, records long, bytes long, sha256 string"


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    """file:/x, as Hadoop writes it, as file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _b32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{copy}>"


def page_of(record: str) -> int | None:
    text = record.strip("<>").split(":")[2]
    return int(text) if text else None


def _plain(url: str) -> str:
    """url without what ends or folds a header line."""
    return "".join(c for c in url if c > " " and c != "\x7f" and not c.isspace())


def record(page_id: int | None, copy: int, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One record; with refers_to a revisit, whose headers still tell the full payload's digest and length."""
    sha1 = hashlib.sha1(payload).digest()
    block = _HTTP % len(payload) + (b"" if refers_to else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page_id, copy)}", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_plain(url)}"] if url is not None else []), *([f"{_EXACT}: {json.dumps(url)}"] if url is not None and _plain(url) != url else []),
        *([f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {_PROFILE}"] if refers_to else []),
        f"WARC-Payload-Digest: {_b32(sha1)}", f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class _Roller:
    """Writes members into files of about `roll_bytes` compressed bytes."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.root = open_folder(folder)
        self.attempt, self.shard, self.roll = f"_temporary/{uuid.uuid4().hex}", -1, roll_bytes
        self.out, self.done = None, []

    def add(self, shard: int, page_id: int | None, member: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self.fs.create_dir(f"{self.root}/{self.attempt}", recursive=True)
            self.name, self.first = f"{self.attempt}/{shard:06d}-{self.number:05d}.warc.gz", page_id
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.records = self.bytes = 0
            self.sha = hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            n = self.number
            self.done.append((self.shard, n, self.first, f"shard-{self.shard:06d}-{n:05d}.warc.gz", self.name, self.records, self.bytes, self.sha.hexdigest()))
            self.out, self.number = None, n + 1


def revisits(pages: DataFrame, least: int = REVISIT_MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page with a larger id also has."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    seen = pages.select("page_id", payload.alias("p")).where(F.length("p") >= least).select("page_id", F.unhex(F.sha2("p", 256)).alias("digest"))
    top = seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    top = top.select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return salted.join(top, ["digest", "salt"]).where("not (page_id <=> refers_to)").select("page_id", "digest", "refers_to").distinct()


def _block_of(wide: list[tuple[int, int]], steps: list[int]):
    """The first id of the block that an id is in, by ranges (first id, width) and their steps; _NO_ID outside."""
    known, step, last = np.array([a for a, _ in wide], np.int64), np.array(steps, np.uint64), np.array([w - 1 for _, w in wide], np.uint64)

    @F.pandas_udf("long")
    def block(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy().astype(np.int64)
        at = np.maximum(np.searchsorted(known, x, side="right") - 1, 0)
        # unsigned differences: ids may span more than a signed number holds
        off = x.view(np.uint64) - known[at].view(np.uint64)
        first = (known[at].view(np.uint64) + off // step[at] * step[at]).view(np.int64)
        return pd.Series(np.where((x >= known[at]) & (off <= last[at]), first, _NO_ID))

    return block


def shard_bounds(pages: DataFrame, shard_bytes: int = SHARD_BYTES, max_shards: int = MAX_SHARDS) -> list[int]:
    """The least page ids of the second and later shards, from the records alone. Ids are counted in blocks of
    equal width; a block with more than a shard's bytes is counted again in finer ones. A null id is
    before all. The driver holds BLOCKS numbers a shard."""
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), (F.coalesce(F.octet_length("html"), F.lit(0)) + F.lit(512)).cast("long").alias("n"))
    low, high, total = sized.agg(F.min("page_id"), F.max("page_id"), F.sum("n")).first()
    if low is None:
        return []
    target = max(shard_bytes, -(-total // max_shards))
    wide = [(low, high - low + 1)]  # (first id, width) of what is still to be counted
    found: list[tuple[int, int]] = []
    while wide:
        each = max(2, min(1 << 20, BLOCKS * -(-total // target)) // len(wide))
        starts = [a for a, _ in wide]
        steps = [-(-w // each) for _, w in wide]

        counted = sized.where("page_id is not null").groupBy(_block_of(wide, steps)("page_id").alias("first")).agg(F.sum("n").alias("n")).where(F.col("first") != _NO_ID).toPandas()
        sums = dict(zip(counted["first"].astype(np.int64).tolist(), counted["n"].astype(np.int64).tolist(), strict=True))
        nxt = []
        for first in sorted(sums):
            owner = bisect.bisect_right(starts, first) - 1
            width = min(steps[owner], sum(wide[owner]) - first)
            if sums[first] > target and width > 1:
                nxt.append((first, width))
            else:
                found.append((first, sums[first]))
        wide = nxt
    bounds, held = [], 0
    for first, n in sorted(found):
        if held and held + n > target:
            bounds.append(first)
            held = 0
        held += n
    return bounds


def write(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least: int = REVISIT_MIN_BYTES, date: str = DATE) -> DataFrame:
    """Write pages(page_id, url, html) to a new folder; returns its manifest (file, records, bytes, sha256)."""
    spark = pages.sparkSession
    small_batches(spark)
    path = _uri(path)
    later = materialize(revisits(pages, least), "revisits")
    bounds = np.array(shard_bounds(pages, shard_bytes), np.int64)
    # A page's revisit note sorts just before the page, so that one pass over a shard sees both.
    notes = later.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to", F.lit(True).alias("note"))
    rows = pages.select("page_id", "url", "html", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("note"))

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))

    # A shard is a partition; equal page ids are in one shard, and the order within it is total.
    dealt = rows.unionByName(notes).withColumn("shard", shard_of(F.coalesce("page_id", F.lit(_NO_ID)))).repartitionById(len(bounds) + 1, "shard")
    sorted_ = dealt.sortWithinPartitions("shard", "page_id", F.col("note").desc(), F.xxhash64("html"), "html", "url")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = _Roller(path, roll_bytes)
        page, copy, refers, first = object(), 0, {}, {}
        for batch in batches:
            for p, url, html, digest, to, note, shard in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to", "note", "shard")), strict=True):
                if (p := p.as_py()) != page:
                    page, copy, refers, first = p, 0, {}, {}
                if note.as_py():
                    refers[digest.as_py()] = to.as_py()
                    continue
                payload = b"" if (h := html.as_py()) is None else h.encode()
                target = None
                if len(payload) >= least:
                    sha = hashlib.sha256(payload).digest()
                    target = record_id(refers[sha], 0) if sha in refers else first.get(sha)
                    first.setdefault(sha, record_id(page, copy))
                roller.add(shard.as_py(), page, _member(record(page, copy, url.as_py(), payload, target, date)))
                copy += 1
        roller.close()
        if roller.done:
            yield pa.RecordBatch.from_pylist([dict(zip([f.split()[0] for f in _MANIFEST.split(", ")], row, strict=True)) for row in roller.done])

    tentative = materialize(sorted_.mapInArrow(run, _MANIFEST), "manifest")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(path)
        for batch in batches:
            for row in batch.to_pylist():
                a, b = f"{root}/{row['temporary']}", f"{root}/{row['file']}"
                if fs.get_file_info(a).type != pafs.FileType.NotFound:
                    fs.move(a, b)
                elif fs.get_file_info(b).size != row["bytes"]:
                    raise OSError(f"{row['file']} is missing")
            yield batch

    moved = tentative.mapInArrow(move, _MANIFEST).drop("temporary")
    moved.write.parquet(f"{path}/manifest")
    fs, root = open_folder(path)
    if fs.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{root}/_temporary")
    fs.create_dir(root, recursive=True)
    fs.open_output_stream(f"{root}/_SUCCESS").close()
    return spark.read.parquet(f"{path}/manifest")


def members(stream: io.RawIOBase | pa.NativeFile) -> Iterator[bytes]:
    """The members of a gzip file, one at a time."""
    z, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            break
        parts.append(z.decompress(data))
        rest = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the archive ends within a member")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if _EXACT in fields:
        fields["WARC-Target-URI"] = json.loads(fields[_EXACT])
    block = rest[: int(fields["Content-Length"])]
    if _b32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    return fields, block


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of a folder's manifest: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, and with payload=True the payload itself (null for revisits). Digests are checked."""
    small_batches(spark)
    path = _uri(path)
    manifest = spark.read.parquet(f"{path}/manifest").select("file", "bytes")
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payload

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(path)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for raw in members(stream):
                        rows.append(_row(*parse(raw), payload))
                        if len(rows) >= BATCH_ROWS // 4:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    # a task reads one file, as many as there are
    files = manifest.repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if payload else ""))


def _row(fields: dict[str, str], block: bytes, payload: bool) -> tuple:
    http, _, body = block.partition(b"\r\n\r\n")
    kind, to = fields["WARC-Type"], fields.get("WARC-Refers-To")
    sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if kind == "response" and hashlib.sha1(body).digest() != sha1:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    out = (page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, page_of(to) if to else None, length, sha1.hex())
    return out + ((body if kind == "response" else None,) if payload else ())


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a new folder of the shared one and read them back."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
