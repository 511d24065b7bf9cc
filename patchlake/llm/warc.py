"""Deterministic sharded WARC writer and a reader of its archives.

Records are dealt to shards by ranges of their id, whose bounds come from a sample
that a hash of the id picks, so they depend on the data alone. A task sorts a shard,
rolls its files by compressed size, makes headers and digests anew and writes every
file under a temporary name of its own attempt. What the attempts that won have written
is a table; a second stage of tasks gives its files their names, and the manifest, a
table too, is written last. What a lost attempt left is never listed. The driver holds
the shards' bounds and sums only, never a list of files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, written

DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f1b7b52-52f4-5f0e-9d2f-3c1f0f6a7d10")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest.parquet"


def file_system(uri: str):
    """The file system of a URI and the path in it, for tasks and driver alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _lines(pairs: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs).encode("utf-8", "surrogatepass")


def record(page_id, url: str | None, payload: bytes, number: int, refers_to=None) -> bytes:
    """One compressed member: a response, or a revisit of the record of page ``refers_to``."""
    sha = digest(payload)
    uri = quote(url or "about:blank", safe="/:?#[]@!$&'()*+,;=%~-._")
    head = b"HTTP/1.1 200 OK\r\n" + _lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = head if refers_to is not None else head + payload
    name = uuid.uuid5(_SPACE, f"{page_id}\n{uri}\n{sha}\n{number}")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Page-ID", "" if page_id is None else str(page_id))]
    if refers_to is not None:
        fields += [("WARC-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + _lines(fields) + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _info(name: str) -> bytes:
    body = _lines([("software", "patchlake"), ("format", "WARC File Format 1.1")])
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + _lines(fields) + b"\r\n" + body + b"\r\n\r\n") + packer.flush()


def _ends(rows: DataFrame, shard_bytes: int, most_shards: int = 16_384, sample: int = 1 << 18) -> list[int]:
    """Upper ends of the shards' id ranges, from a sample of ids that a hash of the id picks: the same for the same rows."""
    many, total = rows.agg(F.count("page_id"), F.sum("bytes")).first()
    if not many:
        return []
    each = max(shard_bytes, -(-total // most_shards))
    share = max(1, -(-many // sample))
    picked = rows.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(share)) == 0)).groupBy("page_id").agg(F.sum("bytes").alias("bytes")).collect()
    ends, held = [], 0
    for page, size in sorted((r["page_id"], r["bytes"]) for r in picked):
        held += size * share
        if held >= each:
            ends.append(page)
            held = 0
    return ends


def _shard_of(ends: list[int], side: int = 64):
    """The place of page_id among ``ends``: first among every ``side``-th end, then among those between."""
    below = lambda array: F.size(F.filter(array, lambda x: x < F.col("page_id")))
    if not ends:
        return F.lit(0)
    steps = F.array(*(F.lit(x).cast("long") for x in ends[side - 1 :: side])) if len(ends) >= side else F.expr("cast(array() as array<bigint>)")
    coarse = below(steps) * side
    fine = below(F.slice(F.array(*(F.lit(x).cast("long") for x in ends)), coarse + 1, F.lit(side)))
    # rows without an id belong to the last shard
    return F.when(F.col("page_id").isNull(), F.lit(len(ends))).otherwise(coarse + fine)


FILES = "name string, tmp string, bytes long, crc32 long, records long"


def write(pages: DataFrame, folder: str, least_revisit: int = 0, roll_bytes: int = 64 << 20, shard_bytes: int = 4 << 20) -> dict:
    """Write a record for every row (page_id, url, html) under ``folder`` and return {"files": how many, "records": how many}.

    Of the records with equal payloads of at least ``least_revisit`` bytes one is the
    response and the others revisit it: the row with the smallest page_id, of several
    with that id the first by url. Shorter ones are all responses, and so are rows
    with a null page_id if no row of their payload has an id. Rows with a null page_id
    come last. A null url is written as about:blank, a null html as an empty payload;
    an empty table writes an empty manifest. A shard is about ``shard_bytes`` of
    payload, more only beyond 16,384 shards; a file ends before ``roll_bytes``
    compressed, or with its shard.
    """
    spark = pages.sparkSession
    fs, root = file_system(folder)
    fs.create_dir(f"{root}/tmp", recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    shared = rows.where(F.col("bytes") >= least_revisit).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha", "first")
    shared = written(shared, "warc-shared")  # its size is known from here on: small enough, it is broadcast
    ends = _ends(rows.select("page_id", "bytes"), shard_bytes)
    dealt = rows.join(shared, "sha", "left").withColumn("shard", _shard_of(ends)).repartition(2 * len(ends) + 1, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "sha", F.col("url").asc_nulls_first())

    def start():
        attempt = uuid.uuid4().hex
        out_fs, out_root = file_system(folder)
        state = {"shard": None, "seq": 0, "file": None, "last": None, "number": 0}
        done: list[dict] = []

        def close():
            if state["file"] is not None:
                state["file"].close()
                done[-1]["bytes"], done[-1]["crc32"] = state["size"], state["crc"]
                state["file"] = None

        def put(data: bytes):
            state["file"].write(data)
            state["size"] += len(data)
            state["crc"] = zlib.crc32(data, state["crc"])

        def open_file():
            name = f"shard-{state['shard']:06d}-{state['seq']:05d}.warc.gz"
            state["seq"] += 1
            state["size"], state["crc"] = 0, 0
            done.append({"name": name, "tmp": f"tmp/{name}.{attempt}", "records": 0})
            state["file"] = out_fs.open_output_stream(f"{out_root}/{done[-1]['tmp']}", compression=None)
            put(_info(name))

        def step(batch: pa.RecordBatch):
            for shard, page, url, payload, sha, first in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != state["shard"]:
                    close()
                    state.update(shard=shard, seq=0)
                # rows of one page and payload lie side by side
                number = state["number"] + 1 if (page, sha) == state["last"] else 0
                state.update(last=(page, sha), number=number)
                refers = first if first is not None and (page != first or number) else None
                data = record(page, url, payload, number, refers)
                if state["file"] is not None and state["size"] + len(data) > roll_bytes:
                    close()
                if state["file"] is None:
                    open_file()
                put(data)
                done[-1]["records"] += 1

        def end():
            close()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in (("name", pa.string()), ("tmp", pa.string()), ("bytes", pa.int64()), ("crc32", pa.int64()), ("records", pa.int64()))], names=["name", "tmp", "bytes", "crc32", "records"])

        step.end = end
        return step

    won = written(map_batches(dealt.select("shard", "page_id", "url", "payload", "sha", "first"), start, FILES), "warc-files")

    def rename():
        at_fs, at_root = file_system(folder)

        def step(batch: pa.RecordBatch):
            for name, tmp, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                here, there = at_fs.get_file_info([f"{at_root}/{tmp}", f"{at_root}/{name}"])
                if here.is_file:
                    at_fs.move(here.path, there.path)
                elif not there.is_file or there.size != size:  # else an attempt before this one has renamed it
                    raise FileNotFoundError(tmp)
            return batch

        return step

    files = map_batches(won, rename, FILES).select("name", "bytes", "crc32", "records")
    files.write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")
    fs.delete_dir(f"{root}/tmp")
    many = manifest(spark, folder).agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0))).first()
    return {"files": many[0], "records": many[1]}


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (name, bytes, crc32, records) of the files that were committed."""
    return spark.read.schema("name string, bytes long, crc32 long, records long").parquet(f"{folder}/{MANIFEST}")


def parse(stream) -> list[dict]:
    """The records of an archive, member by member; digests and lengths are verified."""
    unpack, rest = None, b""
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            if unpack is not None:
                raise ValueError("the archive ends inside a record")
            return
        if unpack is None:
            unpack, parts = zlib.decompressobj(31), []
        parts.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            unpack = None
            yield _record_of(b"".join(parts))


def _record_of(raw: bytes) -> dict:
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    length = int(fields["Content-Length"])
    block = body[:length]
    if len(block) != length or body[length:] != b"\r\n\r\n":
        raise ValueError("wrong Content-Length")
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("wrong block digest")
    return {"fields": fields, "block": block}


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the files in the manifest.

    A revisit's payload is null; its length and digest are those of the full payload.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = manifest(spark, folder).select("name")
    names = names.repartition(max(1, names.count()), "name")

    def start():
        in_fs, in_root = file_system(folder)

        def rows(batch):
            out, held = [], 0
            for name in batch.column(0).to_pylist():
                with in_fs.open_input_stream(f"{in_root}/{name}", compression=None) as stream:
                    for rec in parse(stream):
                        f = rec["fields"]
                        if f["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = rec["block"].partition(b"\r\n\r\n")
                        size = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
                        kind, sha = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != size or digest(payload) != sha):
                            raise ValueError("wrong payload digest")
                        page = f["WARC-Page-ID"].strip()
                        refers = f.get("WARC-Refers-To-Page-ID")
                        out.append((int(page) if page else None, f["WARC-Target-URI"], size, sha, kind, int(refers) if refers else None, payload if kind == "response" else None))
                        held += len(payload)
                        if held > 8_000_000:
                            yield batch_of(out)
                            out, held = [], 0
            if out:
                yield batch_of(out)

        def batch_of(out):
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

        return rows

    return map_batches(names, start, schema)
