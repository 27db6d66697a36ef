"""WARC archives in Zstandard with a dictionary: write records, read and validate them."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.common import materialize
from tallybook.session import as_lookup, scratch_path

# Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D  # skippable frame that holds the dictionary
FRAME_MAGIC = 0xFD2FB528
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 4096, 32768  # of which the dictionary is trained
ARCHIVE_BYTES = 4 << 20  # an archive is closed after this many compressed bytes
RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("block_bytes", T.LongType()),
])


def digest(payload: bytes) -> str:
    """Base32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@F.pandas_udf(T.StructType([T.StructField("digest", T.StringType()), T.StructField("bytes", T.LongType())]))
def _measure(html: pd.Series) -> pd.DataFrame:
    payloads = html.map(lambda t: (t or "").encode("utf-8", "surrogatepass"))
    return pd.DataFrame({"digest": payloads.map(digest), "bytes": payloads.map(len)})


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the heads of ``SAMPLE_PAGES`` pages chosen by hash, ``SAMPLE_BYTES`` characters of each.

    The share of hashes that is looked at holds twice as many pages as are wanted, however many there are, so that no more heads leave their tasks.
    Empty where there is too little to train on; archives then hold no dictionary frame.
    """
    spread = 1 << 40
    share = min(1.0, 2 * SAMPLE_PAGES / max(1, pages.filter("html is not null").count()))
    narrow = pages.filter("html is not null").select(F.xxhash64("page_id", "url").alias("h"), F.substring("html", 1, SAMPLE_BYTES).alias("head"))
    chosen = narrow.filter(F.pmod("h", F.lit(spread)) < F.lit(int(share * spread))).repartition("h")
    samples = [(r["head"] or "").encode("utf-8", "surrogatepass") for r in chosen.orderBy("h", "head").limit(SAMPLE_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    """One WARC record: version, named fields, block."""
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {_field(v)}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _field(value: object) -> str:
    """A field's value on one line: percent and line ends are percent-encoded."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unfield(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _record_id(page_id: object) -> str:
    return f"<urn:page:{page_id}>"


def page_record(row: dict) -> bytes:
    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
    fields = {
        "WARC-Record-ID": _record_id(row["page_id"]), "WARC-Target-URI": row["url"], "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{row['digest']}", "WARC-Payload-Length": row["bytes"],
    }
    if row["revisit"]:
        fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": _record_id(row["refers_to"])}
        block = HTTP_HEAD
    else:
        block = HTTP_HEAD + payload
    fields |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response"}
    return record("revisit" if row["revisit"] else "response", fields, block)


class _Archive:
    """Builds one archive in memory, of about ``ARCHIVE_BYTES``, then puts it in place under its own name."""

    def __init__(self, root: str, dictionary: bytes):
        self.root, self.dictionary = root, dictionary
        self.coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.frames: list[bytes] = []
        self.size = 0

    def add(self, row: bytes) -> None:
        frame = self.coder.compress(row)
        self.frames.append(frame)
        self.size += len(frame)

    def close(self) -> dict:
        head = struct.pack("<II", DICTIONARY_MAGIC, len(self.dictionary)) + self.dictionary if self.dictionary else b""
        info = self.coder.compress(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC\r\n"))
        data = b"".join([head, info, *self.frames])
        system, path = pyarrow.fs.FileSystem.from_uri(self.root)
        system.create_dir(path, recursive=True)
        # a name of its own for every attempt: a repeated task never touches another's archive
        name = f"{path}/{uuid.uuid4().hex}.warc.zst"
        with system.open_output_stream(name, compression=None) as out:
            out.write(data)
        done = {"archive": os.path.basename(name), "records": len(self.frames), "bytes": len(data)}
        self.frames, self.size = [], 0
        return done


def assign_types(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Pages with digest, payload length and what record they become.

    Among equal payloads of ``min_payload`` bytes or more the one with the smallest page id is the
    response (null ids last, of equal ids the first by url); the others revisit it.
    """
    measured = pages.select("page_id", "url", "html", _measure("html").alias("m")).select("page_id", "url", "html", "m.*")
    ids = materialize(measured.select("page_id", "url", "digest", "bytes"), "digests")
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    same = ids.filter(F.col("bytes") >= min_payload).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    joined = measured.join(as_lookup(same.select("digest", "first")), "digest", "left")
    is_first = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id"), F.col("url")).eqNullSafe(F.col("first"))
    revisit = F.col("first").isNotNull() & ~is_first
    return joined.select("page_id", "url", "html", "digest", "bytes", revisit.alias("revisit"), F.when(revisit, F.col("first.page_id")).alias("refers_to"))


def write_archives(typed: DataFrame, root: str, dictionary: bytes) -> DataFrame:
    """Write one record per row into archives below ``root``; the manifest of archives that count.

    Each task writes archives of bounded size under names of their own. Only those in the
    manifest, which holds the successful attempts, are part of the result, so a lost executor or a
    repeated task leaves at most files that nobody reads.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(root, dictionary)
        done = []
        for batch in batches:
            for row in batch.to_pylist():
                archive.add(page_record(row))
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
        if archive.frames:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return typed.mapInArrow(write, "archive string, records long, bytes long")


def frames(data: bytes) -> Iterator[bytes]:
    """Records of an archive: the dictionary from the leading skippable frame, one frame per record.

    Raises ValueError on a bad frame, or one that holds no content size, ends early or is followed by other bytes.
    """
    at, coder = 0, zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if len(data) < 8 + size:
            raise ValueError("dictionary frame is cut")
        raw = data[8 : 8 + size]
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        at = 8 + size
    while at < len(data):
        one = coder.decompressobj()
        try:
            out = one.decompress(memoryview(data)[at:])
        except zstandard.ZstdError as e:
            raise ValueError(f"bad frame at {at}: {e}") from e
        if not one.eof:
            raise ValueError(f"frame at {at} is cut")
        yield out
        at = len(data) - len(one.unused_data)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record; ValueError if header, length or block digest are wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad field {line[:40]!r}")
        fields[name.strip().lower()] = _unfield(value.strip())
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("block length differs from Content-Length")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    return fields, block


def _page_of(record_id: str | None) -> int | None:
    inner = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner not in ("", "None") else None


def read_record(raw: bytes) -> dict | None:
    """A row of ``RECORD`` for a response or revisit, None for other records."""
    fields, block = parse(raw)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    found, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["warc-payload-length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if digest(payload) != found or len(payload) != size:
            raise ValueError("payload differs from its digest or length")
    return {
        "page_id": _page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": found,
        "record_type": kind, "refers_to": _page_of(fields.get("warc-refers-to")), "block_bytes": len(block),
    }


def read_archives(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Records of the archives in the manifest, validated; a bad archive fails the read.

    Spark lists and loads the files; an archive is bounded in size, save one whose single record is larger.
    """
    files = spark.read.format("binaryFile").load(root)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").join(manifest.select("archive", "records"), "archive")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            for archive in batch.to_pylist():
                rows = [r for r in map(read_record, frames(archive["content"])) if r]
                if len(rows) != archive["records"]:
                    raise ValueError(f"{archive['archive']} holds {len(rows)} records, not {archive['records']}")
                yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(RECORD))

    return named.mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write a record per page and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    ``pages`` has ``page_id``, ``url`` and ``html``; other columns are ignored. Null pages have an
    empty payload; repeated rows get a record each, and rows equal in id, url and payload are all responses if they come first.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    root = scratch_path(spark, "warc")
    manifest = materialize(write_archives(assign_types(pages, min_payload), root, train_dictionary(pages)), "manifest")
    if not manifest.take(1):
        return spark.createDataFrame([], RECORD).drop("url", "block_bytes")
    return read_archives(spark, root, manifest).drop("url", "block_bytes")
