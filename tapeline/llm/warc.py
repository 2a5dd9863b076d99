"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with the seek table of the seekable
format (a skippable frame of frame sizes), so one frame can be read without the others. The
index maps each record to its bundle, frame and place in the frame. Tasks write their bundles
under names of their own, straight to the shared folder; only the index that Spark commits says
which bundles count, so what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.common import query, table
from tapeline.session import materialize, shared_dir

LEAST_REVISIT_BYTES = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1


def record_id(page_id, digest: str) -> str:
    """Names a page and its payload; only equal payloads of one page share a name."""
    return f"<urn:page:{'' if page_id is None else page_id}:sha1:{digest}>"


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has no block; control characters of the URL are escaped."""
    block = b"" if kind == "revisit" else payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, where the next record starts) of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines)
    start = end + 4
    stop = start + int(head["Content-Length"])
    return head, data[start:stop], stop + 4


class Bundle:
    """Frames in memory; ``close`` gives the whole file."""

    def __init__(self):
        self.out, self.sizes, self.open, self.bytes = [], [], [], 0
        self.frame_bytes, self.compressor = 0, zstandard.ZstdCompressor(level=LEVEL)

    def add(self, rec: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        place = len(self.sizes), self.frame_bytes
        self.open.append(rec)
        self.frame_bytes += len(rec)
        if self.frame_bytes >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.open:
            packed = self.compressor.compress(b"".join(self.open))
            self.out.append(packed)
            self.sizes.append((len(packed), self.frame_bytes))
            self.bytes += len(packed)
            self.open, self.frame_bytes = [], 0

    def close(self) -> bytes:
        self.flush()
        sizes = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join([*self.out, struct.pack("<II", SKIPPABLE_MAGIC, len(sizes)), sizes])


def seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset in the file, compressed size, size) of every frame, from the end of the file."""
    f.seek(size - 9)
    frames, descriptor, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entry = 12 if descriptor & 0x80 else 8
    f.seek(size - 9 - entry * frames)
    raw, at, out = f.read(entry * frames), 0, []
    for k in range(frames):
        packed, whole = struct.unpack_from("<II", raw, k * entry)
        out.append((at, packed, whole))
        at += packed
    return out


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme of the file system that Spark would use for it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write bundles of (page_id, url, html, kind, digest, refers_to) rows; the index, stored."""
    folder = qualified(records.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        bundle, rows = Bundle(), []

        def done() -> pa.RecordBatch:
            nonlocal bundle, rows
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = bundle.close()
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            out = pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *[pa.array(c, pa.int64()) for c in zip(*rows)]],
                                             names=["bundle", "page_id", "frame", "frame_offset"])
            bundle, rows = Bundle(), []
            return out

        for b in batches:
            for page_id, url, html, kind, digest, refers_to in zip(*[c.to_pylist() for c in b.columns]):
                rows.append((page_id, *bundle.add(record(kind, page_id, url, (html or "").encode(), digest, refers_to))))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield done()
        if rows:
            yield done()

    return materialize(records.select("page_id", "url", "html", "kind", "digest", "refers_to").mapInArrow(
        run, "bundle string, page_id long, frame long, frame_offset long"), "warc-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, kind, refers_to, payload_bytes, payload_digest) of every record that ``index`` lists.

    Each frame that holds a listed record is sought by the bundle's footer and read once. Sizes
    and digests of responses come from the blocks found there; a revisit has no size, and the
    digest of its header. Bundles are dealt to as many tasks as there are bundles.
    """
    folder = qualified(index.sparkSession, folder)
    bundles = max(1, index.agg(F.count_distinct("bundle")).first()[0])
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("frame_offset")).alias("places"))

    def number(urn: str) -> int | None:
        text = urn.removeprefix("<urn:page:").split(":")[0]
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        decompressor, name, f, tables = zstandard.ZstdDecompressor(), None, None, []
        for b in batches:
            out = []
            for bundle, frame, places in zip(*[c.to_pylist() for c in b.columns]):
                if bundle != name:
                    name, f = bundle, fs.open_input_file(f"{root}/{bundle}")
                    tables = seek_table(f, f.size())
                at, packed, whole = tables[frame]
                f.seek(at)
                data = decompressor.decompress(f.read(packed), max_output_size=whole)
                for place in places:
                    head, block, _ = parse(data, place)
                    revisit = head["WARC-Type"] == "revisit"
                    out.append((number(head["WARC-Record-ID"]), head["WARC-Type"], number(head["WARC-Refers-To"]) if revisit else None,
                                None if revisit else len(block), head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(block).hexdigest()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            cols = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "kind", "refers_to", "payload_bytes", "payload_digest"])

    return frames.repartition(bundles, "bundle").sortWithinPartitions("bundle", "frame").mapInArrow(
        run, "page_id long, kind string, refers_to long, payload_bytes long, payload_digest string")


def archive(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all ``pages`` to bundles under ``folder``; the index of them.

    The payload is the html in UTF-8 (null: empty). Of pages whose payloads of at least
    ``LEAST_REVISIT_BYTES`` are equal, the one with the largest id is stored and the others
    revisit it. Rows that repeat that id are stored too; rows without an id are always stored.
    Null URLs have no target header; empty tables give an empty index; other columns aren't read.
    """
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = rows.withColumns({"digest": F.sha1(payload), "bytes": F.length(payload)})
    keys = rows.where(F.col("bytes") >= LEAST_REVISIT_BYTES).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    keys = materialize(keys, "warc-copies")  # stored, so that a payload of many pages can be split in the join
    marked = rows.join(keys, ["digest", "bytes"], "left")
    revisit = (F.col("page_id") < F.col("first")) & F.col("first").isNotNull()
    return write(marked.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("kind"), "digest",
                               F.when(revisit, F.col("first")).alias("refers_to")), folder)


def report(index: DataFrame, folder: str, id: str = "page_id") -> DataFrame:
    """Read the bundles back: id, payload_bytes, payload_digest, record_type, refers_to.

    The size of a revisit is that of the response it refers to: of the stored record with that id
    and the revisit's own digest, so ids may repeat with other payloads.
    """
    found = materialize(read(index, folder), "warc-records")
    stored = materialize(found.where("kind = 'response' and page_id is not null").select(
        F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct(), "warc-responses")
    revisits = found.where("kind = 'revisit'").drop("payload_bytes").join(stored, ["refers_to", "payload_digest"])
    columns = ["page_id", "payload_bytes", "payload_digest", "kind", "refers_to"]
    return found.where("kind = 'response'").select(*columns).unionByName(revisits.select(*columns)).select(
        F.col("page_id").alias(id), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


@query("op7_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes, sha1(t) AS payload_digest,
       CASE WHEN payload_bytes >= {LEAST_REVISIT_BYTES} AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_REVISIT_BYTES} AND page_id < first THEN first END AS refers_to FROM f""")
def _op7(spark, sf_dir):
    folder = shared_dir(spark, "warc")
    return report(archive(table(spark, sf_dir, "pages"), folder), folder)
