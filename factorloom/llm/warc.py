"""WARC archives as seekable Zstandard bundles."""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import new_path, saved, slices

#: The seekable format's footer: a skippable frame with a table of frames. Fixed values of the format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload, only its digest and length."""
    body = HTTP + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(block: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, body and end of the record at an offset of a frame."""
    end = block.index(b"\r\n\r\n", at)
    lines = block[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    if block[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} does not end where it should")
    return head, block[start:stop], stop + 4


class Bundle:
    """Writes records into independent frames, then the table of frames."""

    def __init__(self, out, frame_bytes: int, level: int = 3):
        import zstandard

        self.out, self.frame_bytes, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.held, self.length, self.frames, self.at = [], 0, [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in the frame's content) of the record."""
        if self.held and self.length + len(data) > self.frame_bytes:
            self.flush()
        where = (len(self.frames), self.length)
        self.held.append(data)
        self.length += len(data)
        return where

    def flush(self) -> None:
        if self.held:
            packed = self.zstd.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.length))
            self.held, self.length = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(start, packed, unpacked) of each frame, from the footer alone."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    flat = struct.unpack(f"<{2 * n}I", f.read(8 * n))
    out, at = [], 0
    for packed, full in zip(flat[::2], flat[1::2], strict=True):
        out.append((at, packed, full))
        at += packed
    return out


def frame(f, where: tuple[int, int, int]) -> bytes:
    import zstandard

    f.seek(where[0])
    return zstandard.ZstdDecompressor().decompress(f.read(where[1]), max_output_size=max(1, where[2]))


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """``(id, url, html, payload_bytes, payload_digest, record_type, refers_to)``: who is a response and who revisits whom.

    The smallest id of each digest is summed up before any shuffle, so a page with very many
    copies costs one row a task, and its copies stay where they are: frequent digests, of a bounded number, are joined by a
    broadcast, so html of a hot page is not gathered in one task.
    """
    text = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    data = F.encode(text, "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), text.alias("html"), F.octet_length(data).cast("long").alias("payload_bytes"), F.sha2(data, 256).alias("payload_digest"))
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = saved(first, "warc-copies")
    often = F.col("copies") * 2000 > F.lit(first.agg(F.sum("copies")).first()[0] or 0)  # true of fewer than 2000 digests
    known = F.broadcast(first.where(often).select("payload_digest", F.col("first").alias("known")))
    # html of pages with a frequent digest need not be dealt by it: their join key is one that nothing equals
    rows = rows.join(known, "payload_digest", "left").withColumn("other", F.when(F.col("known").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.col("id").cast("string"))))
    rows = rows.join(first.where(~often).select(F.col("payload_digest").alias("other"), "first"), "other", "left").withColumn("first", F.coalesce("known", "first"))
    again = F.coalesce(F.col("first") != F.col("id"), F.lit(False))
    return rows.select("id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_bundles(records: DataFrame, folder: str, *, bundle_bytes: int = 64 << 20, frame_bytes: int = 1 << 20) -> DataFrame:
    """Writes ``plan_records`` rows as ``*.warc.zst`` files; the saved index ``(id, bundle, frame, start, length)``.

    A task streams its rows into bundles and holds one frame.  A bundle's name is new at
    each attempt and only the index of attempts that succeed counts, so a lost executor or a second attempt
    leaves at most a file that nothing points to.
    """
    kind = dict(records.dtypes)["id"]

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out = bundle = name = None
        for whole in batches:
            for batch in slices(whole, "html"):
                index = []
                for r in batch.to_pylist():
                    if bundle is None:
                        name = f"{root}/{uuid.uuid4().hex}.warc.zst"
                        out = fs.open_output_stream(name, compression=None)  # else the suffix has it packed twice
                        bundle = Bundle(out, frame_bytes)
                    data = record(r["record_type"], r["id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["payload_digest"], r["refers_to"])
                    index.append((r["id"], name.rsplit("/", 1)[1], *bundle.add(data), len(data)))
                    if out.tell() >= bundle_bytes:
                        bundle.close()
                        out.close()
                        bundle = None
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in index], batch.schema.field("id").type), *[pa.array([x[i] for x in index], t) for i, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()))]], names=["id", "bundle", "frame", "start", "length"])
        if bundle is not None:
            bundle.close()
            out.close()

    return saved(records.mapInArrow(write, f"id {kind}, bundle string, frame long, start long, length long"), "warc-index")


def read_bundles(index: DataFrame, folder: str, *, task_bytes: int = 16 << 20) -> DataFrame:
    """``(id, payload_bytes, payload_digest, record_type, refers_to)`` of the indexed records, each read by a seek to its frame.

    Each task reads some of the frames, in whole, about ``task_bytes`` of records; the footer gives a frame's place and the index a record's.
    A response's digest is computed from the bytes that come back and compared with the one written.
    """
    kind = dict(index.dtypes)["id"]
    # dealt by what the tasks have to read, not by the size of the index
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // task_bytes))
    frames = index.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "start")

    def fetch(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        f, at, name, block = None, None, None, b""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["bundle"] != name:
                    if f is not None:
                        f.close()
                    name, path = r["bundle"], f"{root}/{r['bundle']}"
                    f = fs.open_input_file(path)
                    table, at = seek_table(f, f.size()), None
                if at != (name, r["frame"]):
                    at, block = (name, r["frame"]), frame(f, table[r["frame"]])
                head, body, stop = parsed(block, r["start"])
                if stop - r["start"] != r["length"] or head["WARC-Record-ID"] != record_id(r["id"]):
                    raise ValueError(f"another record than {r['id']} at {r['frame']}:{r['start']} of {name}")
                digest, n = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                if head["WARC-Type"] == "response":
                    payload = body[len(HTTP) :]
                    if hashlib.sha256(payload).hexdigest() != digest or len(payload) != n:
                        raise ValueError(f"record {r['id']} came back changed")
                refers = head.get("WARC-Refers-To")
                rows.append((r["id"], n, digest, head["WARC-Type"], refers and refers.removeprefix("<urn:page:").removesuffix(">")))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], batch.schema.field("id").type), *[pa.array([x[i] for x in rows], t) for i, t in ((1, pa.int64()), (2, pa.string()), (3, pa.string()), (4, pa.string()))]], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if f is not None:
            f.close()

    back = frames.mapInArrow(fetch, f"id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return back.withColumn("refers_to", F.col("refers_to").cast(kind))


def archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes every page as a WARC record and reads all back: (the records read, the index).

    ``folder`` is a URI that executors can write; a new one in the shared folder if None.
    Payloads of at least ``least`` bytes that are alike share one response, that of the smallest id; the
    others are revisits.  Null html is an empty payload, null url gives no target header, a null id is kept
    and never a response that others revisit; repeated ids with equal payloads are all responses;
    an empty table gives no records; other columns are ignored.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    index = write_bundles(plan_records(pages, id_col=id_col, url_col=url_col, html_col=html_col, least=least), folder)
    return read_bundles(index, folder).withColumnRenamed("id", id_col), index.withColumnRenamed("id", id_col)


