"""WARC archives of pages under Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: payload digests are grouped (partial aggregates) to find each payload's largest page_id; that page is the
response, the others are revisits of it. Every partition becomes a folder of archives of about `archive_mb` each, written
under a temporary name and renamed as a whole, so a repeated task replaces its own. Reading: Spark's binary reader fetches
archives; each frame is decoded by itself with the archive's dictionary, and version line, header fields, block length,
digests and record end are checked. A bad record is a ValueError, never a skipped row.

Null html: an empty payload. Null ids: written without a number, a revisit wherever an equal payload has one. Repeated
rows: each is a record; rows that share the largest page_id are all responses. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import urllib.parse
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.shared import settle, shared_dir, table

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", urllib.parse.quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is None:
        block += payload
    else:
        fields[0] = ("WARC-Type", "revisit")
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    fields += [("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = 16 << 10) -> bytes:
    """Trained on at most the samples given; empty where they are too few or too small for the library."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes() if len(samples) > 8 else b""
    except zstandard.ZstdError:
        return b""


def parsed(data: bytes):
    """Rows of SCHEMA from one archive, one record decoded at a time; ValueError on anything malformed."""
    import zstandard

    try:
        yield from _decoded(data)
    except (zstandard.ZstdError, struct.error) as e:
        raise ValueError(f"a frame that cannot be decoded: {e}") from e


def _decoded(data: bytes):
    import zstandard

    view, at, words = memoryview(data), 0, None
    decoder = zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic == SKIPPABLE and words is None and at == 0:
            size = struct.unpack_from("<I", data, 4)[0]
            words = bytes(view[8 : 8 + size])
            if len(words) != size:
                raise ValueError("the dictionary frame is cut off")
            if int.from_bytes(words[:4], "little") == FRAME:
                words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
            at = 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at byte {at}")
        frame, out, step = decoder.decompressobj(), [], 4096
        while not frame.eof:
            chunk = view[at : at + step]
            if not len(chunk):
                raise ValueError("the last frame is cut off")
            out.append(frame.decompress(chunk))
            at += len(chunk) - (len(frame.unused_data) if frame.eof else 0)
            step = min(step * 2, 1 << 20)
        yield read_record(b"".join(out))


def read_record(raw: bytes) -> tuple:
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon or k.lower() in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[k.lower()] = v.strip()
    if missing := {"warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-block-digest", "content-length"} - fields.keys():
        raise ValueError(f"no header field {min(missing)}")
    if fields["warc-type"] not in ("response", "revisit") or fields["warc-type"] == "revisit" and not {"warc-profile", "warc-refers-to"} <= fields.keys():
        raise ValueError("not a response, nor a revisit with its profile and origin")
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("the block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if len(lengths) != 1:
        raise ValueError("not one length of the payload")
    length = lengths[0]
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    number = lambda x: int(n) if (n := x.rpartition(":")[2].rstrip(">")) else None
    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest) or kind == "revisit" and (payload or fields["warc-profile"] != PROFILE):
        raise ValueError("the payload is not what the header says")
    return number(fields["warc-record-id"]), length, digest, kind, number(fields["warc-refers-to"]) if kind == "revisit" else None, urllib.parse.unquote(fields["warc-target-uri"])


def placed(folder: str, name: str, files) -> int:
    """Write files (file name, its parts) to folder/name: first under a temporary name. Folders are local or shared paths, or URIs that Arrow opens."""
    from pyarrow.fs import FileSystem, FileType, LocalFileSystem

    if folder.startswith("file:") or "://" not in folder:
        fs, path = LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    else:
        fs, path = FileSystem.from_uri(folder)
    size, temporary = 0, f"{path}/.{name}.{uuid.uuid4().hex}"
    fs.create_dir(temporary)
    for file, parts in files:
        with fs.open_output_stream(f"{temporary}/{file}", compression=None) as f:  # else compressed by its name
            for p in parts:
                size += f.write(p)
    if fs.get_file_info(f"{path}/{name}").type != FileType.NotFound:  # of an attempt before
        fs.delete_dir(f"{path}/{name}")
    fs.move(temporary, f"{path}/{name}")
    return size


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3, archive_mb: float = 256, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes at once; gives one row for each folder of archives: name, records, bytes."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    tops = rows.groupBy("digest", "size").agg(F.max("page_id").alias("top"))
    same = (F.col("size") < min_bytes) | F.col("page_id").eqNullSafe(F.col("top"))
    marked = rows.join(tops, ["digest", "size"]).select("page_id", "url", "html", "digest", F.when(~same, F.col("top")).alias("refers_to"))

    def written(batches):
        import zstandard

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(5)))

        def archive(first: list):
            """The parts of one archive, up to its size; rows that are left stay in `left`."""
            words = dictionary([x[2].encode()[:4096] for x in first])
            size = 0
            if words:
                yield struct.pack("<II", SKIPPABLE, len(words)) + words
            encoder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
            for p, u, h, d, r in itertools.chain(first, left):
                frame = encoder.compress(record(p, u, h.encode(), base64.b32encode(bytes.fromhex(d)).decode(), r))
                yield frame
                count[0] += 1
                size += len(frame)
                if size >= archive_mb * 1e6 and count[0] >= taken[0]:
                    return

        def archives():
            while first := list(itertools.islice(left, 128)):
                taken[0] = count[0] + len(first)
                yield f"{len(made):05d}.warc.zst", archive(first)
                made.append(None)

        left, count, taken, made = rows(), [0], [0], []
        name = f"part-{TaskContext.get().partitionId():05d}"
        size = placed(folder, name, archives())
        yield pa.RecordBatch.from_pylist([{"name": name, "records": count[0], "bytes": size}])

    return settle(marked.mapInArrow(written, "name string, records long, bytes long"))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the *.warc.zst files in folder and the folders in it, in any store that Spark reads."""

    def records(batches):
        for batch in batches:
            rows_of = itertools.chain.from_iterable(parsed(data.as_py()) for data in batch.column(0))
            while rows := list(itertools.islice(rows_of, 1024)):
                columns = list(zip(*rows)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder)
    return files.select("content").mapInArrow(records, SCHEMA)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    back = settle(read_archives(spark, folder).drop("target_uri"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return back
