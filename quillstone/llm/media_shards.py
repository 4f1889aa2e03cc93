"""Payloads as content-addressed media in tar shards.

A text's UTF-8 bytes, padded by spaces to a positive multiple of 192, become an 8-bit grey PNG of width 192.
Each task writes tar shards of bounded size into the shared folder; a member's name is the SHA-256 of its bytes, and a
shard holds one member per digest. Rows carry digest, shard, offset and length. Metadata columns come from range reads
of the first 33 bytes of a member; features from the decoded samples.
Null is an empty text, and an empty one a row of spaces; a very long text is one member. Ties and repeated rows have equal values and
share a member where one task writes them into one shard (a text that several tasks meet is stored by each). An empty table gives
no shards and an empty result. Extra columns are not read, whatever their names. The shards are the operator's output and stay.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, fs_of, materialize, put_file, scratch

WIDTH = 192
#: Bytes of members after which a task begins its next shard.
SHARD_BYTES = 32 << 20
#: Signature, IHDR chunk: what a header-only read takes.
HEADER_BYTES = 33
ZLIB_LEVEL = 6
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(unpadded bytes, padded payload)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def encode_png(payload: bytes) -> bytes:
    """Lossless grey PNG, one payload byte per sample."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), ZLIB_LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from a member's first bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG member")
    return struct.unpack(">IIB", head[16:25])


def decode_png(data: bytes) -> np.ndarray:
    """Samples of a member, with its checksums verified."""
    width, height, _ = read_header(data)
    at, packed = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk of a member is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    return lines[:, 1:]


def features(samples: np.ndarray) -> str:
    """Size, mean, deviation and entropy of the samples, in thousandths."""
    n = samples.size
    counts = np.bincount(samples.reshape(-1), minlength=256).astype(float)
    values = np.arange(256)
    mean = float((counts * values).sum() / n)
    spread = float(np.sqrt(max(0.0, (counts * (values - mean) ** 2).sum() / n)))
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    return f"{samples.shape[1]}x{samples.shape[0]}:{round(mean * 1000)}:{round(spread * 1000)}:{round(entropy * 1000)}"


def _writer(folder: str):
    def write(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        members: dict[str, tuple[int, int]] = {}
        held: list[bytes] = []
        size, waiting = 0, []

        def end():
            nonlocal number, size, members, held, waiting
            if held:
                put_file(f"{folder}/shard-{part:06d}-{number:04d}.tar", [*held, b"\0" * 1024])
            done = pd.DataFrame(waiting, columns=["__id", "n_bytes", "digest", "shard", "offset", "length"])
            number, size, members, held, waiting = number + 1, 0, {}, [], []
            return done

        for pdf in rows:
            for key, text in zip(pdf["__id"], pdf["text"], strict=True):
                n, payload = payload_of(text)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in members:
                    png = encode_png(payload)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(png)
                    head = info.tobuf(tarfile.PAX_FORMAT)
                    held += [head, png, b"\0" * (-len(png) % 512)]
                    members[digest] = size + len(head), len(png)
                    size += len(head) + len(png) + -len(png) % 512
                waiting.append((key, n, digest, f"shard-{part:06d}-{number:04d}.tar", *members[digest]))
                if size >= SHARD_BYTES:
                    yield end()
        yield end()

    return write


def _reader(folder: str):
    def read(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = fs_of(folder)
        name, handle, last, seen = None, None, None, None
        for pdf in rows:
            out = []
            for shard, offset, length in zip(pdf["shard"], pdf["offset"], pdf["length"], strict=True):
                if shard != name:
                    name, handle, last = shard, fs.open_input_file(f"{root}/{shard}"), None
                if last != offset:  # rows come in order of shard and offset: copies share one read
                    handle.seek(offset)
                    head = handle.read(HEADER_BYTES)
                    data = head + handle.read(length - HEADER_BYTES)
                    samples = decode_png(data)
                    payload = samples.tobytes()
                    seen = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(samples))
                    last = offset
                out.append(seen)
            yield pd.concat([pdf, pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], index=pdf.index)], axis=1)

    return read


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text's payload below folder; index rows: id, n_bytes, digest, shard, offset, length. Map-only."""
    batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    index = rows.mapInPandas(_writer(folder), f"__id {kind}, n_bytes long, digest string, shard string, offset long, length long")
    return materialize(index, "media-index")


def read_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index rows with width, height and bit depth of each one's member, from header-only range reads."""

    def read(rows):
        fs, root = fs_of(folder)
        name, handle = None, None
        for pdf in rows:
            out = []
            for shard, offset in zip(pdf["shard"], pdf["offset"], strict=True):
                if shard != name:
                    name, handle = shard, fs.open_input_file(f"{root}/{shard}")
                handle.seek(offset)
                out.append(read_header(handle.read(HEADER_BYTES)))
            yield pd.concat([pdf, pd.DataFrame(out, columns=["width", "height", "bit_depth"], index=pdf.index)], axis=1)

    return _by_shard(index).mapInPandas(read, f"{_columns(index)}, width long, height long, bit_depth int")


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _by_shard(index: DataFrame) -> DataFrame:
    """Rows of one shard together; as many parts as there are shards, so that none is sized by the small index."""
    shards = max(1, index.select("shard").distinct().count())
    return index.repartition(shards, "shard").sortWithinPartitions("shard", "offset")


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: where its member is (digest, shard, offset, length), its header's metadata, sizes, digests and features of what was read back."""
    folder = folder or scratch(docs.sparkSession, "media")
    index = read_metadata(write_shards(docs, folder, id_col, text_col), folder)
    out = index.mapInPandas(_reader(folder), f"{_columns(index)}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("__id", id_col)


def members_of(data: bytes) -> dict[str, bytes]:
    """Members of a shard by any tar reader, for tests."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar.getmembers()}
