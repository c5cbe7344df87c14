"""Media columns: payloads in tar shards, addressed by content; rows that carry digest, offset and length.

Each task turns the bytes of its rows into 8-bit greyscale PNG images, 576 samples a line, and appends each content it has not
written yet to a tar shard in the shared folder. The index, a small table of what lies where, is kept there too; for each digest one place
is chosen, the same for all rows. Metadata columns are filled by range reads of the images' first 33 bytes; features
by reading whole images, once for each digest, shard by shard and in the order of offsets.

A shard's name is drawn anew by each attempt of a task, so a task that is run again never touches what another one wrote; the index
names finished shards only. Shards are read and written through ``pyarrow.fs``, so any store that it knows will do.

Defined results: a null payload is stored as an empty one (padding only); equal payloads have one stored form and equal values; an empty table
writes no shard; other columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint_root, cut, small_batches

LINE = 576  # samples a line, and the multiple to which payloads are padded
PAD = b"\xff"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # bytes of signature and IHDR
SHARD = 64 << 20


def padded(payload: bytes) -> bytes:
    """The payload with bytes 255 up to a positive multiple of ``LINE``."""
    lines = max(1, -(-len(payload) // LINE))
    return payload + PAD * (lines * LINE - len(payload))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes, level: int = 6) -> bytes:
    """8-bit greyscale, one line for each ``LINE`` samples."""
    height = len(samples) // LINE
    lines = np.zeros((height, LINE + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, LINE)
    ihdr = struct.pack(">IIBBBBB", LINE, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", ihdr) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first ``HEADER`` bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    """The samples of an image that ``to_png`` made."""
    width, height, _ = png_header(media[:HEADER])
    at, packed = 8, b""
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            packed += media[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def _tar_header(name: str, size: int) -> bytes:
    head = bytearray(512)
    for at, field in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(field)] = field
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Writer:
    """Tar shards of one attempt of a task."""

    def __init__(self, root: str):
        self.fs, self.path = _store(root)
        self.out, self.name, self.at = None, "", 0

    def put(self, digest: bytes, media: bytes) -> tuple[str, int]:
        """The shard, and the offset of the image in it."""
        if self.out is None:
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
        self.out.write(_tar_header(f"{digest.hex()}.png", len(media)))
        self.out.write(media)
        self.out.write(b"\0" * (-len(media) % 512))
        at = self.at + 512
        self.at = at + len(media) + (-len(media) % 512)
        name = self.name
        if self.at >= SHARD:
            self.close()
        return name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def write_shards(df: DataFrame, payload_col: str, key_col: str, root: str | None = None, level: int = 6) -> tuple[DataFrame, str]:
    """Store the payload (string or binary) of every row. Gives (key, digest, n_bytes, shard, offset, length) and the shards' folder.

    The digest is the SHA-256 of the padded payload. All rows of a digest name the same place, the first in order.
    """
    spark = df.sparkSession
    small_batches(spark)
    root = root or f"{checkpoint_root(spark).rstrip('/')}/media-{uuid.uuid4().hex}"
    root = root if "://" in root or not root.startswith("/") else f"file://{root}"
    root = root.replace("file:///", "file:/").replace("file:/", "file:///") if root.startswith("file:") else root
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    kind = dict(df.select(F.col(key_col).alias("key")).dtypes)["key"]

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, places = _Writer(root), {}
        for pdf in batches:
            rows = []
            for payload in pdf["payload"]:
                raw = payload.encode() if isinstance(payload, str) else bytes(payload) if isinstance(payload, (bytes, bytearray)) else b""
                whole = padded(raw)
                digest = hashlib.sha256(whole).digest()
                if digest not in places:
                    media = to_png(whole, level)
                    places[digest] = (*writer.put(digest, media), len(media))
                rows.append((digest, len(raw), *places[digest]))
            got = pd.DataFrame(rows, columns=["digest", "n_bytes", "shard", "offset", "length"])
            got.insert(0, "key", pdf["key"].array)
            yield got
        writer.close()

    rows = df.select(F.col(key_col).alias("key"), F.col(payload_col).alias("payload"))
    index = cut(rows.mapInPandas(store, f"key {kind}, digest binary, n_bytes long, shard string, offset long, length long"))
    places = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return index.select("key", "digest", "n_bytes").join(places, "digest").select("key", "digest", "n_bytes", "at.*"), root


def _read(root: str, pdf: pd.DataFrame, length) -> Iterator[bytes]:
    store, path = _store(root)
    file, name = None, None
    for shard, offset, n in zip(pdf["shard"], pdf["offset"], pdf["length"], strict=True):
        if shard != name:
            if file is not None:
                file.close()
            file, name = store.open_input_file(f"{path}/{shard}"), shard
        yield file.read_at(int(length(n)), int(offset))
    if file is not None:
        file.close()


def metadata(places: DataFrame, root: str) -> DataFrame:
    """places(digest, shard, offset, length) to (digest, width, height, bits): range reads of the headers only."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heads = [png_header(h) for h in _read(root, pdf, lambda n: HEADER)]
            yield pd.DataFrame({"digest": pdf["digest"].array, **{c: [h[i] for h in heads] for i, c in enumerate(("width", "height", "bits"))}})

    return places.mapInPandas(read, "digest binary, width long, height long, bits long")


def features(samples: bytes) -> str:
    """Size, mean, deviation, entropy and the shares of 8 tones, of the samples."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    p = count[count > 0] / len(x)
    tones = count.reshape(8, 32).sum(axis=1)
    mean = float((count * np.arange(256)).sum() / len(x))
    var = float((count * (np.arange(256) - mean) ** 2).sum() / len(x))
    return f"{LINE}x{len(x) // LINE};mean={mean:.4f};std={var ** 0.5:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};tones=" + ",".join(map(str, tones))


def contents(places: DataFrame, root: str) -> DataFrame:
    """places to what the stored bytes, read back, say: digests, sizes and features."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for media in _read(root, pdf, lambda n: n):
                samples = from_png(media)
                rows.append((len(samples), hashlib.sha256(samples).digest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).digest(), features(samples)))
            got = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            got.insert(0, "digest", pdf["digest"].array)
            yield got

    return places.mapInPandas(read, "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string")


def media_columns(df: DataFrame, payload_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """Store, then read back: (key, n_bytes, digest, shard, offset, length, width, height, bits, payload_bytes, payload_sha256, ...)."""
    index, root = write_shards(df, payload_col, key_col)
    places = index.select("digest", "shard", "offset", "length").distinct().repartition("shard").sortWithinPartitions("shard", "offset")
    known = metadata(places, root).join(contents(places, root), "digest")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    rest = (text(c) if c.endswith("sha256") else F.col(c) for c in known.columns if c != "digest")
    return index.join(known, "digest").select("key", "n_bytes", text("digest"), "shard", "offset", "length", *rest)
