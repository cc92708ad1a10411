"""Media columns: lossless 8-bit grey PNG in binary columns, read back with checksum tests, and cosine hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_slices, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
FILTERS = {"none": 0, "sub": 1, "up": 2, "average": 3, "paeth": 4}
WIDTH = 64
#: The hash: a GRID x GRID thumbnail, whose LOW x LOW lowest frequencies give one bit each.
GRID, LOW = 32, 8


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_encode(samples: np.ndarray, row_filter: str = "none", level: int = 6) -> bytes:
    """A (height, width) array of uint8 as a grey PNG. The filter "least" is, row by row, sub or up: the one whose
    differences have the smaller absolute sum, sub if both have the same."""
    height, width = samples.shape
    left = np.zeros_like(samples)
    left[:, 1:] = samples[:, :-1]
    up = np.zeros_like(samples)
    up[1:] = samples[:-1]
    kinds: np.ndarray | int
    if row_filter == "least":
        by_left, by_up = samples - left, samples - up
        cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (by_left, by_up)]
        kinds = np.where(cost[1] < cost[0], FILTERS["up"], FILTERS["sub"]).astype(np.uint8)
        body = np.where((kinds == FILTERS["up"])[:, None], by_up, by_left)
    else:
        kinds = FILTERS[row_filter]
        if kinds == 0:
            body = samples
        elif kinds < 3:
            body = samples - (left if kinds == 1 else up)
        elif kinds == 3:
            body = samples - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
        else:
            corner = np.zeros_like(samples)
            corner[1:, 1:] = samples[:-1, :-1]
            body = samples - _paeth(left, up, corner)
    rows = np.empty((height, width + 1), dtype=np.uint8)
    rows[:, 0] = kinds
    rows[:, 1:] = body
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Undoes the row filters; runs of rows with one filter are undone together, those of two neighbours by diagonals."""
    if not kinds.any():
        return body
    if kinds.max() > 4:
        raise ValueError("unknown row filter")
    out = np.zeros((body.shape[0] + 1, body.shape[1] + 1), dtype=np.uint8)  # a zero row above, a zero column before
    y, n = 0, len(kinds)
    while y < n:
        kind, end = kinds[y], y + 1
        while end < n and kinds[end] == kind:
            end += 1
        part = body[y:end]
        if kind == 0:
            out[y + 1 : end + 1, 1:] = part
        elif kind == 1:
            out[y + 1 : end + 1, 1:] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            out[y + 1 : end + 1, 1:] = np.cumsum(np.vstack([out[y : y + 1, 1:], part]), axis=0, dtype=np.uint8)[1:]
        else:
            height, width = part.shape
            for d in range(height + width - 1):  # a sample needs those of the two diagonals before
                r = np.arange(max(0, d - width + 1), min(height, d + 1))
                x = d - r
                a, b, c = out[y + r + 1, x], out[y + r, x + 1], out[y + r, x]
                guess = ((a.astype(np.uint16) + b) >> 1).astype(np.uint8) if kind == 3 else _paeth(a, b, c)
                out[y + r + 1, x + 1] = part[r, x] + guess
        y = end
    return out[1:, 1:]


def png_decode(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG without interlacing. ValueError on a wrong checksum or a damaged file."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("truncated chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(part) < n or len(data) < at + 12 + n or zlib.crc32(part, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"wrong checksum in chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + n
    if not head or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("damaged file or another kind of image")
    width, height = head[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    if rows.size != height * (width + 1):
        raise ValueError("wrong number of samples")
    rows = rows.reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(GRID)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * GRID))


def _thumb(a: np.ndarray, n: int) -> np.ndarray:
    """n rows: means of equal shares of the rows, or repeats where there are fewer."""
    h = len(a)
    if h <= n:
        return a[np.arange(n) * h // n].astype(float)
    edges = np.arange(n + 1) * h // n
    return np.add.reduceat(a, edges[:-1], axis=0, dtype=float) / np.diff(edges)[:, None]


def cosine_hash(samples: np.ndarray, cosines: np.ndarray | None = None) -> str:
    """16 hex digits: which of the lowest frequencies of a thumbnail lie above their median (the constant one aside)."""
    c = _cosines() if cosines is None else cosines
    low = (c @ _thumb(_thumb(samples, GRID).T, GRID).T @ c.T).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def to_media(df: DataFrame, payload: str = "payload", media: str = "media", width: int = WIDTH, row_filter: str = "none") -> DataFrame:
    """Replaces the binary column `payload` by the binary column `media` that holds it as a PNG `width` samples wide.

    A payload must be whole rows: ValueError if its length isn't a positive multiple of width. Null stays
    null. Other columns stay, except that one that is already named like `media` is replaced.
    """
    keep = [f for f in df.schema.fields if f.name not in (payload, media)]
    schema = T.StructType([*keep, T.StructField(media, T.BinaryType())])

    def start():
        def one(data: bytes | None) -> bytes | None:
            if data is None:
                return None
            if not data or len(data) % width:
                raise ValueError(f"a payload must be a positive multiple of {width} bytes")
            return png_encode(np.frombuffer(data, dtype=np.uint8).reshape(-1, width), row_filter)

        return lambda rows: {f.name: rows[f.name] for f in keep} | {media: [one(x) for x in rows[payload]]}

    return map_slices(df.select(*[F.col(f"`{f.name}`") for f in keep], payload), start, schema)


READ = (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))


def read_media(df: DataFrame, media: str = "media", tail: int = WIDTH, keep_payload: bool = False) -> DataFrame:
    """Reads the stored bytes back and adds what they hold, checksums tested; `media` goes.

    Adds payload_bytes, payload_sha256, tail_crc32 (of the last `tail` bytes), media_bytes, media_sha256 and
    feature (a cosine hash), and with keep_payload the column payload. A damaged file raises ValueError; null
    gives nulls. Columns of df with these names are replaced.
    """
    added = dict(READ) | ({"payload": T.BinaryType()} if keep_payload else {})
    keep = [f for f in df.schema.fields if f.name != media and f.name not in added]
    schema = T.StructType([*keep, *[T.StructField(k, v) for k, v in added.items()]])

    def start():
        cosines = _cosines()

        def one(data: bytes | None) -> tuple:
            if data is None:
                return (None,) * len(added)
            samples = png_decode(data)
            own = samples.tobytes()
            row = (len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-tail:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples, cosines))
            return row + ((own,) if keep_payload else ())

        def f(rows: dict) -> dict:
            got = [one(x) for x in rows[media]]
            return {f.name: rows[f.name] for f in keep} | {k: [g[i] for g in got] for i, k in enumerate(added)}

        return f

    return map_slices(df.select(*[F.col(f"`{f.name}`") for f in keep], media), start, schema)


def payloads(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes and payload: the UTF-8 bytes of the whole text (null: empty), zeros up to a positive multiple of width."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.length(data)
    total = F.greatest(F.ceil(n / width), F.lit(1)) * width
    pad = F.expr("cast(repeat('\\0', cast(__pad as int)) as binary)")
    rows = docs.select("doc_id", n.cast("bigint").alias("n_bytes"), data.alias("__data"), (total - n).alias("__pad"))
    return rows.select("doc_id", "n_bytes", F.concat("__data", pad).alias("payload"))


def op3_png_media_columns(spark, sf_dir: str) -> DataFrame:
    return read_media(to_media(payloads(table(spark, sf_dir, "documents")), row_filter="least"))
