"""AVI files made from vectors, for the media operator's query and tests.

There is no table of media. A vector gives a film of a few shots: the number of shots, their lengths,
levels and colours follow from the id and the vector by the rules below, which SQL can repeat.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecspark.llm.media import DCT, ZIGZAG, codes, standard_tables
from vecspark.plans.session import prepare

SIDE = 32
#: Microseconds for a frame, by the id.
MICROS = (40_000, 100_000, 200_000)
#: Shortest shot, and how many lengths there are.
SHORTEST, LENGTHS, SHOTS = 5, 6, 4
QUANT = np.maximum(1, np.arange(64) // 4 + 6)
_ENCODE: dict[int, dict[int, str]] = {k: {s: format(c, f"0{n}b") for c, n, s in codes(*t)} for k, t in standard_tables().items()}


def plan(media_id: int, vector: np.ndarray) -> list[int]:
    """Frames of each shot."""
    return [SHORTEST + int(np.floor(abs(float(vector[i])) * 100)) % LENGTHS for i in range(1 + media_id % SHOTS)]


def _bits(size: int, value: int) -> str:
    return format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def encode_jpegs(planes: list[np.ndarray], tables: bool = False) -> list[bytes]:
    """Baseline JPEGs of frames; ``planes`` are Y and, of half size, Cb and Cr, each (frames, height, width)."""
    n, h, w = planes[0].shape
    order = []
    for c, p in enumerate(planes):
        cells = p.reshape(n, p.shape[1] // 8, 8, p.shape[2] // 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, p.shape[1] // 8, p.shape[2] // 8, 64)
        freq = np.rint((cells - 128.0) @ DCT.T)[..., ZIGZAG]
        whole = np.rint(freq / QUANT).astype(np.int64)
        blocks = [[] for _ in range(whole.size // 64)]
        for i, k, x in zip(*(a.tolist() for a in np.nonzero(whole.reshape(-1, 64)[:, 1:])), whole.reshape(-1, 64)[:, 1:][whole.reshape(-1, 64)[:, 1:] != 0].tolist(), strict=True):
            blocks[i].append((k, x))
        order.append((whole[..., 0].tolist(), blocks, whole.shape[1] * whole.shape[2], whole.shape[2]))
    head = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes(QUANT.tolist())
    if tables:
        for k, (counts, symbols) in standard_tables().items():
            head += b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols), k) + counts + symbols
    size = 2 if len(planes) == 3 else 1
    head += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(planes), 8, h, w, len(planes)) + b"".join(bytes([c + 1, (size * 17) if c == 0 else 17, 0]) for c in range(len(planes)))
    head += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(planes), len(planes)) + b"".join(bytes([c + 1, 0x00 if c == 0 else 0x11]) for c in range(len(planes))) + b"\x00\x3f\x00"
    out = []
    for f in range(n):
        said, last = [], [0] * len(planes)
        for y in range(h // (8 * size)):
            for x in range(w // (8 * size)):
                for c in range(len(planes)):
                    s = size if c == 0 else 1
                    for dy in range(s):
                        for dx in range(s):
                            first, blocks, each, wide = order[c]
                            level = first[f][y * s + dy][x * s + dx]
                            table = min(c, 1)
                            diff, last[c] = level - last[c], level
                            k = abs(diff).bit_length()
                            said.append(_ENCODE[table][k] + _bits(k, diff))
                            ac, at = _ENCODE[0x10 | table], 0
                            for i, v in blocks[f * each + (y * s + dy) * wide + x * s + dx]:
                                run, at = i - at, i + 1
                                while run > 15:
                                    said.append(ac[0xF0])
                                    run -= 16
                                k = abs(v).bit_length()
                                said.append(ac[run << 4 | k] + _bits(k, v))
                            if at < 63:
                                said.append(ac[0])
        text = "".join(said)
        text += "1" * (-len(text) % 8)
        out.append(head + int("1" + text, 2).to_bytes(len(text) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], micros: int, side: int = SIDE, index: bool = True) -> bytes:
    avih = struct.pack("<14I", micros, 0, 0, 0x10, len(frames), 0, 1, 0, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, micros, 1_000_000, 0, len(frames), 0, 0, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body, entries = b"movi", b""
    for f in frames:
        entries += struct.pack("<4sIII", b"00dc", 0x10, len(body), len(f))
        body += _chunk(b"00dc", f)
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", body) + (_chunk(b"idx1", entries) if index else b""))


def film(media_id: int, vector: np.ndarray) -> bytes:
    """The film of a vector: in each shot a level and a colour, a moving square, and light that drifts."""
    lengths = plan(media_id, vector)
    n = sum(lengths)
    y = np.zeros((n, SIDE, SIDE))
    cb, cr = np.zeros((n, SIDE // 2, SIDE // 2)), np.zeros((n, SIDE // 2, SIDE // 2))
    at = 0
    for shot, length in enumerate(lengths):
        level = 40 + (media_id + 3 * shot) % 5 * 40
        for i in range(length):
            y[at] = level + i % 2
            px = (i * 2 + media_id) % (SIDE - 8)
            y[at, 8:16, px : px + 8] += 20
            cb[at], cr[at] = 100 + (media_id + shot) % 3 * 24, 100 + shot % 2 * 40
            at += 1
    return avi(encode_jpegs([y, cb, cr]), MICROS[media_id % len(MICROS)])


def films(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (``media_id``, ``media``): the film of every row of ``df``."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column("id").to_pylist()
                media = [film(i, np.array(v.as_py())) for i, v in zip(ids, part.column("v"), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(media, pa.binary())], names=["media_id", "media"])

    return df.select(df[id_col].alias("id"), df[vector_col].alias("v")).mapInArrow(run, "media_id long, media binary")


#: The clips of the films, from the rules alone.
CLIPS_SQL = f"""
WITH s AS (SELECT vec_id, embedding, unnest(range(1 + vec_id % {SHOTS})) AS shot FROM embeddings),
n AS (SELECT vec_id, shot, {SHORTEST} + floor(abs(embedding[shot + 1]::DOUBLE) * 100)::BIGINT % {LENGTHS} AS n, [{", ".join(map(str, MICROS))}][vec_id % {len(MICROS)} + 1] AS micros FROM s),
c AS (SELECT *, sum(n) OVER (PARTITION BY vec_id ORDER BY shot) - n AS first FROM n)
SELECT vec_id AS media_id, shot::INTEGER AS clip, first::INTEGER AS first_frame, n::INTEGER AS n_frames, (first * micros // 1000)::BIGINT AS start_ms, ((first + n) * micros // 1000)::BIGINT AS end_ms, 0 AS bad_frames, NULL::VARCHAR AS error FROM c"""
