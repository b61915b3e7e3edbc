"""Operator 8: media columns. AVI files with motion-JPEG become rows of timed clips.

The RIFF tree gives the frame rate and, by its index or by walking the frame list, each frame's bytes.
Every frame is an intra frame: a baseline JPEG, decoded to its planes. Histograms of brightness and
colour are compared from frame to frame; a difference starts a new shot where it exceeds both a floor
and what is usual among the frames around it. A shot is a clip.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecspark.plans.session import prepare

#: A cut's histogram difference is at least this, of 1.
FLOOR = 0.25
#: ... and the median of the differences around it plus this many median deviations.
DEVIATIONS = 8.0
#: Differences on either side that tell what is usual.
AROUND = 12

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])


def _basis() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(c, c)


#: Rows: frequencies in raster order; columns: samples. Orthonormal.
DCT = _basis()
#: The same with frequencies in zigzag order.
ZIGZAG_DCT = DCT[ZIGZAG]


def standard_tables() -> dict[int, tuple[bytes, bytes]]:
    """The Huffman tables of ITU-T T.81, Annex K.3, which motion-JPEG frames may leave out, by class and id."""
    dc = bytes(range(12))
    ac_y = bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    )
    ac_c = bytes.fromhex(
        "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", "")
    )
    return {
        0x00: (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), dc),
        0x01: (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), dc),
        0x10: (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), ac_y),
        0x11: (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), ac_c),
    }


STANDARD = standard_tables()


def codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a Huffman table, in order."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[k]))
            code += 1
            k += 1
        code <<= 1
    return out


_LOOKUPS: dict[tuple[bytes, bytes], list[int]] = {}


def lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits the first code's length, times 256, plus its symbol; 0 where there is none."""
    key = (counts, symbols)
    if key not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        table = np.zeros(1 << 16, np.int64)
        for code, length, symbol in codes(counts, symbols):
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
        _LOOKUPS[key] = table.tolist()
    return _LOOKUPS[key]


class BadFrame(ValueError):
    """A frame that isn't a baseline JPEG."""


def _scan(data: bytes, plan: list[tuple[int, list[int], list[int]]], units: int, restart: int, components: int) -> tuple[list[int], list[int]]:
    """Entropy-decode ``units`` minimum coded units: 64 times the block's number plus the zigzag place, and the value, of each coefficient."""
    places, values = [], []
    block = 0
    parts = []
    at = 0
    while True:  # restart markers stand alone; a stuffed zero follows any other 0xff
        i = data.find(b"\xff", at)
        while i >= 0 and i + 1 < len(data) and data[i + 1] == 0:
            i = data.find(b"\xff", i + 2)
        if i < 0 or i + 1 >= len(data):
            parts.append(data[at:])
            break
        parts.append(data[at:i])
        if not 0xD0 <= data[i + 1] <= 0xD7:
            break
        at = i + 2
    done = 0
    for part in parts:
        raw = part.replace(b"\xff\x00", b"\xff")
        acc, held, pos, most = 0, 0, 0, len(raw)
        last = [0] * components
        for _ in range(min(restart or units, units - done)):
            for c, dc, ac in plan:
                k = 0
                while k < 64:
                    while held < 32:
                        acc = (acc << 32) | int.from_bytes(raw[pos : pos + 4].ljust(4, b"\xff"), "big")
                        pos += 4
                        held += 32
                        if pos > most + 64:
                            raise BadFrame("the frame ends too early")
                    said = (ac if k else dc)[(acc >> (held - 16)) & 0xFFFF]
                    if not said:
                        raise BadFrame("no such code")
                    held -= said >> 8
                    symbol = said & 0xFF
                    size = symbol & 15
                    if k:
                        run = symbol >> 4
                        if not size:
                            if run != 15:
                                break
                            k += 16
                            continue
                        k += run
                    if size:
                        held -= size
                        value = (acc >> held) & ((1 << size) - 1)
                        if not value >> (size - 1):
                            value -= (1 << size) - 1
                    else:
                        value = 0
                    acc &= (1 << held) - 1
                    if not k:
                        last[c] += value
                        value = last[c]
                    if k > 63:
                        raise BadFrame("a block is too long")
                    places.append(block + k)
                    values.append(value)
                    k += 1
                block += 64
            done += 1
    if done < units:
        raise BadFrame("the frame ends too early")
    return places, values


def decode_jpeg(data: bytes) -> list[np.ndarray]:
    """The planes of a baseline JPEG, cut to their sizes: one for grey, three for colour (Y, Cb, Cr)."""
    if data[:2] != b"\xff\xd8":
        raise BadFrame("no JPEG")
    quant: dict[int, np.ndarray] = {}
    tables = dict(STANDARD)
    frame, restart, at = None, 0, 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise BadFrame("no scan")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                n = 128 if wide else 64
                quant[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                i += 1 + n
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                tables[body[i]] = (body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                i += 17 + n
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not height or not width or n not in (1, 3):
                raise BadFrame("not 8 bits, or no size")
            frame = (height, width, [(body[6 + 3 * j], body[7 + 3 * j] >> 4, body[7 + 3 * j] & 15, body[8 + 3 * j]) for j in range(n)])
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise BadFrame("not baseline")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            break
    if frame is None or body[0] != len(frame[2]):
        raise BadFrame("not one scan of all components")
    height, width, parts = frame
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    chosen = {body[1 + 2 * j]: body[2 + 2 * j] for j in range(body[0])}
    plan, place = [], []
    for c, (name, h, v, _) in enumerate(parts):
        both = chosen.get(name, 0)
        dc, ac = lookup(*tables[both >> 4]), lookup(*tables[0x10 | both & 15])
        for y in range(v):
            for x in range(h):
                plan.append((c, dc, ac))
                place.append((c, y, x))
    if any(len(quant.get(q, ())) != 64 for *_, q in parts):
        raise BadFrame("no quantisation table")
    places, values = _scan(data[at:], plan, across * down, restart, len(parts))
    freq = np.zeros((across * down, len(place), 64))
    freq.ravel()[places] = values
    steps = np.array([quant[parts[c][3]] for c, *_ in place])
    cells = np.clip(np.rint((freq * steps).reshape(-1, 64) @ ZIGZAG_DCT + 128), 0, 255).astype(np.uint8).reshape(down, across, len(place), 8, 8)
    out, first = [], 0
    for _, h, v, _ in parts:
        own = cells[:, :, first : first + h * v].reshape(down, across, v, h, 8, 8)
        first += h * v
        plane = own.transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)
        out.append(plane[: -(-height * v // vmax), : -(-width * h // hmax)])
    return out


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks between two places; a list's name is its type."""
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), struct.unpack("<I", data[at + 4 : at + 8])[0]
        stop = min(end, at + 8 + size)
        if name in (b"RIFF", b"LIST"):
            yield bytes(data[at + 8 : at + 12]), at + 12, stop
        else:
            yield name, at + 8, stop
        at += 8 + size + (size & 1)


def parse_avi(raw: bytes) -> tuple[int, list[bytes]]:
    """Microseconds for a frame, and the frames of the first video stream; an empty frame repeats the one before."""
    data = memoryview(raw)
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise ValueError("no AVI")
    micros, stream, streams = 0, None, 0
    frames: list[bytes] = []

    def walk(at: int, end: int) -> None:
        for name, a, b in _chunks(data, at, end):
            if name == b"rec ":
                walk(a, b)
            elif name[2:] in (b"dc", b"db") and name[:2] == stream:
                frames.append(raw[a:b])

    for kind, a, b in _chunks(data, 0, len(raw)):
        if kind not in (b"AVI ", b"AVIX"):
            continue
        movie, index = None, None
        for name, c, d in _chunks(data, a, b):
            if name == b"hdrl":
                for x, e, f in _chunks(data, c, d):
                    if x == b"avih" and f - e >= 4:
                        micros = struct.unpack("<I", data[e : e + 4])[0]
                    elif x == b"strl":
                        for y, g, h in _chunks(data, e, f):
                            if y == b"strh" and bytes(data[g : g + 4]) == b"vids" and stream is None:
                                stream = b"%02d" % streams
                                scale, rate = struct.unpack("<II", data[g + 20 : g + 28]) if h - g >= 28 else (0, 0)
                                if scale and rate:
                                    micros = round(1_000_000 * scale / rate)
                        streams += 1
            elif name == b"movi":
                movie = (c, d)
            elif name == b"idx1":
                index = (c, d)
        if movie is None:
            continue
        stream = stream or b"00"
        listed = []
        if index:
            entries = [struct.unpack("<4sIII", data[i : i + 16]) for i in range(index[0], index[1] - 15, 16)]
            entries = [e for e in entries if e[0][:2] == stream and e[0][2:] in (b"dc", b"db")]
            for base in (movie[0] - 4, 0):  # offsets count from the list's type or from the file's start
                if entries and all(raw[base + e[2] : base + e[2] + 4] == e[0] and base + e[2] + 8 + e[3] <= len(raw) for e in entries):
                    listed = [raw[base + e[2] + 8 : base + e[2] + 8 + e[3]] for e in entries]
                    break
        if listed:
            frames += listed
        else:
            walk(*movie)
    if micros <= 0:
        raise ValueError("no frame rate")
    if not frames:
        raise ValueError("no frames")
    return micros, frames


def histogram(planes: list[np.ndarray]) -> np.ndarray:
    """Shares of 16 steps of brightness and 8 of each colour plane; 128 everywhere stands for a missing plane."""
    out = [np.bincount(planes[0].ravel() >> 4, minlength=16) / planes[0].size]
    for i in (1, 2):
        out.append(np.bincount(planes[i].ravel() >> 5, minlength=8) / planes[i].size if len(planes) > 1 else np.eye(8)[4])
    return np.concatenate(out)


def cuts(hists: np.ndarray) -> list[int]:
    """First frames of shots, 0 among them."""
    if len(hists) < 2:
        return [0]
    parts = np.abs(np.diff(hists, axis=0))
    d = np.maximum(parts[:, :16].sum(axis=1), np.maximum(parts[:, 16:24].sum(axis=1), parts[:, 24:].sum(axis=1))) / 2
    found = [0]
    for i in np.flatnonzero(d > FLOOR).tolist():
        near = np.concatenate([d[max(0, i - AROUND) : i], d[i + 1 : i + 1 + AROUND]])
        usual = np.median(near) if len(near) else 0.0
        spread = np.median(np.abs(near - usual)) if len(near) else 0.0
        if d[i] > usual + DEVIATIONS * spread:
            found.append(i + 1)
    return found


def clips(raw: bytes | None) -> tuple[list[tuple[int, int, int, int, int]], int, str | None]:
    """Clips (number, first frame, frames, start and end in milliseconds), undecodable frames, and what is wrong."""
    if not raw:
        return [], 0, "null" if raw is None else "empty"
    try:
        micros, frames = parse_avi(raw)
    except (ValueError, struct.error, IndexError) as e:
        return [], 0, str(e)
    hists, bad = [], 0
    for f in frames:
        if f or not hists:
            try:
                hists.append(histogram(decode_jpeg(f)))
                continue
            except (ValueError, struct.error, IndexError, KeyError):
                bad += 1
        hists.append(hists[-1] if hists else None)
    known = next((h for h in hists if h is not None), None)
    if known is None:
        return [], bad, "no frame can be decoded"
    first = cuts(np.array([known if h is None else h for h in hists]))
    ends = [*first[1:], len(frames)]
    return [(i, a, b - a, a * micros // 1000, b * micros // 1000) for i, (a, b) in enumerate(zip(first, ends, strict=True))], bad, None


def media_clips(df: DataFrame, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """Rows (``id_col``, ``clip``, ``first_frame``, ``n_frames``, ``start_ms``, ``end_ms``, ``bad_frames``, ``error``).

    One row for each clip of each row of ``df``. A row without clips gives one row with ``error`` and
    null clip columns: null and empty media, bytes that are no AVI, no frames, none that can be decoded.
    A frame that can't be decoded counts in ``bad_frames`` and looks like the one before it. Repeated
    rows and ids give their clips each; other columns are not read. An empty table gives an empty one.
    """
    prepare(df.sparkSession)
    fields = [(c, T.IntegerType()) for c in ("clip", "first_frame", "n_frames")] + [(c, T.LongType()) for c in ("start_ms", "end_ms")] + [("bad_frames", T.IntegerType()), ("error", T.StringType())]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(c, t) for c, t in fields]])
    kinds = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, at = [], []
                for i, raw in enumerate(part.column("media")):
                    found, bad, error = clips(raw.as_py())
                    rows += [(*x, bad, error) for x in found] or [(None,) * 5 + (bad, error)]
                    at += [i] * max(1, len(found))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at, pa.int32())), *columns], names=schema.names)

    return df.select(df[id_col].alias("id"), df[media_col].cast("binary").alias("media")).mapInArrow(run, schema)
