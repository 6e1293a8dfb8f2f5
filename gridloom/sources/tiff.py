"""GeoTIFF to arrays and back: strips or tiles, classic or BigTIFF, uncompressed, LZW or deflate.

Readers take the file's bytes, or a function (start, size) to bytes that fetches parts of it, so
that a header or a window costs what it needs and no more.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable

import numpy as np

Source = bytes | Callable[[int, int], bytes]

# Fixed values of the format: field sizes by type, and tags.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
DIFFERENCES, FLOAT_BYTES = 2, 3
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORMATION, GEO_KEYS, GEO_TEXT, NODATA = 33550, 33922, 34264, 34735, 34737, 42113
USER_DEFINED, CITATION = 32767, 3073
_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def _part(source: Source) -> Callable[[int, int], bytes]:
    return source if callable(source) else lambda start, size: source[start : start + size]


def tags(source: Source) -> tuple[str, dict[int, tuple]]:
    """Byte order and the first directory's tags."""
    part = _part(source)
    head = part(0, 16)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    magic = struct.unpack(order + "H", head[2:4])[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF")
    big = magic == 43
    number, counter, width, inline = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    at = struct.unpack_from(order + number, head, 8 if big else 4)[0]
    several = struct.calcsize("<" + counter)
    n = struct.unpack(order + counter, part(at, several))[0]
    entries = part(at + several, n * width)
    out = {}
    for k in range(n):
        tag, kind, many = struct.unpack_from(order + "HH" + number, entries, k * width)
        if kind not in _CODES:
            continue
        size = _SIZES[kind] * many
        place = k * width + width - inline
        raw = entries[place : place + size] if size <= inline else part(struct.unpack_from(order + number, entries, place)[0], size)
        out[tag] = (raw.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{many}{_CODES[kind]}", raw)
    return order, out


def metadata(source: Source) -> dict:
    """height, width, bands, dtype, nodata, srid and transform (a..f)."""
    return _described(tags(source)[1])


def _described(t: dict[int, tuple]) -> dict:
    transform = dict.fromkeys("abcdef", 0.0) | {"a": 1.0, "e": 1.0}
    if PIXEL_SCALE in t and TIEPOINT in t:
        sx, sy = t[PIXEL_SCALE][:2]
        i, j, _, x, y = t[TIEPOINT][:5]
        transform |= {"a": sx, "c": x - i * sx, "e": -sy, "f": y + j * sy}
    elif TRANSFORMATION in t:
        m = t[TRANSFORMATION]
        transform = {"a": m[0], "b": m[1], "c": m[3], "d": m[4], "e": m[5], "f": m[7]}
    keys = t.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    nodata = float(t[NODATA][0]) if t.get(NODATA, ("",))[0].strip() else None
    kind = _KINDS[t.get(SAMPLE_FORMAT, (1,))[0], t[BITS][0]]
    return {"height": t[HEIGHT][0], "width": t[WIDTH][0], "bands": t.get(SAMPLES, (1,))[0], "dtype": kind, "nodata": nodata, "srid": _srid(codes, t), "transform": transform}


def _piece(t: dict[int, tuple], m: dict) -> tuple[int, int]:
    """Height and width of a tile or strip."""
    if TILES in t:
        return t[TILE_HEIGHT][0], t[TILE_WIDTH][0]
    return min(t.get(ROWS_PER_STRIP, (m["height"],))[0], m["height"]), m["width"]


def layout(source: Source) -> dict:
    """``metadata``, and the height of the file's strips or tiles as ``piece``: rows that are unpacked together."""
    t = tags(source)[1]
    m = _described(t)
    return {**m, "piece": _piece(t, m)[0]}


def _srid(codes: dict[int, int], t: dict[int, tuple]) -> int | None:
    """The system's code; codes that 16 bits cannot hold stand in the citation, as ``AUTHORITY:code``."""
    code = codes.get(3072, codes.get(2048))
    named = re.search(r"\b(?:EPSG|ESRI):(\d+)", t.get(GEO_TEXT, ("",))[0])
    return int(named[1]) if code == USER_DEFINED and named else code


def unpack_lzw(data: bytes) -> bytes:
    """Most significant bit first, 9 to 12 bits a code, widened one code early."""
    table: list[bytes] = []
    out, before = [], b""
    held, bits, width = 0, 0, 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, before, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not table:
            raise ValueError("LZW data must begin with a clear code")
        if code < len(table):
            now = table[code]
        elif code == len(table) and before:
            now = before + before[:1]
        else:
            raise ValueError("broken LZW data")
        out.append(now)
        if before:
            table.append(before + now[:1])
        before = now
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _samples(raw: bytes, order: str, dtype: str, width: int, n: int, predictor: int) -> np.ndarray:
    """(rows, width, n) of one unpacked strip or tile."""
    kind = np.dtype(dtype)
    if predictor == FLOAT_BYTES:
        rows = np.frombuffer(raw, np.uint8).reshape(-1, width * n * kind.itemsize)
        # Byte differences run over the whole row; bytes stand most significant first, plane by plane.
        summed = np.stack([np.add.accumulate(rows[:, k::n], axis=1, dtype=np.uint8) for k in range(n)], 2).reshape(rows.shape)
        planes = summed.reshape(len(rows), kind.itemsize, width * n).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(f">f{kind.itemsize}").reshape(-1, width, n).astype(kind)
    block = np.frombuffer(raw, np.dtype(order + dtype)).reshape(-1, width, n)
    return np.add.accumulate(block.astype(kind), axis=1, dtype=kind) if predictor == DIFFERENCES else block


def read(source: Source, window: tuple[int, int, int, int] | None = None, bands: Callable[[int], bool] | None = None) -> np.ndarray:
    """(bands, height, width) of the whole image or of ``window`` (row, column, height, width), cut to the image.

    Only strips and tiles that meet the window are fetched and unpacked; where each band has its
    own, ``bands`` (of a number from 1) says which are wanted, and the others stay zero.
    """
    part = _part(source)
    order, t = tags(part)
    m = _described(t)
    packing, predictor = t.get(COMPRESSION, (NONE,))[0], t.get(PREDICTOR, (1,))[0]
    if packing not in (NONE, LZW, DEFLATE, OLD_DEFLATE) or predictor not in (1, DIFFERENCES, FLOAT_BYTES):
        raise ValueError(f"compression {packing} with predictor {predictor} is not read")
    unpack = {NONE: bytes, LZW: unpack_lzw}.get(packing, zlib.decompress)
    tiled = TILES in t
    bh, bw = _piece(t, m)
    starts, sizes = (t[TILES], t[TILE_BYTES]) if tiled else (t[STRIPS], t[STRIP_BYTES])
    together = t.get(PLANAR, (1,))[0] == 1
    top, left, tall, wide = window or (0, 0, m["height"], m["width"])
    bottom, right = min(top + tall, m["height"]), min(left + wide, m["width"])
    top, left = max(top, 0), max(left, 0)
    out = np.zeros((m["bands"], max(bottom - top, 0), max(right - left, 0)), m["dtype"])
    if not out.size:
        return out
    across, down = -(-m["width"] // bw), -(-m["height"] // bh)
    n = m["bands"] if together else 1
    for plane in range(1 if together else m["bands"]):
        if not together and bands is not None and not bands(plane + 1):
            continue
        for i in range(top // bh, -(-bottom // bh)):
            for j in range(left // bw, -(-right // bw)):
                k = plane * across * down + i * across + j
                block = _samples(unpack(part(starts[k], sizes[k])), order, m["dtype"], bw, n, predictor)
                r0, r1, c0, c1 = max(i * bh, top), min(i * bh + len(block), bottom), max(j * bw, left), min((j + 1) * bw, right)
                out[plane : plane + n, r0 - top : r1 - top, c0 - left : c1 - left] = block[r0 - i * bh : r1 - i * bh, c0 - j * bw : c1 - j * bw].transpose(2, 0, 1)
    return out


#: Bytes of a strip, before it is packed.
STRIP = 1 << 16


def write(array: np.ndarray, transform: dict[str, float], srid: int | None = None, nodata: float | None = None, compress: bool = True) -> bytes:
    """A GeoTIFF of (bands, height, width), in strips of some STRIP bytes, band after band."""
    bands, height, width = array.shape
    kind, bits = {"u": 1, "i": 2, "f": 3}[array.dtype.kind], array.dtype.itemsize * 8
    body = array.astype(array.dtype.newbyteorder("<"))
    rows = max(1, min(height, STRIP // max(1, width * array.dtype.itemsize)))
    planes = [body[i, r : r + rows].tobytes() for i in range(bands) for r in range(0, height, rows)]
    planes = [zlib.compress(p) if compress else p for p in planes]
    at, starts = 8, []
    for p in planes:
        starts.append(at)
        at += len(p) + len(p) % 2
    fields = [
        (WIDTH, "I", (width,)), (HEIGHT, "I", (height,)), (BITS, "H", (bits,) * bands), (COMPRESSION, "H", (8 if compress else 1,)), (PHOTOMETRIC, "H", (1,)),
        (STRIPS, "I", tuple(starts)), (SAMPLES, "H", (bands,)), (ROWS_PER_STRIP, "I", (rows,)), (STRIP_BYTES, "I", tuple(map(len, planes))), (PLANAR, "H", (2 if bands > 1 else 1,)), (SAMPLE_FORMAT, "H", (kind,) * bands),
        (PIXEL_SCALE, "d", (transform["a"], -transform["e"], 0.0)), (TIEPOINT, "d", (0.0, 0.0, 0.0, transform["c"], transform["f"], 0.0)),
    ]
    if srid and srid < 65536:
        fields.append((GEO_KEYS, "H", (1, 1, 0, 1, 2048 if srid < 5000 else 3072, 0, 1, srid)))
    elif srid:
        named = f"ESRI:{srid}|".encode()
        fields.append((GEO_KEYS, "H", (1, 1, 0, 2, 3072, 0, 1, USER_DEFINED, CITATION, GEO_TEXT, len(named), 0)))
        fields.append((GEO_TEXT, "s", named + b"\0"))
    if nodata is not None:
        fields.append((NODATA, "s", repr(float(nodata)).encode() + b"\0"))
    code = {"H": 3, "I": 4, "d": 12, "s": 2}
    extra, entries = b"", b""
    base = at + 2 + 12 * len(fields) + 4
    for tag, c, values in sorted(fields, key=lambda f: f[0]):
        raw = values if c == "s" else struct.pack(f"<{len(values)}{c}", *values)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, code[c], len(values), base + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries += struct.pack("<HHI", tag, code[c], len(values)) + raw.ljust(4, b"\0")
    data = b"".join(p + b"\0" * (len(p) % 2) for p in planes)
    return b"II" + struct.pack("<HI", 42, at) + data + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + extra
