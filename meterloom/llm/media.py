"""Media columns: progressive JPEG, decoded to RGB tensors, and bytes kept losslessly in JPEG coefficients.

A progressive JPEG sends the 64 coefficients of each 8x8 block in several
scans: bands of frequencies (spectral selection) and, band by band, first the
high and later the low bits (successive approximation). The decoder gathers all
scans in one coefficient array for each component and transforms it once.

Bytes are stored one to a coefficient, so nothing is lost to rounding. The
coefficient of a byte is never -1, 0 or 1: it stays nonzero in the first scan,
which leaves out the lowest bit, and each scan can name all sizes with codes
that together with the value's bits are equally long. Such scans, which the
decoder tells from the Huffman table, are read and written as arrays; any other
is read symbol by symbol.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh

BLOCK_BYTES = 64
_LARGEST = 4095  # 16-pixel units in a row or column; JPEG has 16 bits for a side


@functools.cache
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in the order in which JPEG sends them."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else -x[0]))
    return np.array([8 * r + c for r, c in cells])


@functools.cache
def _basis() -> np.ndarray:
    """Pixels (row-major) of each coefficient (in sending order): the inverse transform as a matrix."""
    x = np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, math.sqrt(1 / 8), 0.5)[:, None]
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[zigzag()].astype(np.float32)


class Huffman:
    """A table by its symbols in order of code length; codes[symbol] = (code, length)."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.counts, self.symbols, self.codes = counts, symbols, {}
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                self.codes[s] = (code, length)
                code += 1
            at, code = at + n, code << 1
        self.lookup = {(length, code): s for s, (code, length) in self.codes.items()}

    @functools.cached_property
    def words(self) -> tuple[int, np.ndarray] | None:
        """If each symbol is a size whose code and value bits are equally long together: that length, and the value of each such word."""
        lengths = {length + s for s, (_, length) in self.codes.items()}
        if len(lengths) != 1 or max(self.codes) > 15 or (width := lengths.pop()) > 16:
            return None
        values = np.full(1 << width, 1 << 20, np.int32)
        for s, (code, _) in self.codes.items():
            extra = np.arange(1 << s)
            values[(code << s) + extra] = np.where(extra >= (1 << s) >> 1, extra, extra - (1 << s) + 1) if s else 0
        return width, values


def _by_size(sizes: list[int]) -> Huffman:
    """The table in which the larger sizes have the shorter codes: 1, 2, 3 ... bits from the largest down."""
    order = sorted(sizes, reverse=True)
    return Huffman([1] * len(order) + [0] * (16 - len(order)), order)


#: Tables of the files written here: first scans of DC and AC, and refining scans, which hold runs of finished blocks only.
_DC, _AC, _REFINE = _by_size(list(range(9))), _by_size(list(range(1, 8))), Huffman([0, 0, 0, 15] + [0] * 12, [16 * n for n in range(15)])


@functools.cache
def _byte_values() -> np.ndarray:
    """The coefficient of each byte: -129..-2 and 2..129."""
    b = np.arange(256)
    return np.where(b < 128, b - 129, b - 126).astype(np.int16)


@functools.cache
def _first_words() -> np.ndarray:
    """The eight bits of each byte's coefficient in a first AC scan: its size's code and the value without its lowest bit."""
    v = _byte_values().astype(int)
    half = np.abs(v) >> 1
    size = np.array([int(x).bit_length() for x in half])
    code = np.array([_AC.codes[s][0] for s in size])
    return ((code << size) + np.where(v > 0, half, (1 << size) - 1 - half)).astype(np.uint8)


def _stuffed(raw: np.ndarray) -> bytes:
    """Entropy-coded bytes with a zero after each 0xFF."""
    at = np.flatnonzero(raw == 255)
    return (np.insert(raw, at + 1, 0) if len(at) else raw).tobytes()


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    return np.unpackbits(values.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - width :].reshape(-1)


def _from_bits(bits: np.ndarray) -> bytes:
    out = np.packbits(bits)
    if len(bits) % 8:
        out[-1] |= (1 << (8 - len(bits) % 8)) - 1
    return _stuffed(out)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _scan_header(components: list[int], table: int, band: tuple[int, int], high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *[x for c in components for x in (c, table)], *band, high << 4 | low]))


@functools.lru_cache(maxsize=256)
def _order(across: int, down: int) -> np.ndarray:
    """Blocks in the order of an interleaved scan of 4:2:0 data, as indices into luma, then both chroma planes."""
    y = np.arange(4 * across * down).reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    c = 4 * across * down + np.arange(across * down)[:, None]
    return np.concatenate([y, c, c + across * down], axis=1).reshape(-1)


@functools.lru_cache(maxsize=256)
def _head(across: int, down: int) -> bytes:
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = b"".join(bytes([kind, *t.counts, *t.symbols]) for kind, t in ((0x00, _DC), (0x10, _AC), (0x11, _REFINE)))
    jfif = b"JFIF\0" + bytes([1, 1, 0, 0, 1, 0, 1, 0, 0])
    return _segment(0xE0, jfif) + _segment(0xDB, bytes([0]) + b"\1" * 64) + _segment(0xC2, frame) + _segment(0xC4, tables)


def bytes_to_jpeg(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients are these bytes; their number must be a positive multiple of 64."""
    blocks, rest = divmod(len(payload), BLOCK_BYTES)
    if rest or not blocks:
        raise ValueError("not a positive multiple of 64 bytes")
    units = -(-blocks // 6)
    across = max(math.isqrt(units - 1) + 1, 1)
    down = -(-units // across)
    if down > _LARGEST or across > _LARGEST:
        raise ValueError("too large for one JPEG")
    data = np.zeros((6 * across * down, BLOCK_BYTES), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    n = across * down
    planes = [data[: 4 * n], data[4 * n : 5 * n], data[5 * n :]]
    order = _order(across, down)
    component = np.tile([0, 0, 0, 0, 1, 2], n)
    dc = _byte_values()[data[:, 0]].astype(int)
    high, diffs = dc[order] >> 1, np.empty(len(order), int)
    for c in range(3):
        own = component == c
        diffs[own] = np.diff(high[own], prepend=0)
    size = np.array([int(x).bit_length() for x in range(256)])[np.abs(diffs)]
    code = np.array([_DC.codes[s][0] for s in range(9)])[size]
    words = (code << size) + np.where(diffs >= 0, diffs, diffs + (1 << size) - 1)
    parts = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _head(across, down)]
    parts += [_scan_header([1, 2, 3], 0x00, (0, 0), 0, 1), _from_bits(_bits(words, 9))]
    first = _first_words()[data]
    for c, plane, bands in ((1, slice(0, 4 * n), ((1, 5), (6, 63))), (2, slice(4 * n, 5 * n), ((1, 63),)), (3, slice(5 * n, 6 * n), ((1, 63),))):
        for a, b in bands:
            parts += [_scan_header([c], 0x00, (a, b), 0, 1), _stuffed(first[plane, a : b + 1].reshape(-1))]
    low = (np.abs(_byte_values()) & 1).astype(np.uint8)
    for c, plane in enumerate(planes, 1):
        bits = []
        for at in range(0, len(plane), 32767):
            rows = plane[at : at + 32767, 1:]
            k = len(rows).bit_length() - 1
            word, length = _REFINE.codes[16 * k]
            head = (word << k) + len(rows) - (1 << k)
            bits += [np.array([head >> i & 1 for i in range(length + k - 1, -1, -1)], np.uint8), low[rows].reshape(-1)]
        parts += [_scan_header([c], 0x01, (1, 63), 1, 0), _from_bits(np.concatenate(bits))]
    parts += [_scan_header([1, 2, 3], 0x00, (0, 0), 1, 0), _from_bits((dc[order] & 1).astype(np.uint8)), b"\xff\xd9"]
    return b"".join(parts)


class _Component:
    def __init__(self, name: int, h: int, v: int, table: int):
        self.name, self.h, self.v, self.table = name, h, v, table


class Decoder:
    """Reads one progressive JPEG; coefficients[i] is (block rows, block columns, 64) in sending order."""

    def __init__(self, data: bytes):
        self.data, self.quant, self.tables, self.comment = data, {}, {}, b""
        self.interval = 0
        self.components: list[_Component] = []
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        at = 2
        while at + 4 <= len(data):
            if data[at] != 255:
                raise ValueError("no marker where one should be")
            marker = data[at + 1]
            if marker == 0xD9:
                break
            if marker == 255:
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                self._quant(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xC2:
                self._frame(body)
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a progressive JPEG with Huffman codes")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                at = self._scan(body, at)

    def _quant(self, body: bytes) -> None:
        while body:
            wide, name = body[0] >> 4, body[0] & 15
            n = 64 << wide
            self.quant[name] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
            body = body[1 + n :]

    def _huffman(self, body: bytes) -> None:
        while body:
            counts = list(body[1:17])
            n = sum(counts)
            self.tables[body[0]] = _table(bytes(counts), body[17 : 17 + n])
            body = body[17 + n :]

    def _frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or n not in (1, 3):
            raise ValueError("only 8-bit samples of one or three components")
        self.components = [_Component(*x) for x in [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]]
        self.hmax, self.vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.coefficients = [np.zeros((self.down * c.v, self.across * c.h, 64), np.int32) for c in self.components]

    def _blocks(self, chosen: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
        """Component and flat block index of each block of a scan, and blocks in a unit of it."""
        if len(chosen) == 1:
            c = self.components[chosen[0]]
            rows = -(-(-(-self.height * c.v // self.vmax)) // 8)
            columns = -(-(-(-self.width * c.h // self.hmax)) // 8)
            index = (np.arange(rows)[:, None] * (self.across * c.h) + np.arange(columns)).reshape(-1)
            return np.full(len(index), chosen[0]), index, 1
        parts, names = [], []
        for i in chosen:
            c = self.components[i]
            grid = np.arange(self.down * c.v * self.across * c.h).reshape(self.down, c.v, self.across, c.h)
            parts.append(grid.transpose(0, 2, 1, 3).reshape(self.down * self.across, -1))
            names += [i] * (c.h * c.v)
        return np.tile(names, self.down * self.across), np.concatenate(parts, axis=1).reshape(-1), len(names)

    def _scan(self, body: bytes, at: int) -> int:
        n = body[0]
        names = [c.name for c in self.components]
        chosen = [names.index(body[1 + 2 * i]) for i in range(n)]
        selectors = [body[2 + 2 * i] for i in range(n)]
        first, last, approx = body[1 + 2 * n : 4 + 2 * n]
        high, low = approx >> 4, approx & 15
        end, cuts = at, []
        while True:
            end = self.data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(self.data):
                end = len(self.data)
                break
            if 0xD0 <= self.data[end + 1] <= 0xD7:
                cuts.append(end)
            elif self.data[end + 1]:
                break
            end += 2
        starts = [at, *[c + 2 for c in cuts]]
        component, index, unit = self._blocks(chosen)
        step = self.interval * unit if self.interval else len(index)
        for k, (a, b) in enumerate(zip(starts, [*cuts, end])):
            raw = self.data[a:b].replace(b"\xff\x00", b"\xff")
            own = slice(k * step, (k + 1) * step)
            comp, idx = component[own], index[own]
            if first == 0:
                self._dc(raw, comp, idx, dict(zip(chosen, selectors)), high, low)
            else:
                flat = self.coefficients[chosen[0]].reshape(-1, 64)
                table = self.tables[0x10 | selectors[0] & 15]
                if high:
                    self._ac_refine(raw, flat, idx, table, first, last, low)
                else:
                    self._ac_first(raw, flat, idx, table, first, last, low)
        return end

    def _dc(self, raw: bytes, comp: np.ndarray, idx: np.ndarray, selectors: dict[int, int], high: int, low: int) -> None:
        if high:
            values = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(idx)).astype(np.int32) << low
        else:
            tables = {c: self.tables[s >> 4] for c, s in selectors.items()}
            one = next(iter(tables.values()))
            if all(t is one for t in tables.values()) and one.words:
                values = _words(raw, one, len(idx))
            else:
                reader = _Reader(raw)
                values = np.array([reader.value(reader.symbol(tables[c])) for c in comp.tolist()], np.int32)
        for c in selectors:
            own = comp == c
            flat = self.coefficients[c].reshape(-1, 64)
            if high:
                flat[idx[own], 0] |= values[own]
            else:
                flat[idx[own], 0] = np.cumsum(values[own]) << low

    def _ac_first(self, raw: bytes, flat: np.ndarray, idx: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
        n = len(idx) * (last - first + 1)
        if table.words and 0 not in table.codes and len(raw) == -(-n * table.words[0] // 8):
            flat[idx, first : last + 1] = _words(raw, table, n).reshape(len(idx), -1) << low
            return
        reader, run = _Reader(raw), 0
        for i in idx.tolist():
            if run:
                run -= 1
                continue
            k = first
            while k <= last:
                zeros, size = divmod(reader.symbol(table), 16)
                if size:
                    k += zeros
                    flat[i, k] = reader.value(size) * (1 << low)
                elif zeros == 15:
                    k += 15
                else:
                    run = (1 << zeros) + reader.bits(zeros) - 1
                    break
                k += 1

    def _ac_refine(self, raw: bytes, flat: np.ndarray, idx: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
        reader, one, at = _Reader(raw), 1 << low, 0
        while at < len(idx):
            i, k, run = idx[at], first, 0
            row = flat[i]
            while k <= last:
                zeros, size = divmod(reader.symbol(table), 16)
                value = 0
                if size:
                    value = one if reader.bits(1) else -one
                elif zeros < 15:
                    run = (1 << zeros) + reader.bits(zeros)
                    break
                while k <= last:
                    if row[k]:
                        if reader.bits(1) and not row[k] & one:
                            row[k] += one if row[k] > 0 else -one
                    elif zeros:
                        zeros -= 1
                    else:
                        row[k] = value
                        k += 1
                        break
                    k += 1
            if not run:
                at += 1
                continue
            # The rest of this block and the next run - 1 blocks have one bit for each coefficient that is not zero.
            rows = idx[at : at + run]
            band = flat[rows, first : last + 1]
            open_ = band != 0
            open_[0, : k - first] = False
            bits = reader.array(int(open_.sum()))
            values = band[open_]
            values += np.where(values > 0, one, -one) * (bits.astype(np.int32) * ((np.abs(values) & one) == 0))
            band[open_] = values
            flat[rows, first : last + 1] = band
            at += run

    def planes(self) -> list[np.ndarray]:
        """Samples of each component, rounded to 0..255, at its own resolution."""
        out = []
        for c, coefficients in zip(self.components, self.coefficients):
            rows, columns, _ = coefficients.shape
            pixels = (coefficients.reshape(-1, 64).astype(np.float32) * self.quant[c.table]) @ _basis()
            pixels = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)
            out.append(pixels.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns))
        return out

    def rgb(self) -> np.ndarray:
        """The full-resolution picture, (height, width, 3) of 8 bits; chroma samples are repeated."""
        full = []
        for c, p in zip(self.components, self.planes()):
            v, h = self.vmax // c.v, self.hmax // c.h
            p = p if v == h == 1 else np.repeat(np.repeat(p, v, axis=0), h, axis=1)
            full.append(p[: self.height, : self.width].astype(np.float32))
        if len(full) == 1:
            return np.repeat(full[0][:, :, None], 3, axis=2).astype(np.uint8)
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)

    def payload(self) -> bytes:
        """The bytes that bytes_to_jpeg() stored."""
        n = int(self.comment.removeprefix(b"payload "))
        v = np.concatenate([c.reshape(-1) for c in self.coefficients])[:n]
        return np.where(v < 0, v + 129, v + 126).astype(np.uint8).tobytes()


@functools.lru_cache(maxsize=64)
def _table(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(list(counts), list(symbols))


def _words(raw: bytes, table: Huffman, n: int) -> np.ndarray:
    width, values = table.words
    data = np.frombuffer(raw, np.uint8)
    if width == 8:
        return values[data[:n]]
    bits = np.zeros((n, 16), np.uint8)
    bits[:, 16 - width :] = np.unpackbits(data, count=n * width).reshape(n, width)
    return values[np.packbits(bits, axis=1).view(">u2").reshape(-1)]


class _Reader:
    """Bits of entropy-coded data, one symbol after the other; past its end come zeros."""

    def __init__(self, raw: bytes):
        self.all, self.at = np.unpackbits(np.frombuffer(raw, np.uint8)), 0
        self.end = len(self.all)

    def bits(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | (int(self.all[self.at]) if self.at < self.end else 0)
            self.at += 1
        return out

    def array(self, n: int) -> np.ndarray:
        out = self.all[self.at : self.at + n]
        self.at += n
        return out if len(out) == n else np.concatenate([out, np.zeros(n - len(out), np.uint8)])

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bits(1)
            found = table.lookup.get((length, code))
            if found is not None:
                return found
        raise ValueError("no code of the table")

    def value(self, size: int) -> int:
        x = self.bits(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def feature_of(rgb: np.ndarray) -> str:
    """Width x height, the mean of each channel in 1/1000, and a checksum of a grid of 4 x 4 mean colours."""
    h, w, _ = rgb.shape
    n = h * w
    means = ",".join(str(int(x) * 1000 // n) for x in rgb.sum(axis=(0, 1), dtype=np.int64))
    rows, columns = (np.arange(4) * s // 4 for s in (h, w))
    grid = np.add.reduceat(np.add.reduceat(rgb, rows, axis=0, dtype=np.int64), columns, axis=1) * 16 // n
    return f"{w}x{h}:{means}:{zlib.crc32(grid.astype('<i8').tobytes()):08x}"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, filled with zeros to a positive multiple of 64, and their number before."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % BLOCK_BYTES or (0 if raw else BLOCK_BYTES)), len(raw)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media (a JPEG) of each row's whole text.

    Null texts count as empty and are 64 zero bytes. Every row stands for
    itself, those with null or equal ids too; equal texts give equal files.
    Other columns are not read; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                made = [payload_of(t) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([bytes_to_jpeg(p) for p, _ in made], pa.binary())], [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


def decode_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns, and _height, _width and _rgb (height x width x 3 bytes) of each progressive JPEG, and _problem.

    Null media have null pictures. What is no progressive JPEG, or a broken one,
    has a null picture and says why in _problem. Names that are taken get more
    underscores. Repeated rows and rows with equal ids stand for themselves; an
    empty table gives no row.
    """
    at = media.columns.index(media_col)
    added = [fresh(media, x) for x in ("_height", "_width", "_rgb", "_problem")]

    def picture(data: bytes | None) -> tuple[int | None, int | None, bytes | None, str | None]:
        if data is None:
            return None, None, None, None
        try:
            rgb = Decoder(data).rgb()
        except Exception as e:  # noqa: BLE001 (bytes of any kind may come)
            return None, None, None, f"{type(e).__name__}: {e}"
        return rgb.shape[0], rgb.shape[1], rgb.tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                rows = batch.slice(i, 32)
                found = zip(*map(picture, rows.column(at).to_pylist()))
                more = [pa.array(list(c), k) for c, k in zip(found, (pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, *added])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(run, f"{types}, `{added[0]}` int, `{added[1]}` int, `{added[2]}` binary, `{added[3]}` string")


def media_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What is read back from the files of encode_texts(): digests of payload and file, and the picture's feature; nulls for null media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stored in batch.column(2).to_pylist():
                if stored is None:
                    out.append((None,) * 6)
                    continue
                decoder = Decoder(stored)
                payload = decoder.payload()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK_BYTES:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(decoder.rgb())))
            if out:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
