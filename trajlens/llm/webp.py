"""Lossless WebP (VP8L) codec: NumPy arrays to files and back.

``decode`` handles the whole format: prefix codes (simple and normal, one group or an entropy image), back-references,
colour cache, and the predictor, cross-colour, subtract-green and palette transforms. ``encode`` writes any of them on
request. ``encode_samples`` and ``decode_samples`` treat many one-channel images at once: their pixels are packed, and
their codes looked up, in array steps that advance all images together.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np

#: Fixed values of the format: order of the code length codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (x, y) offsets of the first 120 distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
#: Fixed values of the format.
SIGNATURE, CACHE_FACTOR = 0x2F, 0x1E35A7BD
LENGTHS, DISTANCES, LITERALS = 24, 40, 256
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
_REVERSED = {}


def _reversal(bits: int) -> np.ndarray:
    """Numbers of ``bits`` bits, read backwards."""
    if bits not in _REVERSED:
        out = np.zeros(1, np.int64)
        for place in range(bits):
            out = np.concatenate([out, out | 1 << (bits - 1 - place)])
        _REVERSED[bits] = out
    return _REVERSED[bits]


# --- bits -----------------------------------------------------------------------------------------------------------


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.value, self.at, self.end = int.from_bytes(data, "little"), at, 8 * len(data)

    def read(self, count: int) -> int:
        out = self.value >> self.at & (1 << count) - 1
        self.at += count
        if self.at > self.end:
            raise ValueError("the stream ends too early")
        return out


class ChunkReader(BitReader):
    """A reader for long streams: holds a few bytes at a time."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def read(self, count: int) -> int:
        out = self.peek(count)
        self.at += count
        if self.at > self.end:
            raise ValueError("the stream ends too early")
        return out

    def peek(self, count: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 6], "little") >> (self.at & 7) & (1 << count) - 1


class BitWriter:
    def __init__(self):
        self.value = self.at = 0
        self.done = bytearray()

    def write(self, value: int, count: int) -> None:
        self.value |= value << self.at
        self.at += count
        if self.at > 4096:
            whole = self.at >> 3
            self.done += (self.value & (1 << 8 * whole) - 1).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.at -= 8 * whole

    def bits(self) -> tuple[int, int]:
        return int.from_bytes(self.done + self.value.to_bytes(-(-self.at // 8), "little"), "little"), 8 * len(self.done) + self.at

    def bytes(self) -> bytes:
        return bytes(self.done + self.value.to_bytes(-(-self.at // 8), "little"))


# --- prefix codes ---------------------------------------------------------------------------------------------------


def code_lengths(counts: Sequence[int], longest: int = 15) -> list[int]:
    """Lengths of a Huffman code, at most ``longest``; a single symbol gets 1."""
    used = [(count, symbol) for symbol, count in enumerate(counts) if count]
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0][1]] = 1
    while len(used) > 1:
        heap = [(count, place, (symbol,)) for place, (count, symbol) in enumerate(used)]
        heapq.heapify(heap)
        depth, made = dict.fromkeys((symbol for _count, symbol in used), 0), len(used)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heapq.heappop(heap)
            both = a[2] + b[2]
            for symbol in both:
                depth[symbol] += 1
            heapq.heappush(heap, (a[0] + b[0], made, both))
            made += 1
        if max(depth.values()) <= longest:
            for symbol, length in depth.items():
                out[symbol] = length
            break
        used = [((count + 1) // 2, symbol) for count, symbol in used]
    return out


def canonical(lengths: Sequence[int]) -> list[int]:
    """Code of each symbol, first bit lowest; one used symbol has an empty code."""
    out, code, before = [0] * len(lengths), 0, 0
    for length, symbol in sorted((length, symbol) for symbol, length in enumerate(lengths) if length):
        code <<= length - before
        before = length
        out[symbol] = int(f"{code:0{length}b}"[::-1], 2)
        code += 1
    return out


class Lookup:
    """Decoding table of a prefix code: entry = length << 16 | symbol, by the next ``bits`` bits."""

    def __init__(self, lengths: Sequence[int]):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if not len(used):
            self.bits, self.table = 0, np.zeros(1, np.int64)
        elif len(used) == 1:
            self.bits, self.table = 0, used.astype(np.int64)
        else:
            self.bits = int(lengths.max())
            order = used[np.lexsort((used, lengths[used]))]
            sizes = lengths[order].astype(np.int64)
            table = np.repeat(sizes << 16 | order, 1 << (self.bits - sizes))
            if len(table) != 1 << self.bits:
                raise ValueError("a prefix code is incomplete or over-full")
            self.table = table[_reversal(self.bits)]
        self.single = int(self.table[0]) if self.bits == 0 else None
        self.entries = None

    def read(self, reader: ChunkReader) -> int:
        if self.bits == 0:
            return self.single
        if self.entries is None:
            self.entries = self.table.tolist()
        entry = self.entries[reader.peek(self.bits)]
        reader.at += entry >> 16
        if reader.at > reader.end:
            raise ValueError("the stream ends too early")
        return entry & 0xFFFF


def read_code(reader: BitReader, symbols: int) -> list[int]:
    """Code lengths of one prefix code."""
    lengths = [0] * symbols
    if reader.read(1):
        both = reader.read(1)
        first = reader.read(8 if reader.read(1) else 1)
        lengths[first] = 1
        if both:
            lengths[reader.read(8)] = 1
        return lengths
    kinds = [0] * 19
    for place in range(4 + reader.read(4)):
        kinds[LENGTH_ORDER[place]] = reader.read(3)
    lookup = Lookup(kinds)
    table, bits = lookup.table.tolist(), lookup.bits
    left = 2 + reader.read(2 + 2 * reader.read(3)) if reader.read(1) else symbols
    place, before = 0, 8
    while place < symbols and left:
        left -= 1
        entry = table[reader.value >> reader.at & (1 << bits) - 1] if isinstance(reader.__dict__.get("value"), int) else table[reader.peek(bits)]
        reader.at += entry >> 16
        kind = entry & 0xFFFF
        if kind < 16:
            lengths[place] = kind
            place += 1
            before = kind or before
        else:
            value, repeat = (before, 3 + reader.read(2)) if kind == 16 else (0, 3 + reader.read(3)) if kind == 17 else (0, 11 + reader.read(7))
            if place + repeat > symbols:
                raise ValueError("code lengths run over the alphabet")
            lengths[place : place + repeat] = [value] * repeat
            place += repeat
    return lengths


def write_code(writer: BitWriter, lengths: Sequence[int]) -> None:
    used = [symbol for symbol, length in enumerate(lengths) if length]
    if len(used) <= 2 and all(symbol < 256 for symbol in used):
        used = used or [0]
        writer.write(1 | (len(used) - 1) << 1 | 1 << 2, 3)
        for symbol in used:
            writer.write(symbol, 8)
        return
    runs, place = [], 0
    while place < len(lengths):
        value, size = lengths[place], 1
        while place + size < len(lengths) and lengths[place + size] == value:
            size += 1
        place += size
        if value:
            runs.append((value, 0, 0))
            size -= 1
            while size >= 3:
                part = min(size, 6)
                runs.append((16, part - 3, 2))
                size -= part
        else:
            while size >= 3:
                part = min(size, 138)
                runs.append((18, part - 11, 7) if part >= 11 else (17, part - 3, 3))
                size -= part
        runs += [(value, 0, 0)] * size
    counts = [0] * 19
    for kind, _extra, _bits in runs:
        counts[kind] += 1
    kinds = code_lengths(counts, 7)
    codes = canonical(kinds)
    shown = max(place for place, kind in enumerate(LENGTH_ORDER) if kinds[kind]) + 1
    shown = max(shown, 4)
    writer.write((shown - 4) << 1, 5)
    for kind in LENGTH_ORDER[:shown]:
        writer.write(kinds[kind], 3)
    writer.write(0, 1)
    single = sum(map(bool, counts)) == 1
    for kind, extra, bits in runs:
        if not single:
            writer.write(codes[kind], kinds[kind])
        writer.write(extra, bits)


def prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, extra value and extra bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    high = value.bit_length() - 1
    return 2 * high + (value >> (high - 1) & 1), value & (1 << (high - 1)) - 1, high - 1


def value_of(symbol: int, reader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return (2 + (symbol & 1) << extra) + reader.read(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# --- decoding -------------------------------------------------------------------------------------------------------


def _cells(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def _read_group(reader, cache_bits: int) -> list[Lookup]:
    sizes = (LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCES)
    return [Lookup(read_code(reader, size)) for size in sizes]


def _read_pixels(reader, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded image as ARGB numbers."""
    cache_bits = reader.read(4) if reader.read(1) else 0
    groups_of, bits = None, 0
    if main and reader.read(1):
        bits = reader.read(3) + 2
        groups_of = (_read_pixels(reader, _cells(width, bits), _cells(height, bits), False) >> 8 & 0xFFFF).tolist()
    groups = [_read_group(reader, cache_bits) for _ in range(max(groups_of) + 1 if groups_of else 1)]
    cache = [0] * (1 << cache_bits)
    across, shift = _cells(width, bits), 32 - cache_bits
    total, at = width * height, 0
    out = [0] * total

    def remember(start: int, stop: int) -> None:
        for argb in out[start:stop]:
            cache[(CACHE_FACTOR * argb & 0xFFFFFFFF) >> shift] = argb

    while at < total:
        group = groups[groups_of[(at // width >> bits) * across + (at % width >> bits)]] if groups_of else groups[0]
        symbol = group[0].read(reader)
        start = at
        if symbol < LITERALS:
            red, blue, alpha = group[1].read(reader), group[2].read(reader), group[3].read(reader)
            out[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < LITERALS + LENGTHS:
            length = value_of(symbol - LITERALS, reader)
            back = distance_of(value_of(group[4].read(reader), reader), width)
            if back > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out[at] = out[at - back]
                at += 1
        else:
            out[at] = cache[symbol - LITERALS - LENGTHS]
            at += 1
        if cache_bits:
            remember(start, at)
    return np.array(out, np.int64)


def _channels(pixels: np.ndarray) -> np.ndarray:
    return np.stack([pixels >> shift & 0xFF for shift in (24, 16, 8, 0)], axis=-1)


def _packed(channels: np.ndarray) -> np.ndarray:
    channels = channels & 0xFF
    return channels[..., 0] << 24 | channels[..., 1] << 16 | channels[..., 2] << 8 | channels[..., 3]


def _halves(a: list[int], b: list[int]) -> list[int]:
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _guess(mode: int, left, top, corner, right) -> list[int]:
    """Predicted channels from the neighbours: left, top, top left, top right."""
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _halves(_halves(left, right), top)
    if mode in (6, 7, 8, 9):
        return _halves(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _halves(_halves(left, corner), _halves(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(a - c) for a, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, a + t - c)) for a, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        # The quotient is rounded towards zero.
        return [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(_halves(left, top), corner, strict=True)]
    return [255, 0, 0, 0]


def _predicted(values: list, modes: list[int], width: int, height: int, bits: int, forward: bool) -> list:
    """Residuals from pixels (forward) or pixels from residuals; values are channel lists in page order."""
    across, out = _cells(width, bits), []
    known = values if forward else out
    for at in range(width * height):
        x, y = at % width, at // width
        if y == 0:
            guess = known[at - 1] if x else [255, 0, 0, 0]
        elif x == 0:
            guess = known[at - width]
        else:
            mode = modes[(y >> bits) * across + (x >> bits)]
            guess = _guess(mode, known[at - 1], known[at - width], known[at - width - 1], known[at - width + 1])
        sign = -1 if forward else 1
        out.append([(value + sign * other) & 0xFF for value, other in zip(values[at], guess, strict=True)])
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return np.where(values >= 128, values - 256, values)


def _spread(cells: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    rows, columns = np.arange(height) >> bits, np.arange(width) >> bits
    return cells.reshape(_cells(height, bits), _cells(width, bits), 4)[rows][:, columns]


def _crossed(pixels: np.ndarray, cells: np.ndarray, width: int, height: int, bits: int, forward: bool) -> np.ndarray:
    image = _channels(pixels).reshape(height, width, 4)
    factors = _signed(_spread(_channels(cells), width, height, bits))
    red_blue, green_blue, green_red = factors[..., 1], factors[..., 2], factors[..., 3]
    sign = -1 if forward else 1
    green, red = _signed(image[..., 2]), image[..., 1]
    new_red = red + sign * (green_red * green >> 5) & 0xFF
    true_red = _signed(red if forward else new_red)
    blue = image[..., 3] + sign * ((green_blue * green >> 5) + (red_blue * true_red >> 5))
    return _packed(np.stack([image[..., 0], new_red, image[..., 2], blue], axis=-1)).reshape(-1)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def chunk_of(file: bytes) -> bytes:
    """The VP8L chunk of a WebP file."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    return file[20 : 20 + int.from_bytes(file[16:20], "little")]


def _read_head(reader) -> tuple[int, int]:
    if reader.read(8) != SIGNATURE:
        raise ValueError("wrong signature")
    width, height = reader.read(14) + 1, reader.read(14) + 1
    reader.read(1)
    if reader.read(3):
        raise ValueError("unknown version")
    return width, height


def decode(file: bytes) -> np.ndarray:
    """Pixels as a (height, width, 4) array of alpha, red, green, blue."""
    reader = ChunkReader(chunk_of(file))
    width, height = _read_head(reader)
    steps, full = [], width
    while reader.read(1):
        kind = reader.read(2)
        if any(kind == step[0] for step in steps):
            raise ValueError("a transform is used twice")
        if kind in (PREDICTOR, CROSS):
            bits = reader.read(3) + 2
            steps.append((kind, bits, _read_pixels(reader, _cells(width, bits), _cells(height, bits), False), width))
        elif kind == GREEN:
            steps.append((kind, 0, None, width))
        else:
            colours = reader.read(8) + 1
            table = _packed(np.cumsum(_channels(_read_pixels(reader, colours, 1, False)), axis=0))
            bits = _bundle_bits(colours)
            steps.append((kind, bits, table, width))
            width = _cells(width, bits)
    pixels = _read_pixels(reader, width, height, True)
    for kind, bits, data, wide in reversed(steps):
        if kind == PREDICTOR:
            modes = (data >> 8 & 15).tolist()
            pixels = _packed(np.array(_predicted(_channels(pixels).tolist(), modes, wide, height, bits, False)))
        elif kind == CROSS:
            pixels = _crossed(pixels, data, wide, height, bits, False)
        elif kind == GREEN:
            channels = _channels(pixels)
            channels[:, 1] += channels[:, 2]
            channels[:, 3] += channels[:, 2]
            pixels = _packed(channels)
        else:
            index = (pixels >> 8 & 0xFF).reshape(height, -1, 1)
            each = 8 >> bits
            parts = index >> (np.arange(1 << bits) * each) & (1 << each) - 1
            index = parts.reshape(height, -1)[:, :wide].reshape(-1)
            pixels = np.where(index < len(data), data[np.minimum(index, len(data) - 1)], 0)
    return _channels(pixels).reshape(height, full, 4).astype(np.uint8)


# --- encoding -------------------------------------------------------------------------------------------------------


def file_of(chunk: bytes) -> bytes:
    body = b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk + b"\0" * (len(chunk) % 2)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def _tokens(pixels: list[int], width: int, cache_bits: int, references: bool) -> list[tuple]:
    """('pixel', argb), ('cache', index) and ('copy', length, distance code), one list entry each."""
    out, at, cache, seen = [], 0, [0] * (1 << cache_bits), {}
    codes = {}
    for code in range(len(NEAR), 0, -1):
        codes[distance_of(code, width)] = code
    while at < len(pixels):
        size, back = 0, 0
        if references:
            back = at - seen.get(tuple(pixels[at : at + 3]), at)
            while back and at + size < len(pixels) and size < 4096 and pixels[at + size] == pixels[at + size - back]:
                size += 1
        stop = at + max(1, size if size >= 3 else 1)
        if size >= 3:
            out.append(("copy", size, codes.get(back, back + 120)))
        else:
            slot = (CACHE_FACTOR * pixels[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            out.append(("cache", slot) if cache_bits and cache[slot] == pixels[at] else ("pixel", pixels[at]))
        for place in range(at, stop):
            seen[tuple(pixels[place : place + 3])] = place
            if cache_bits:
                cache[(CACHE_FACTOR * pixels[place] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[place]
        at = stop
    return out


def _write_pixels(
    writer: BitWriter, pixels: np.ndarray, width: int, height: int, main: bool, cache_bits: int = 0, references: bool = False,
    group_bits: int = 0, groups: Sequence[int] = (0, 1),
) -> None:
    writer.write(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    across, group_count = _cells(width, group_bits), 1
    if main:
        writer.write(bool(group_bits), 1)
        if group_bits:
            cells = np.resize(np.array(groups), across * _cells(height, group_bits))
            group_count = int(cells.max()) + 1
            writer.write(group_bits - 2, 3)
            _write_pixels(writer, cells << 8, across, _cells(height, group_bits), False)
    sizes = (LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCES)
    counts = [[[0] * size for size in sizes] for _ in range(group_count)]
    stream, at = [], 0
    for token in _tokens(pixels.tolist(), width, cache_bits, references):
        group = int(cells[(at // width >> group_bits) * across + (at % width >> group_bits)]) if group_count > 1 else 0
        if token[0] == "pixel":
            parts = [(0, token[1] >> 8 & 255, 0, 0), (1, token[1] >> 16 & 255, 0, 0), (2, token[1] & 255, 0, 0), (3, token[1] >> 24, 0, 0)]
            at += 1
        elif token[0] == "cache":
            parts = [(0, LITERALS + LENGTHS + token[1], 0, 0)]
            at += 1
        else:
            length, back = prefix_of(token[1]), prefix_of(token[2])
            parts = [(0, LITERALS + length[0], *length[1:]), (4, *back)]
            at += token[1]
        for kind, symbol, _extra, _bits in parts:
            counts[group][kind][symbol] += 1
        stream.append((group, parts))
    coded = []
    for group in counts:
        lengths = [code_lengths(part) for part in group]
        for part in lengths:
            write_code(writer, part)
        coded.append([(canonical(part), part if sum(map(bool, part)) > 1 else [0] * len(part)) for part in lengths])
    for group, parts in stream:
        for kind, symbol, extra, bits in parts:
            codes, lengths = coded[group][kind]
            writer.write(codes[symbol] if lengths[symbol] else 0, lengths[symbol])
            writer.write(extra, bits)


def _begin(writer: BitWriter, width: int, height: int, alpha: bool) -> None:
    writer.write(SIGNATURE, 8)
    writer.write(width - 1, 14)
    writer.write(height - 1, 14)
    writer.write(alpha, 1)
    writer.write(0, 3)


def encode(
    image: np.ndarray, palette: bool = False, predictor: Sequence[int] = (), cross: Sequence[tuple[int, int, int]] = (), green: bool = False,
    cache_bits: int = 0, references: bool = True, group_bits: int = 0, cell_bits: int = 2, groups: Sequence[int] = (0, 1),
) -> bytes:
    """A WebP file of a (height, width, 4) array (alpha, red, green, blue).

    ``predictor`` gives modes, ``cross`` (green to red, green to blue, red to blue) factors and ``groups`` the groups of prefix
    codes, used in turns by cells.
    """
    height, width = image.shape[:2]
    pixels = _packed(image.astype(np.int64)).reshape(-1)
    writer = BitWriter()
    _begin(writer, width, height, bool((image[..., 0] != 255).any()))
    if palette:
        colours, index = np.unique(pixels, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        writer.write(1 | PALETTE << 1, 3)
        writer.write(len(colours) - 1, 8)
        parts = _channels(colours)
        _write_pixels(writer, _packed(np.diff(parts, axis=0, prepend=np.zeros((1, 4), np.int64))), len(colours), 1, False)
        bits = _bundle_bits(len(colours))
        wide = _cells(width, bits)
        index = np.pad(index.reshape(height, width), ((0, 0), (0, (wide << bits) - width))).reshape(height, wide, 1 << bits)
        pixels, width = ((index << (np.arange(1 << bits) * (8 >> bits))).sum(axis=2) << 8 | 255 << 24).reshape(-1), wide
    cells = _cells(width, cell_bits) * _cells(height, cell_bits)
    if predictor:
        modes = np.resize(np.array(predictor), cells)
        writer.write(1 | PREDICTOR << 1, 3)
        writer.write(cell_bits - 2, 3)
        _write_pixels(writer, modes << 8 | 255 << 24, _cells(width, cell_bits), _cells(height, cell_bits), False)
        pixels = _packed(np.array(_predicted(_channels(pixels).tolist(), modes.tolist(), width, height, cell_bits, True)))
    if cross:
        factors = np.resize(np.array(cross) & 0xFF, (cells, 3))
        table = 255 << 24 | factors[:, 2] << 16 | factors[:, 1] << 8 | factors[:, 0]
        writer.write(1 | CROSS << 1, 3)
        writer.write(cell_bits - 2, 3)
        _write_pixels(writer, table, _cells(width, cell_bits), _cells(height, cell_bits), False)
        pixels = _crossed(pixels, table, width, height, cell_bits, True)
    if green:
        writer.write(1 | GREEN << 1, 3)
        channels = _channels(pixels)
        channels[:, 1] -= channels[:, 2]
        channels[:, 3] -= channels[:, 2]
        pixels = _packed(channels)
    writer.write(0, 1)
    _write_pixels(writer, pixels, width, height, True, cache_bits, references, group_bits, groups)
    return file_of(writer.bytes())


# --- many one-channel images ------------------------------------------------------------------------------------------

_ALPHABET = LITERALS + LENGTHS
#: Orders of bytes by frequency in Latin-script text: plain, with accents (UTF-8), in capitals. What is not named
#: follows, accents before the rest.
_ORDERS = (
    b" etaoinshrdlucmfwygpbvk.,xqjz\n",
    b" e\xc3aniorstludcmpghb\xa9\xa8\xbc\xa4\xb6\xb3\xb1vqfz.,\xa1\xad\xa7\xaaxjyk\n",
    b" ETAOINSHRDLUCMFWYGPBVK.,!XQJZ\n",
)
#: Bits by which a shared code may exceed the entropy, relative and absolute, before an image gets its own code.
_TOLERANCE, _OWN_HEAD = 1.15, 400
#: Samples by which references are found, the shortest reference and the longest.
_WINDOW, _SHORTEST, _LONGEST = 8, 12, 4096
#: Predictors and sizes of the colour cache that are weighed for each image.
_MODES, _CACHES = (1, 2, 7, 12), (2, 4)
#: An image leaves the plain form if another is estimated below this share of its bits and saves as many at least.
_WORTH, _SAVED = 0.95, 200
#: Bands of four rows between which a second group of prefix codes may begin; further rows belong to the last.
_BANDS = 4


class _Code:
    """Prefix codes of the coded channel and of distances, and the file head that announces them."""

    def __init__(self, counts: Sequence[int], distances: Sequence[int]):
        parts = [code_lengths(counts), code_lengths(distances)]
        writer = BitWriter()
        writer.write(1 | GREEN << 1, 3)
        writer.write(0, 3)  # no more transforms, no cache, one group
        for part in (parts[0], [1], [1], [0] * 255 + [1], parts[1]):
            write_code(writer, part)
        self.head, self.head_bits = writer.bits()
        self.codes = canonical(parts[0]) + canonical(parts[1])
        self.lengths = [size for part in parts for size in (part if sum(map(bool, part)) > 1 else [0] * len(part))]


def _shared_codes() -> list[_Code]:
    out = []
    for order in _ORDERS:
        rest = [byte for byte in (*range(0x80, 0xC0), *range(32, 127), *range(256)) if byte not in order]
        ranked = list(dict.fromkeys([*order, *rest]))
        counts = [0] * _ALPHABET
        for rank, byte in enumerate(ranked):
            counts[byte] = max(2, int(4000 * 2 ** (-rank / 6)))
        # Short references are common, long ones are not.
        counts[LITERALS:] = [2] * 6 + [200] * 4 + [20] * 4 + [2] * (LENGTHS - 14)
        # Distances grow up to the size of an image.
        out.append(_Code(counts, [1] * 12 + [2, 2, 4, 4, 8, 8, 16, 16, 16, 16, 8, 8, 8, 8] + [1] * (DISTANCES - 26)))
    return out


_SHARED = _shared_codes()
_SHARED_LENGTHS = np.array([code.lengths for code in _SHARED], np.float64).T


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`prefix_of` of many values."""
    less = values - 1
    high = np.frexp(np.maximum(less, 1).astype(float))[1] - 1
    more = np.maximum(high - 1, 0)
    small = values <= 4
    symbol = np.where(small, less, 2 * high + (less >> more & 1))
    return symbol, np.where(small, 0, less & (1 << more) - 1), np.where(small, 0, more)


def _references(samples: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(start, length, distance) of repeats inside each image, in order and without overlap.

    A place is matched with the last one before it that has the same window; places next to each other with the same distance
    make one reference, which is at least ``_SHORTEST`` samples long.
    """
    total = len(samples)
    window = np.ndarray((total,), "<u8", np.concatenate([samples, np.zeros(_WINDOW, np.uint8)]), 0, (1,)).copy()
    place = np.flatnonzero(ends[owner] - np.arange(total) >= _WINDOW)
    key = owner[place].astype(np.uint64) << np.uint64(40) | window[place] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
    order = np.argsort(key, kind="stable")
    place, key = place[order], key[order]
    same = np.flatnonzero((key[1:] == key[:-1]) & (window[place[1:]] == window[place[:-1]]))
    back = np.zeros(total + 1, np.int64)
    back[place[same + 1]] = place[same + 1] - place[same]
    change = np.flatnonzero(np.diff(back, prepend=0))
    size = np.diff(change, append=total) + _WINDOW - 1
    found = (back[change] > 0) & (size >= _SHORTEST)
    out, done = [], 0
    for start, length, distance in zip(change[found].tolist(), size[found].tolist(), back[change[found]].tolist(), strict=True):
        start, stop = max(start, done), start + length
        if stop - start >= _SHORTEST:
            out += [(at, min(_LONGEST, stop - at), distance) for at in range(start, stop, _LONGEST)]
            done = stop
    return np.array(out, np.int64).reshape(-1, 3)


def _uncovered(copies: np.ndarray, total: int) -> np.ndarray:
    """Places outside all references."""
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, copies[:, 0], 1)
    np.add.at(cover, copies[:, 0] + copies[:, 1], -1)
    return np.flatnonzero(np.cumsum(cover[:-1]) == 0)


def _entropy(owner: np.ndarray, symbols: np.ndarray, images: int, alphabet: int) -> np.ndarray:
    """Bits of each image's symbols under an ideal code of its own."""
    return _bits(np.bincount(owner * alphabet + symbols, minlength=alphabet * images).reshape(images, alphabet))


def _bits(held: np.ndarray) -> np.ndarray:
    total = np.maximum(held.sum(axis=1), 1)
    return total * np.log2(total) - (held * np.log2(np.maximum(held, 1))).sum(axis=1)


def _cached(symbols: np.ndarray, owner: np.ndarray, bits: int) -> np.ndarray:
    """Symbols with a colour cache: pixels that their slot holds become the slot's symbol."""
    grey = np.arange(LITERALS, dtype=np.int64)
    # What is cached is what is coded after subtract-green: opaque pixels with green only.
    slots = ((CACHE_FACTOR * (255 << 24 | grey << 8) & 0xFFFFFFFF) >> (32 - bits)).astype(np.int64)[symbols]
    key = owner << bits | slots
    # Keys of 16 bits are sorted by counting.
    key = key.astype(np.uint16) if int(owner[-1] + 1) << bits <= 1 << 16 else key
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    hit = np.zeros(len(symbols), bool)
    hit[order[1:]] = (ordered[1:] == ordered[:-1]) & (symbols[order[1:]] == symbols[order[:-1]])
    return np.where(hit, LITERALS + slots, symbols)


def _guessed(samples: np.ndarray, at: np.ndarray, width: int, mode: int) -> np.ndarray:
    """Residuals of many one-channel images under one predictor; ``at`` is the place in the image."""
    def before(count: int) -> np.ndarray:
        return np.concatenate([np.zeros(count, samples.dtype), samples[:-count]])[: len(samples)]

    left, top, corner = before(1), before(width), before(width + 1)
    guess = {1: left, 2: top, 7: left + top >> 1, 12: np.clip(left + top - corner, 0, 255)}[mode]
    guess = np.where(at < width, left, np.where(at % width == 0, top, guess))
    return samples - np.where(at == 0, 0, guess) & 0xFF


def _choices(symbols: np.ndarray, owner: np.ndarray, sizes: np.ndarray, width: int, literal: np.ndarray) -> dict[int, list[dict]]:
    """Forms other than the plain one that are worth trying, by image, from estimates of the bits of their literals.

    Estimated are the predictors, colour caches, a second group of prefix codes and, for at most sixteen colours, the palette,
    whose pixels share bytes.
    Cross-colour is not: after subtract-green a grey image has no red and blue to be predicted. More than sixteen colours
    leave a palette's indices with the entropy of the samples, so that only its table is added.
    """
    images = len(sizes)
    at = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    who, what, small = owner[literal], symbols[literal], symbols.astype(np.int16)
    held = np.bincount(owner * LITERALS + symbols, minlength=LITERALS * images).reshape(images, LITERALS)
    plain = _entropy(who, what, images, LITERALS)
    limit = np.minimum(plain * _WORTH, plain - _SAVED)
    out: dict[int, list[dict]] = {}

    def offer(numbers: np.ndarray, option) -> None:
        for number in np.flatnonzero(numbers).tolist():
            out.setdefault(number, []).append(option(number))

    offer(((held > 0).sum(axis=1) <= 16) & (plain > _SAVED), lambda _number: {"palette": True})
    for mode in _MODES:
        rest = _guessed(small, at, width, mode)[literal]
        offer(_entropy(who, rest, images, LITERALS) < limit, lambda _number, mode=mode: {"green": True, "predictor": (mode,), "cell_bits": 9})
    for bits in _CACHES:
        rest = _cached(symbols, owner, bits)[literal]
        offer(_entropy(who, rest, images, LITERALS + (1 << bits)) < limit, lambda _number, bits=bits: {"green": True, "cache_bits": bits})
    # Two groups of prefix codes, before and after a band of rows.
    band = who * _BANDS + np.minimum(at[literal] // width >> 2, _BANDS - 1)
    held = np.bincount(band * LITERALS + what, minlength=LITERALS * _BANDS * images).reshape(images, _BANDS, LITERALS)
    least, split = plain, np.zeros(images, np.int64)
    for place in range(1, _BANDS):
        parts = _bits(held[:, :place].sum(axis=1)) + _bits(held[:, place:].sum(axis=1))
        least, split = np.minimum(least, parts), np.where(parts < least, place, split)
    across = _cells(width, 2)

    def banded(number: int) -> dict:
        rows = np.arange(_cells(int(sizes[number]) // width, 2))
        return {"green": True, "group_bits": 2, "groups": np.repeat((rows >= split[number]).astype(int), across)}

    offer(least + _OWN_HEAD < limit, banded)
    return out


def encode_samples(images: Sequence[np.ndarray], width: int) -> list[bytes]:
    """Grey WebP files of one-channel images (flat arrays of whole rows), each in the smallest of the forms tried for it.

    The plain form is subtract-green, which leaves one coded channel, with back-references and the best of a few shared
    prefix codes, or codes of its own where they are clearly shorter; it is made for all images at once. Images for which
    :func:`_choices` expects less of another form are encoded by :func:`encode` as well.
    """
    if not images:
        return []
    sizes = np.array([len(image) for image in images])
    owner = np.repeat(np.arange(len(images)), sizes)
    samples = np.concatenate(images)
    symbols = samples.astype(np.int64)
    copies = _references(samples, owner, np.cumsum(sizes))
    literal = _uncovered(copies, len(samples))
    out = _plain_files(symbols, owner, sizes, width, copies, literal)
    for number, options in _choices(symbols, owner, sizes, width, literal).items():
        grey = images[number].reshape(-1, width)
        image = np.stack([np.full_like(grey, 255), grey, grey, grey], axis=-1)
        out[number] = min([out[number], *(encode(image, **option) for option in options)], key=len)
    return out


def _plain_files(
    symbols: np.ndarray, owner: np.ndarray, sizes: np.ndarray, width: int, copies: np.ndarray, literal: np.ndarray
) -> list[bytes]:
    images = len(sizes)
    start, length, distance = copies.T
    near = {distance_of(code, width): code for code in range(len(NEAR), 0, -1)}
    known = np.zeros(int(distance.max(initial=0)) + 1, np.int64)
    for value, code in near.items():
        if value < len(known):
            known[value] = code
    coded = np.where(known[distance] > 0, known[distance], distance + len(NEAR))
    (size_symbol, size_extra, size_bits), (far_symbol, far_extra, far_bits) = _prefixes(length), _prefixes(coded)
    # Items in the order of the stream: a literal is one, a reference four (length, its extra bits, distance, its extra bits).
    weight = np.zeros(len(symbols), np.int64)
    weight[literal], weight[start] = 1, 4
    first = np.cumsum(weight) - weight
    kept, copier = owner[literal], owner[start]
    total = _ALPHABET + DISTANCES
    held = np.bincount(
        np.concatenate([kept * total + symbols[literal], copier * total + LITERALS + size_symbol, copier * total + _ALPHABET + far_symbol]),
        minlength=total * images,
    ).reshape(images, total)
    shared = held @ _SHARED_LENGTHS
    choice = shared.argmin(axis=1)
    least = _bits(held[:, :_ALPHABET]) + _bits(held[:, _ALPHABET:])
    codes = list(_SHARED)
    for number in np.flatnonzero(shared.min(axis=1) > _TOLERANCE * least + _OWN_HEAD).tolist():
        choice[number] = len(codes)
        mine = held[number].tolist()
        codes.append(_Code(mine[:_ALPHABET], mine[_ALPHABET:]))
    code = np.array([c.codes for c in codes], np.int64).reshape(-1)
    size = np.array([c.lengths for c in codes], np.int64).reshape(-1)
    items = int(weight.sum())
    value, bits = np.zeros(items, np.int64), np.zeros(items, np.int64)
    for place, who, symbol in ((literal, kept, symbols[literal]), (start, copier, LITERALS + size_symbol)):
        slot = choice[who] * total + symbol
        value[first[place]], bits[first[place]] = code[slot], size[slot]
    slot = choice[copier] * total + _ALPHABET + far_symbol
    for more, (values, widths) in enumerate(((size_extra, size_bits), (code[slot], size[slot]), (far_extra, far_bits)), 1):
        value[first[start] + more], bits[first[start] + more] = values, widths
    # The code of a single symbol is empty.
    value = np.where(bits > 0, value, 0).astype(np.uint64)
    holder = np.repeat(owner, weight)
    ends = np.cumsum(bits)
    until = np.concatenate([[0], ends])[np.cumsum(np.bincount(holder, minlength=images))]
    before = np.concatenate([[0], until[:-1]])
    starts = []
    heads: dict[tuple[int, int], tuple[int, int]] = {}
    for number in range(images):
        key = (int(choice[number]), int(sizes[number]) // width)
        if key not in heads:
            writer = BitWriter()
            _begin(writer, width, key[1], False)
            opening, at = writer.bits()
            heads[key] = (opening | codes[key[0]].head << at, at + codes[key[0]].head_bits)
        starts.append(heads[key])
    begin = np.array([at for _value, at in starts])
    # Every image begins at a word of its own.
    room = (begin + (until - before) + 127) // 32
    base = np.concatenate([[0], np.cumsum(room)])
    at = ends - bits + (32 * base[:-1] + begin - before)[holder]
    value = value << (at & 31).astype(np.uint64)
    # Bits of different symbols never overlap, so sums stand for unions.
    words = np.bincount(at >> 5, (value & np.uint64(0xFFFFFFFF)).astype(float), int(base[-1]) + 1)
    words += np.bincount((at >> 5) + 1, (value >> np.uint64(32)).astype(float), int(base[-1]) + 1)
    raw = words.astype(np.uint32).tobytes()
    out = []
    for number, (head, size_of_head) in enumerate(starts):
        end = size_of_head + int(until[number] - before[number])
        body = int.from_bytes(raw[4 * int(base[number]) : 4 * int(base[number + 1])], "little") | head
        out.append(file_of(body.to_bytes(4 * int(room[number]), "little")[: -(-end // 8)]))
    return out


class _Heads:
    """Parsed file heads; files with the same head share their tables."""

    def __init__(self):
        self.known: dict[bytes, list[tuple[int, int, list[Lookup]]]] = {}

    def parse(self, chunk: bytes) -> tuple[int, list[Lookup]] | None:
        """Bits of the head after width and height, and the prefix codes; None unless one channel is coded."""
        front = int.from_bytes(chunk[5:405], "little")
        mark = chunk[5:21]
        for bits, value, codes in self.known.get(mark, ()):
            if front & (1 << bits) - 1 == value:
                return bits, codes
        reader = BitReader(chunk[5:1205])
        if reader.read(3) != (1 | GREEN << 1) or reader.read(3):
            return None
        codes = [Lookup(read_code(reader, size)) for size in (_ALPHABET, 256, 256, 256, DISTANCES)]
        if [code.single for code in codes[1:4]] != [0, 0, 255]:
            return None
        if reader.at <= 3200:
            self.known.setdefault(mark, []).append((reader.at, front & (1 << reader.at) - 1, codes))
        return reader.at, codes


def _pairs(table: np.ndarray, bits: int) -> np.ndarray:
    """Entries of up to two pixels: first | second << 9 | number << 18 | bits << 20.

    The second is left for the next step where it does not fit or is not a pixel, or the first is not.
    """
    first, size = table & 0xFFFF, table >> 16
    if bits == 0:
        return first | 1 << 18
    after = table[np.arange(len(table)) >> size]
    second, more = after & 0xFFFF, after >> 16
    both = (first < LITERALS) & (second < LITERALS) & (size + more <= bits)
    return np.where(both, first | second << 9 | 2 << 18 | size + more << 20, first | 1 << 18 | size << 20)


def decode_samples(files: Sequence[bytes]) -> list[np.ndarray]:
    """Samples (the green channel) of many files, as flat arrays."""
    heads, out = _Heads(), [np.empty(0, np.uint8)] * len(files)
    lanes = []
    for number, file in enumerate(files):
        chunk = chunk_of(file)
        width, height = _read_head(BitReader(chunk[:5]))
        found = heads.parse(chunk)
        if found:
            lanes.append((width * height, number, chunk, 40 + found[0], found[1], width))
        else:
            out[number] = decode(file)[..., 2].reshape(-1)
    if not lanes:
        return out
    lanes.sort(key=lambda lane: -lane[0])
    sizes = np.array([lane[0] for lane in lanes])
    every = 64
    first = np.concatenate([[0], np.cumsum(sizes + 2 * every + 2)])
    pixels = np.zeros(int(first[-1]), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(lane[2]) for lane in lanes])])
    data = np.frombuffer(b"".join(lane[2] for lane in lanes) + bytes(16), np.uint8)
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).copy()
    tables, places, filled = [], {}, 0
    for lane in lanes:
        lookup = lane[4][0]
        if id(lookup) not in places:
            tables.append(_pairs(lookup.table, lookup.bits))
            places[id(lookup)] = filled
            filled += len(lookup.table)
    table = np.concatenate(tables)
    base = np.array([places[id(lane[4][0])] for lane in lanes])
    mask = np.array([(1 << lane[4][0].bits) - 1 for lane in lanes], np.uint64)
    at = 8 * offsets[:-1] + np.array([lane[3] for lane in lanes])
    to, which, limit = first[:-1].copy(), np.arange(len(lanes)), len(words) - 1
    end = first[:-1] + sizes
    while len(which):
        for _ in range(every):
            word = words[np.minimum(at >> 3, limit)] >> (at & 7).astype(np.uint64)
            entry = table[base + (word & mask).astype(np.int64)]
            symbol = entry & 0x1FF
            pixels[to] = symbol
            pixels[to + 1] = entry >> 9 & 0x1FF
            to = to + (entry >> 18 & 3)
            at = at + (entry >> 20)
            if (symbol >= LITERALS).any():
                for place in np.flatnonzero(symbol >= LITERALS).tolist():
                    start, lane = int(to[place]) - 1, lanes[which[place]]
                    if start >= end[place]:
                        to[place] = end[place]
                        continue
                    reader = ChunkReader(lane[2], int(at[place] - 8 * offsets[which[place]]))
                    length = value_of(int(symbol[place]) - LITERALS, reader)
                    back = distance_of(value_of(lane[4][4].read(reader), reader), lane[5])
                    if start - back < first[which[place]] or start + length > end[place]:
                        raise ValueError("a back-reference leaves the image")
                    if back == 1:
                        pixels[start : start + length] = pixels[start - 1]
                    else:
                        pixels[start : start + length] = np.resize(pixels[start - back : start], length)
                    at[place] = reader.at + 8 * offsets[which[place]]
                    to[place] = start + length
        # Lanes past their end have written into the room behind it only; they leave.
        live = to < end
        if not live.all():
            at, to, which, base, mask, end = at[live], to[live], which[live], base[live], mask[live], end[live]
    for place, lane in enumerate(lanes):
        out[lane[1]] = pixels[first[place] : first[place] + sizes[place]]
    return out
