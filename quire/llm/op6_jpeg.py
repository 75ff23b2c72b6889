"""Media columns: baseline JPEG, written, parsed, Huffman-decoded and reduced to a DC-only luminance thumbnail.

Payload bytes are kept losslessly as quantised coefficients, 64 to a block and three blocks (Y, Cb, Cr) to a
minimum coded unit of 192 bytes. A byte less 32 is the coefficient, as a signed number, so spaces are zeros: they become
run lengths, and padding the end of a block. Code words come from Huffman tables made for running text. Each unit is a restart
interval: DC prediction starts anew, intervals decode apart, and an interval damaged or lost hurts no other.

The decoder is general for baseline sequential files (8-bit, any Huffman tables, any run lengths, one scan,
sampling 1x1 in each component): it parses markers, takes out stuffing, and decodes all restart intervals of
all images of a batch side by side, one symbol of each a step, in numpy. The luminance thumbnail is the DC
coefficient of each Y block, dequantised; its hash compares neighbours of an 8 x 9 reduction to means.

Defined cases: a null or empty text is one unit of spaces; very long texts take more columns of units; repeated rows give
equal values, and rows without an id are rows like others; files are made from the payload alone, so equal texts have equal
values; neighbours of equal mean are not darker; a corrupt file raises ValueError; an empty table gives an empty result;
further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quire.llm.common import map_rows

UNIT = 192
MOST_SIDE = 65535 // 8

# The zigzag order of a block's coefficients, and the standard's markers.
ZIGZAG = (0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63)
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, COM, RST0 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE, 0xD0


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def shape(units: int) -> tuple[int, int]:
    """(columns, rows) of units: one column while a side can hold it; the last row may be filled up."""
    columns = -(-units // MOST_SIDE)
    return columns, -(-units // columns)


def padded(data: bytes) -> bytes:
    return data + b" " * ((-len(data)) % UNIT if data else UNIT)


def code_lengths(weights: dict[int, float]) -> tuple[bytes, bytes]:
    """(how many code words of each length, symbols by length): a Huffman code of at most 16 bits, all ones left out."""
    heap = [(w, i, [s]) for i, (s, w) in enumerate(sorted(weights.items()))] + [(0.0, 1 << 20, [-1])]  # the least weight gets all ones
    heapq.heapify(heap)
    depth = dict.fromkeys([-1, *weights], 0)
    while len(heap) > 1:
        (w1, i, one), (w2, _, two) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (both := one + two):
            depth[s] += 1
        heapq.heappush(heap, (w1 + w2, i, both))
    del depth[-1]
    symbols = sorted(depth, key=lambda s: (depth[s], s))
    assert depth[symbols[-1]] <= 16
    return bytes(sum(d == n for d in depth.values()) for n in range(1, 17)), bytes(symbols)


def code_words(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code word, length) by symbol."""
    words, sizes, code, at = np.zeros(256, np.uint64), np.zeros(256, np.int64), 0, 0
    for size in range(1, 17):
        for _ in range(table[0][size - 1]):
            words[table[1][at]], sizes[table[1][at]] = code, size
            code, at = code + 1, at + 1
        code <<= 1
    return words, sizes


# How often a magnitude category occurs in text less 32 (letters have category 7), and how runs of zeros fall off.
CATEGORIES = {1: 2.0, 2: 2.0, 3: 6.0, 4: 12.0, 5: 12.0, 6: 40.0, 7: 800.0, 8: 24.0}
END_OF_BLOCK, LONG_RUN = 0x00, 0xF0
DC_TABLE = code_lengths({0: 100.0} | CATEGORIES)
AC_TABLE = code_lengths({END_OF_BLOCK: 8.0, LONG_RUN: 0.1} | {run << 4 | size: max(0.02, w * 0.15 ** min(run, 5)) for run in range(16) for size, w in CATEGORIES.items()})
(DC_WORDS, DC_SIZES), (AC_WORDS, AC_SIZES) = code_words(DC_TABLE), code_words(AC_TABLE)
CATEGORY = np.array([abs(v).bit_length() for v in range(-128, 128)])


def _headers(units: int, columns: int, rows: int) -> bytes:
    return b"".join(
        [
            bytes([0xFF, SOI]),
            _segment(COM, b"units %d" % units),
            _segment(DQT, bytes([0]) + bytes([1] * 64)),
            _segment(SOF0, bytes([8]) + (rows * 8).to_bytes(2, "big") + (columns * 8).to_bytes(2, "big") + bytes([3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])),
            _segment(DHT, bytes([0x00]) + DC_TABLE[0] + DC_TABLE[1] + bytes([0x10]) + AC_TABLE[0] + AC_TABLE[1]),
            _segment(DRI, (1).to_bytes(2, "big")),
            _segment(SOS, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
        ]
    )


def entropy_coded(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, how many each unit has) of units of 192 payload bytes, without stuffing and markers."""
    values = (raw - np.uint8(32)).view(np.int8)
    coded = values != 0
    coded[::64] = True  # a block's first coefficient has a code word of its own
    at = np.flatnonzero(coded)
    value, first = values[at].astype(np.int64), at % 64 == 0
    run = np.diff(at, prepend=0) - 1
    run[first] = 0
    size = CATEGORY[value + 128]
    symbol = (run % 16) << 4 | size
    words, sizes = np.where(first, DC_WORDS[size], AC_WORDS[symbol]), np.where(first, DC_SIZES[size], AC_SIZES[symbol])
    bits = sizes + size
    words = words << size.astype(np.uint64) | np.where(value < 0, value + (1 << size) - 1, value).astype(np.uint64)
    # long runs before, ends of blocks after
    long, last = run // 16, np.append(first[1:], True)
    end = last & (at % 64 < 63)
    place = np.arange(len(at)) + np.cumsum(long) + np.cumsum(end) - end
    total = len(at) + int(long.sum()) + int(end.sum())
    all_words, all_bits = np.full(total, AC_WORDS[LONG_RUN]), np.full(total, AC_SIZES[LONG_RUN])
    all_words[place], all_bits[place] = words, bits
    all_words[place[end] + 1], all_bits[place[end] + 1] = AC_WORDS[END_OF_BLOCK], AC_SIZES[END_OF_BLOCK]
    # units start at whole bytes and are filled up with ones
    ends = np.flatnonzero(last)[2::3]
    ends = place[ends] + end[ends] + 1
    done = np.concatenate(([0], np.cumsum(all_bits)))
    unit_bits = np.diff(done[ends], prepend=0)
    unit_bytes = -(-unit_bits // 8)
    starts = 8 * (np.cumsum(unit_bytes) - unit_bytes)
    counts = np.diff(ends, prepend=0)
    bit = done[:-1] + np.repeat(starts - done[ends - counts], counts)
    fill = 8 * unit_bytes - unit_bits
    bit, all_bits = np.concatenate((bit, starts + unit_bits)), np.concatenate((all_bits, fill))
    all_words = np.concatenate((all_words, (np.uint64(1) << fill.astype(np.uint64)) - np.uint64(1)))
    # 32-bit words; their bits don't meet, so sums in doubles are exact
    shifted = all_words << (64 - (bit & 31) - all_bits).astype(np.uint64)
    n = int(unit_bytes.sum()) // 4 + 2
    packed = np.bincount(bit >> 5, shifted >> np.uint64(32), n) + np.bincount((bit >> 5) + 1, shifted & np.uint64(0xFFFFFFFF), n)
    return packed.astype(">u4").view(np.uint8)[: int(unit_bytes.sum())], unit_bytes


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A JPEG of each payload, whose size is a positive multiple of 192; the number of its units stands in a comment."""
    if not payloads:
        return []
    own = np.array([len(p) // UNIT for p in payloads])
    shapes = [shape(n) for n in own.tolist()]
    units = np.array([columns * rows for columns, rows in shapes])
    raw = np.frombuffer(b"".join(p + b" " * (int(n) * UNIT - len(p)) for p, n in zip(payloads, units)), np.uint8)
    flat, sizes = entropy_coded(raw)
    # stuff a zero after each FF, and a restart marker after each unit but a file's last
    number = np.arange(len(sizes)) - np.repeat(np.cumsum(units) - units, units)
    marked = number < np.repeat(units, units) - 1
    full = flat == 0xFF
    place = np.arange(len(flat)) + np.cumsum(full) - full + np.repeat(2 * (np.cumsum(marked) - marked), sizes)
    ends = place[np.cumsum(sizes) - 1] + full[np.cumsum(sizes) - 1] + 1
    out = np.zeros(int(ends[-1]), np.uint8)
    out[place] = flat
    out[ends[marked]] = 0xFF
    out[ends[marked] + 1] = RST0 + number[marked] % 8
    stops = ends[np.cumsum(units) - 1].tolist()
    return [_headers(n, *s) + out[a:b].tobytes() + bytes([0xFF, EOI]) for n, s, a, b in zip(own.tolist(), shapes, [0, *stops], stops)]


def encode(payload: bytes) -> bytes:
    return encode_many([payload])[0]


def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit window: length << 8 | symbol of the code word it starts with; 0 where none does."""
    table, code, at = np.zeros(1 << 16, np.uint16), 0, 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            low = code << (16 - size)
            table[low : low + (1 << (16 - size))] = size << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def parse(data: bytes) -> dict:
    """The file's headers, and its scan as (data without stuffing, start of each interval)."""
    found = {"quant": {}, "huffman": {}, "restart": 0, "comment": b""}
    if data[:2] != bytes([0xFF, SOI]):
        raise ValueError("no start of image")
    at = 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == DQT:
            while body:
                wide = 2 if body[0] >> 4 else 1
                found["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8)
                body = body[1 + 64 * wide :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                found["huffman"][body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == SOF0:
            found |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "components": [(body[6 + 3 * i], body[7 + 3 * i], body[8 + 3 * i]) for i in range(body[5])]}
            if body[0] != 8 or any(s != 0x11 for _, s, _ in found["components"]):
                raise ValueError("only 8-bit samples, each component at full size")
        elif marker == DRI:
            found["restart"] = int.from_bytes(body, "big")
        elif marker == COM:
            found["comment"] = body
        elif marker == SOS:
            found["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            break
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("not a baseline file")
    raw = np.frombuffer(data, np.uint8)[at:]
    full = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[full + 1]
    end = full[after == EOI][0]
    full, after = full[full < end], after[full < end]
    marks = full[(after >= RST0) & (after < RST0 + 8)]
    drop = np.concatenate((full[after == 0] + 1, marks, marks + 1))
    keep = np.ones(end, bool)
    keep[drop] = False
    starts = np.concatenate(([0], marks + 2))
    kept_before = np.concatenate(([0], np.cumsum(keep)))
    found["data"], found["starts"] = raw[:end][keep], kept_before[starts]
    return found


#: Intervals decoded side by side at most.
LANES = 1 << 14


def decode_many(files: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """(headers, quantised coefficients as units x components x 64 in zigzag order) of each file."""
    parsed = [parse(f) for f in files]
    tables: dict[tuple[bytes, bytes], int] = {}
    number = lambda t: tables.setdefault((bytes(t[0]), bytes(t[1])), len(tables))
    out, lanes = [], []
    for i, p in enumerate(parsed):
        units = -(-p["width"] // 8) * -(-p["height"] // 8)
        kinds = len(p["scan"])
        step = p["restart"] or units
        p["tables"] = [(number(p["huffman"][dc]), number(p["huffman"][0x10 | ac])) for _, dc, ac in p["scan"]]
        out.append(np.zeros((units, kinds, 64), np.int16))
        n = len(p["starts"])
        if n != -(-units // step):
            raise ValueError("restart intervals are missing")
        lanes.append((np.full(n, i), p["starts"], np.minimum(step, units - step * np.arange(n)), step * np.arange(n)))
    if not files:
        return []
    luts = np.concatenate([lookup(*t) for t in tables])
    most = max(len(p["scan"]) for p in parsed)
    which = np.zeros((len(files), most, 2), np.int64)
    for i, p in enumerate(parsed):
        which[i, : len(p["scan"])] = p["tables"]
    kinds = np.array([len(p["scan"]) for p in parsed])
    base = np.concatenate(([0], np.cumsum([len(p["data"]) + 8 for p in parsed])))
    stream = np.concatenate([np.concatenate((p["data"], np.full(8, 0xFF, np.uint8))) for p in parsed]).astype(np.uint32)
    window = np.zeros(len(stream), np.uint32)
    window[:-3] = stream[:-3] << np.uint32(24) | stream[1:-2] << np.uint32(16) | stream[2:-1] << np.uint32(8) | stream[3:]
    place = np.concatenate(([0], np.cumsum([o.size for o in out])))
    target = np.zeros(place[-1], np.int16)
    image, start, units, first = (np.concatenate([x[k] for x in lanes]) for k in range(4))
    for at in range(0, len(image), LANES):
        part = slice(at, at + LANES)
        _lanes(window, luts, which, kinds[image[part]], image[part], (base[image[part]] + start[part]) * 8, units[part], place[image[part]] + first[part] * kinds[image[part]] * 64, target)
    return [(p, target[a:b].reshape(o.shape)) for p, o, a, b in zip(parsed, out, place[:-1], place[1:])]


def _lanes(window, luts, which, kinds, image, bit, units, place, target) -> None:
    """Decodes one interval a lane, a symbol a step; coefficients go to target from place on."""
    live = np.arange(len(image))
    blocks = units * kinds
    block, k = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    before = np.zeros((len(live), which.shape[1]), np.int64)
    while len(live):
        part = block[live] % kinds[live]
        now, own = k[live], bit[live]
        dc = now == 0
        table = which[image[live], part, (~dc).astype(np.int64)]
        code = (window[own >> 3] << (own & 7).astype(np.uint32)) >> np.uint32(16)
        got = luts[(table << 16) + code].astype(np.int64)
        size, symbol = got >> 8, got & 255
        if not size.all():
            raise ValueError("no code word")
        own = own + size
        run, bits = np.where(dc, 0, symbol >> 4), np.where(dc, symbol, symbol & 15)
        extra = ((window[own >> 3] << (own & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64) >> (16 - bits)
        value = np.where(bits > 0, np.where(extra < (1 << np.maximum(bits, 1) - 1), extra - (1 << bits) + 1, extra), 0)
        bit[live] = own + bits
        stop = ~dc & (symbol == 0)  # end of block
        to = np.minimum(now + run, 63)
        if dc.any():
            who = live[dc]
            before[who, part[dc]] += value[dc]
            value[dc] = before[who, part[dc]]
        some = (bits > 0) | dc
        target[place[live[some]] + block[live[some]] * 64 + to[some]] = value[some]
        ahead = np.where(stop, 64, to + 1)
        done = ahead > 63
        k[live] = np.where(done, 0, ahead)
        block[live] += done
        live = live[block[live] < blocks[live]]


def payload_of(headers: dict, coefficients: np.ndarray) -> bytes:
    """The stored bytes: coefficients and 32."""
    units = int(headers["comment"].split()[1])
    return ((coefficients[:units].reshape(-1) + 32) & 255).astype(np.uint8).tobytes()


def thumbnail(headers: dict, coefficients: np.ndarray) -> np.ndarray:
    """DC-only luminance: each Y block's mean sample, 0 to 255, as rows x columns."""
    quant = int(headers["quant"][headers["components"][0][2]][0])
    rows, columns = -(-headers["height"] // 8), -(-headers["width"] // 8)
    return np.clip(coefficients[:, 0, 0].astype(np.int64) * quant // 8 + 128, 0, 255).reshape(rows, columns)


def thumbnail_hash(small: np.ndarray) -> str:
    """64 bits: in an 8 x 9 reduction, by means, of the thumbnail read as a strip, whether each cell is darker than the next."""
    flat = small.reshape(-1)
    sums = np.concatenate(([0], np.cumsum(flat)))
    cells = np.diff(np.interp(np.arange(73) * len(flat) / 72, np.arange(len(sums)), sums)).reshape(8, 9)
    return np.packbits(cells[:, :-1] < cells[:, 1:] - 1e-6).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """doc_id and the media columns of each text, all read back from the stored form."""
    own = docs.select("doc_id").schema["doc_id"]
    long, text = LongType(), StringType()
    schema = StructType([own, *[StructField(n, t) for n, t in (("n_bytes", long), ("payload_bytes", long), ("payload_sha256", text), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", text), ("width", long), ("height", long), ("feature", text))]])

    def run(ids, texts):
        sizes = [len(t.encode()) if t else 0 for t in texts]
        files = encode_many([padded(t.encode() if t else b"") for t in texts])
        out = {f.name: [] for f in schema} | {own.name: ids, "n_bytes": sizes}
        for data, (headers, coefficients) in zip(files, decode_many(files)):
            payload = payload_of(headers, coefficients)
            small = thumbnail(headers, coefficients)
            for name, value in (("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-16:])), ("media_bytes", len(data)), ("media_sha256", hashlib.sha256(data).hexdigest()), ("width", headers["width"]), ("height", headers["height"]), ("feature", f"{headers['width']}x{headers['height']}:{thumbnail_hash(small)}:{int(small.mean())}")):
                out[name].append(value)
        return out

    return map_rows(docs, ["doc_id", "text"], run, schema, size=2048, text_bytes=1 << 20)


def query(docs: DataFrame) -> DataFrame:
    return store(docs)
