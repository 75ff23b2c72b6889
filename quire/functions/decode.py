"""Bytes to text and back: detection, single-byte tables and Unicode forms.

Detection is a chain of native expressions where Spark has the codec; what it lacks (UTF-32 variants, malformed
UTF-16 units, the zero-byte sniff) runs as Arrow batches on those rows only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte order marks, the longer first where one starts another.
MARKS = (("utf-32le", b"\xff\xfe\x00\x00"), ("utf-32be", b"\x00\x00\xfe\xff"), ("utf-16le", b"\xff\xfe"), ("utf-16be", b"\xfe\xff"), ("utf-8", b"\xef\xbb\xbf"))
RANKS = {"utf-8": 0, "latin-1": 1, "cp1252": 1, "cp1251": 1, "cp1253": 1, "koi8-r": 1, "utf-16le": 2, "utf-16be": 2, "utf-32le": 2, "utf-32be": 2}
SINGLE = {"latin-1": "latin-1", "cp1252": "cp1252", "cp1251": "cp1251", "cp1253": "cp1253", "koi8-r": "koi8_r"}
WINDOW = 4096


def high_half(name: str) -> str:
    """The 128 characters of bytes 80 to FF; a byte without a character stands for itself, as in Latin-1."""
    out = []
    for b in range(128, 256):
        char = bytes([b]).decode(SINGLE[name], "replace")
        out.append(chr(b) if char == "�" else char)
    return "".join(out)


def decode_single(content: Column, name: str) -> Column:
    """A single-byte encoding, natively: as Latin-1, then the upper half by its table."""
    text = F.decode(content, "ISO-8859-1")
    low = "".join(map(chr, range(128, 256)))
    return text if name == "latin-1" else F.translate(text, low, high_half(name))


def mark_of(content: Column) -> Column:
    """The encoding that a byte order mark names; null if there is none."""
    found = None
    for name, mark in MARKS:
        test = F.substring(content, 1, len(mark)) == F.lit(mark)
        found = F.when(test, name) if found is None else found.when(test, name)
    return found


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def wide_by_zeros(data: bytes) -> str | None:
    """UTF-16 by its zero bytes: over an eighth of one side, and over four times the other's."""
    sample = data[:WINDOW]
    if len(sample) < 8:
        return None
    even, odd = sample[::2], sample[1::2]
    zeros = even.count(0), odd.count(0)
    if zeros[0] * 8 > len(even) and zeros[0] > 4 * zeros[1]:
        return "utf-16be"
    if zeros[1] * 8 > len(odd) and zeros[1] > 4 * zeros[0]:
        return "utf-16le"
    return None


def units(data: bytes, name: str) -> str:
    """Wide units to text: a trailing fragment goes, each unit that is no character by itself or in a pair becomes U+FFFD."""
    wide = 4 if "32" in name else 2
    data = data[: len(data) - len(data) % wide]
    if wide == 2:
        text = data.decode(name, "surrogatepass") if _paired(data, name) else _by_unit(data, name)
        return "".join("�" if "\ud800" <= c <= "\udfff" else c for c in text)
    order = "little" if name.endswith("le") else "big"
    codes = (int.from_bytes(data[i : i + 4], order) for i in range(0, len(data), 4))
    return "".join("�" if c > 0x10FFFF or 0xD800 <= c <= 0xDFFF else chr(c) for c in codes)


def _paired(data: bytes, name: str) -> bool:
    try:
        data.decode(name)
    except UnicodeDecodeError:
        return False
    return True


def _by_unit(data: bytes, name: str) -> str:
    order = "little" if name.endswith("le") else "big"
    codes = [int.from_bytes(data[i : i + 2], order) for i in range(0, len(data), 2)]
    out, i = [], 0
    while i < len(codes):
        pair = codes[i : i + 2]
        if len(pair) == 2 and 0xD800 <= pair[0] < 0xDC00 <= pair[1] < 0xE000:
            out.append(chr(0x10000 + ((pair[0] - 0xD800) << 10) + pair[1] - 0xDC00))
            i += 2
        else:
            out.append("�" if 0xD800 <= pair[0] < 0xE000 else chr(pair[0]))
            i += 1
    return "".join(out)


def decode_bytes(data: bytes, encoding: str = "auto") -> tuple[str, str]:
    """(text, the encoding it was read in)."""
    mark = next(((n, len(m)) for n, m in MARKS if data.startswith(m)), None)
    if encoding == "auto":
        if mark and mark[0] != "utf-8":
            return units(data[mark[1] :], mark[0]), mark[0]
        if wide := wide_by_zeros(data):
            return units(data, wide), wide
        try:
            return data.decode(), "utf-8"
        except UnicodeDecodeError:
            encoding = "cp1252"
    if encoding == "utf-8":
        return data.decode("utf-8", "replace"), "utf-8"
    if encoding in SINGLE:
        return data.decode("latin-1").translate(dict(zip(range(128, 256), high_half(encoding)))), encoding
    return units(data[mark[1] if mark else 0 :], encoding), encoding


def is_plain(content: Column) -> Column:
    """Valid UTF-8 without a zero byte: whatever detection looks at, it is UTF-8."""
    return is_utf8(content) & (F.instr(content.cast("string"), "\0") == 0)


def decode(content: Column, encoding: str = "auto") -> Column:
    """struct(text, encoding) of bytes. UTF-8 and single-byte encodings stay in the JVM; of other rows the bytes go through Arrow."""
    if encoding in SINGLE:
        return F.struct(decode_single(content, encoding).alias("text"), F.lit(encoding).alias("encoding"))

    @F.pandas_udf("struct<text string, encoding string>")
    def decoded(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_bytes(bytes(c), encoding) if c is not None else (None, None) for c in contents], columns=["text", "encoding"])

    if encoding not in ("auto", "utf-8"):
        return decoded(content)
    plain = is_plain(content) if encoding == "auto" else is_utf8(content)
    text = F.struct(content.cast("string").alias("text"), F.lit("utf-8").alias("encoding"))
    return F.when(plain, text).otherwise(decoded(F.when(~plain, content)))


class EncodeError(ValueError):
    """A character that the encoding lacks, with its place."""


def encode_text(text: str, encoding: str) -> bytes:
    """The text in an encoding, wide ones with their mark; EncodeError names the first character that doesn't fit."""
    if encoding in ("auto", "utf-8"):
        return text.encode()
    if encoding in SINGLE:
        back = {c: b for b, c in enumerate(high_half(encoding), 128)} | {chr(b): b for b in range(128)}
        for i, c in enumerate(text):
            if c not in back:
                raise EncodeError(f"{c!r} at {i} isn't in {encoding}")
        return bytes(back[c] for c in text)
    return dict(MARKS)[encoding] + text.encode(encoding)


def representable(text: Column, encoding: str) -> Column:
    """Whether a single-byte encoding has every character of the text."""
    return F.translate(text, "".join(map(chr, range(1, 128))) + high_half(encoding), "") == ""
