"""Byte formats without SQL built-ins: Arrow UDFs over whole batches, and the plain functions behind them."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The reversed Castagnoli polynomial, the mask of stored checksums and the generator's constants.
CASTAGNOLI = 0x82F63B78
MASK_DELTA = 0xA282EAD8
LCG_FACTOR, LCG_MODULUS = 16807, 2147483647


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(CASTAGNOLI), t >> 1)
    return t


TABLE = _table()
_STEPS = TABLE.tolist()


def crc32c(data: bytes, crc: int = 0) -> int:
    """Castagnoli checksum of data, continuing from that of what precedes it."""
    crc ^= 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ _STEPS[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF


#: Bytes of a chunk whose checksums are worked out side by side.
CHUNK = 1024


def _moved() -> list[np.ndarray]:
    """What each byte of a checksum's register becomes CHUNK bytes later: the register is linear in its bits."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(CHUNK):
        bits = bits >> np.uint32(8) ^ TABLE[bits & np.uint32(255)]
    out = []
    for k in range(4):
        byte = np.arange(256, dtype=np.uint32)
        out.append(np.bitwise_xor.reduce([np.where(byte >> np.uint32(i) & np.uint32(1), bits[8 * k + i], np.uint32(0)) for i in range(8)]))
    return out


MOVED = _moved()


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """crc32c of many values at once, each cut into chunks (the first one is the short one) that all go side by side."""
    if not values:
        return np.zeros(0, np.uint32)
    size = np.array([len(v) for v in values], np.int64)
    n = np.maximum(1, -(-size // CHUNK))
    owner, first = np.repeat(np.arange(len(values)), n), np.r_[0, np.cumsum(n)[:-1]]
    nth = np.arange(len(owner)) - first[owner]
    short = size - (n - 1) * CHUNK
    start = np.r_[0, np.cumsum(size)[:-1]][owner] + np.where(nth > 0, short[owner] + (nth - 1) * CHUNK, 0)
    long = np.where(nth > 0, CHUNK, short[owner])
    crc = np.where(nth > 0, 0, 0xFFFFFFFF).astype(np.uint32)
    data = np.frombuffer(b"".join(values), np.uint8)
    order = np.argsort(-long, kind="stable")
    live = len(order)
    for i in range(int(long.max(initial=0))):
        while live and long[order[live - 1]] <= i:
            live -= 1
        at = order[:live]
        crc[at] = crc[at] >> np.uint32(8) ^ TABLE[(crc[at] ^ data[start[at] + i]) & 255]
    out, todo = crc[first], np.flatnonzero(n > 1)
    for k in range(1, int(n.max())):
        todo = todo[n[todo] > k]
        r = out[todo]
        out[todo] = MOVED[0][r & np.uint32(255)] ^ MOVED[1][r >> np.uint32(8) & np.uint32(255)] ^ MOVED[2][r >> np.uint32(16) & np.uint32(255)] ^ MOVED[3][r >> np.uint32(24)] ^ crc[first[todo] + k]
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def unmasked(stored: int) -> int:
    r = stored - MASK_DELTA & 0xFFFFFFFF
    return (r >> 17 | r << 15) & 0xFFFFFFFF


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def get_varint(data: bytes, at: int = 0, most: int = 10) -> tuple[int, int] | None:
    """Number and where it ends; None if it is cut off or longer than `most` bytes."""
    n = 0
    for i in range(most):
        if at + i >= len(data):
            return None
        n |= (data[at + i] & 127) << 7 * i
        if data[at + i] < 128:
            return n, at + i + 1
    return None


def put_slice(data: bytes) -> bytes:
    return put_varint(len(data)) + data


def get_slice(data: bytes, at: int = 0) -> tuple[bytes, int] | None:
    found = get_varint(data, at, 5)
    if found is None or found[1] + found[0] > len(data):
        return None
    n, at = found
    return data[at : at + n], at + n


def separator(start: bytes, limit: bytes) -> bytes:
    """A short string s with start <= s < limit, if start < limit; else start."""
    same = 0
    while same < min(len(start), len(limit)) and start[same] == limit[same]:
        same += 1
    if same < min(len(start), len(limit)) and start[same] < 255 and start[same] + 1 < limit[same]:
        return start[:same] + bytes([start[same] + 1])
    return start


def successor(key: bytes) -> bytes:
    """A short string that is no less than the key; the key itself if all its bytes are 255."""
    for i, b in enumerate(key):
        if b != 255:
            return key[:i] + bytes([b + 1])
    return key


def escaped(data: bytes) -> str:
    """Printable ASCII as it is, other bytes as \\xHH."""
    return "".join(chr(b) if 32 <= b <= 126 else f"\\x{b:02x}" for b in data)


def lcg(seed: int, n: int) -> int:
    """The n-th draw after a seed, by closed form."""
    seed = seed & 0x7FFFFFFF
    return (1 if seed in (0, LCG_MODULUS) else seed) * pow(LCG_FACTOR, n, LCG_MODULUS) % LCG_MODULUS


def _mapped(kind: T.DataType, f):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(bytes(x) if isinstance(x, (bytes, bytearray, memoryview)) else x))

    return run


@F.pandas_udf(T.LongType())
def crc32c_udf(s: pd.Series) -> pd.Series:
    known = s.notna()
    out = pd.Series(pd.array([None] * len(s), dtype="Int64"), index=s.index)
    out[known] = crc32c_many([bytes(x) for x in s[known]]).astype(np.int64)
    return out


get_varint_udf = _mapped(T.LongType(), lambda x: (get_varint(x) or (None,))[0])
get_slice_udf = _mapped(T.BinaryType(), lambda x: (get_slice(x) or (None,))[0])
successor_udf = _mapped(T.BinaryType(), successor)
escaped_udf = _mapped(T.StringType(), escaped)


@F.pandas_udf(T.BinaryType())
def separator_udf(start: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else separator(bytes(a), bytes(b)) for a, b in zip(start, limit, strict=True)], dtype=object)
