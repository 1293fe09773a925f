"""Keys: order-preserving codecs, prefix ranges and the packed internal form, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytes import LCG_FACTOR, LCG_MODULUS, MASK_DELTA

#: Digits of an encoded integer key, so that byte order is numeric order.
WIDTH = 16
PUT, DELETE = 1, 0


def int_key(c: Column, width: int = WIDTH) -> Column:
    """A non-negative integer as a key whose byte order is its numeric order."""
    return F.lpad(c.cast("string"), width, "0")


def key_int(c: Column) -> Column:
    return c.cast("bigint")


def prefix_end(prefix: bytes) -> bytes | None:
    """The least byte string above all that start with the prefix; None if there is none."""
    stem = prefix.rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None


def has_prefix(key: Column, prefix: str) -> Column:
    """startswith as a range, which Parquet statistics can prune by."""
    end = prefix_end(prefix.encode())
    inside = key >= F.lit(prefix)
    if end is None:
        return inside
    try:
        return inside & (key < F.lit(end.decode()))
    except UnicodeDecodeError:
        return inside & key.startswith(prefix)


def internal_order(key: str = "user_key", seq: str = "seq", op: str = "op") -> list[Column]:
    """Key ascending, then newest first."""
    return [F.col(key).asc(), F.col(seq).desc(), F.col(op).desc()]


def pack_tag(seq: Column, op: Column) -> Column:
    """Sequence and kind in one number: the sequence in the high 56 bits."""
    return F.shiftleft(seq.cast("bigint"), 8).bitwiseOR(op.cast("bigint"))


def unpack_tag(tag: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(tag, 8), tag.bitwiseAND(F.lit(255)).cast("int")


def little_endian(n: Column, size: int = 8) -> Column:
    """An integer's low bytes, least first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(n.cast("bigint"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)]))


def internal_key(key: Column, seq: Column, op: Column) -> Column:
    return F.concat(key.cast("binary"), little_endian(pack_tag(seq, op)))


def parse_internal_key(ikey: Column) -> Column:
    """struct(user_key binary, seq, op), or null where the key is too short or its kind unknown."""
    n = F.length(ikey)
    tail = F.hex(F.substring(ikey, -8, 8))
    tag = F.conv(F.concat(*[F.substring(tail, 15 - 2 * i, 2) for i in range(8)]), 16, -10).cast("bigint")
    seq, op = unpack_tag(tag)
    return F.when((n >= 8) & op.isin(PUT, DELETE), F.struct(F.substr(ikey, F.lit(1), n - 8).alias("user_key"), seq.alias("seq"), op.alias("op")))


def debug_key(key: Column, seq: Column, op: Column) -> Column:
    return F.format_string("'%s' @ %d : %d", key, seq, op)


def varint_length(n: Column) -> Column:
    """Bytes of a non-negative integer in base 128."""
    out = F.lit(9)
    for size in range(8, 0, -1):
        out = F.when(n < F.lit(1 << 7 * size), F.lit(size)).otherwise(out)
    return out


def consume_decimal(text: Column) -> Column:
    """struct(number decimal(20,0), rest) of a text's leading digits; null without digits or beyond 64 bits."""
    digits = F.regexp_extract(text, r"^([0-9]+)", 1)
    number = F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 20, digits).cast("decimal(38,0)")
    fits = (digits != "") & (number <= F.lit("18446744073709551615").cast("decimal(38,0)"))
    return F.when(fits, F.struct(number.cast("decimal(20,0)").alias("number"), F.regexp_replace(text, r"^[0-9]+", "").alias("rest")))


def next_power2(n: Column) -> Column:
    """The least power of two that is no less; 0 gives 0."""
    return F.when(n <= 0, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(n - 1)) * (n > 1).cast("int"))).cast("bigint")


def from_little_endian(data: Column, at: int, size: int) -> Column:
    """The integer of `size` bytes (up to 7, or 8 without the sign bit) that starts at a place, least byte first."""
    digits = F.hex(F.substring(data, at + 1, size))
    return F.conv(F.concat(*[F.substring(digits, 2 * (size - i) - 1, 2) for i in range(size)]), 16, 10).cast("bigint")


def varint(n: Column) -> Column:
    """A non-negative integer in base 128, least first, as binary."""
    size, part = varint_length(n), lambda i: F.shiftrightunsigned(n.cast("bigint"), 7 * i).bitwiseAND(F.lit(127))
    byte = lambda i: F.lpad(F.hex(part(i) + F.when(size > i + 1, 128).otherwise(0)), 2, "0")
    return F.unhex(F.concat(*[F.when(size > i, byte(i)).otherwise(F.lit("")) for i in range(9)]))


def length_prefixed(data: Column) -> Column:
    return F.concat(varint(F.octet_length(data)), data)


def masked_crc(crc: Column) -> Column:
    """A checksum as it is stored: turned by 15 bits, and a constant added."""
    c = crc.cast("bigint")
    return (F.shiftright(c, 15).bitwiseOR(F.shiftleft(c, 17)).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(MASK_DELTA)).bitwiseAND(F.lit(0xFFFFFFFF))


def unmasked_crc(stored: Column) -> Column:
    r = (stored.cast("bigint") - F.lit(MASK_DELTA)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(r, 17).bitwiseOR(F.shiftleft(r, 15)).bitwiseAND(F.lit(0xFFFFFFFF))


def without_prefix(text: Column, n: int) -> Column:
    """A text or binary without its first n characters or bytes; an error where it is shorter."""
    size = F.length(text)
    return F.when(size >= n, F.substr(text, F.lit(n + 1), size)).when(size < n, F.raise_error(F.lit(f"shorter than {n}")).cast("string"))


def shown_entry(key: Column, seq: Column) -> Column:
    return F.concat(key, F.lit("["), seq.cast("string"), F.lit("]"))


def lcg(n: Column, seed: int = 301) -> Column:
    """The n-th draw (n up to 2^40) of the multiplicative generator: the seed times those powers of the factor that n's
    bits stand for, so that any draw is found without those before it."""
    seed &= 0x7FFFFFFF
    out = F.lit(1 if seed in (0, LCG_MODULUS) else seed).cast("bigint")
    for bit in range(40):
        power = pow(LCG_FACTOR, 1 << bit, LCG_MODULUS)
        out = (out * F.when(F.shiftrightunsigned(n.cast("bigint"), bit).bitwiseAND(F.lit(1)) == 1, F.lit(power)).otherwise(F.lit(1)).cast("bigint")) % F.lit(LCG_MODULUS)
    return out
