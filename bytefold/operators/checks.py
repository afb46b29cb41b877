"""Checksums, number utilities and header fields as folds over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_list(b: str) -> str:
    """SQL: a binary's bytes as integers."""
    return f"transform(regexp_extract_all(hex({b}), '..', 0), h -> cast(conv(h, 16, 10) as int))"


def crc32(b: str) -> Column:
    return F.expr(f"crc32({b})")


def crc16(b: str) -> Column:
    """Reflected polynomial 0xA001, start 0xFFFF."""
    bit = "case when d & 1 = 1 then shiftright(d, 1) ^ 40961 else shiftright(d, 1) end"
    return F.expr(f"aggregate({byte_list(b)}, 65535, (c, x) -> aggregate(sequence(1, 8), c ^ x, (d, k) -> {bit}))")


def lfn_checksum(b: str) -> Column:
    """Eight-bit rotate and add over the 11 bytes of a short name."""
    return F.expr(f"aggregate({byte_list(b)}, 0, (a, x) -> (if(a & 1 = 1, 128, 0) + shiftright(a, 1) + x) & 255)")


def tar_checksum(header: str) -> Column:
    """Sum of a 512-byte header with its checksum field (bytes 148 to 155) as blanks."""
    return F.expr(f"aggregate({byte_list(header)}, struct(0 as i, 0 as s), (a, x) -> struct(a.i + 1 as i, a.s + if(a.i between 148 and 155, 32, x) as s), a -> a.s)")


def ones_complement_sum(b: str) -> Column:
    """The complement of the byte sum, unsigned 32 bits."""
    return F.expr(f"aggregate({byte_list(b)}, 0L, (a, x) -> a + x, a -> 4294967295L - a % 4294967296L)")


def octal(value: Column) -> Column:
    return F.conv(value.cast("string"), 10, 8)


def from_octal(text: Column) -> Column:
    return F.conv(F.trim(text), 8, 10).cast("long")


def dos_time(ts: Column) -> Column:
    """Packed date and time with two-second steps."""
    date = (F.year(ts) - 1980) * 512 + F.month(ts) * 32 + F.dayofmonth(ts)
    return (date.cast("long") * 65536 + F.hour(ts) * 2048 + F.minute(ts) * 32 + F.floor(F.second(ts) / 2)).cast("long")


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(v, high))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def map_range(v: Column, a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return b0 + (v - a0) * (b1 - b0) / (a1 - a0)


def safe_div(a: str, b: str) -> Column:
    return F.expr(f"case when ({b}) = 0 then 0 else ({a}) div ({b}) end")


def is_power_of_2(v: Column) -> Column:
    return (v > 0) & (F.bit_count(v) == 1)


def next_power_of_2(v: str) -> Column:
    """The smallest power of two at or above v; 1 for 0."""
    return F.expr(f"case when {v} <= 1 then 1L else shiftleft(1L, cast(length(bin({v} - 1)) as int)) end")


def gcd(a: str, b: str) -> str:
    """SQL: Euclid as a fold of a bounded number of steps (47 suffice for 32 bits)."""
    return f"aggregate(sequence(1, 47), struct(cast({a} as bigint) as a, cast({b} as bigint) as b), (s, i) -> if(s.b = 0, s, struct(s.b as a, s.a % s.b as b)), s -> s.a)"


def lcm(a: str, b: str) -> Column:
    """Wraps at 32 bits; 0 if either is 0."""
    return F.expr(f"case when {a} = 0 or {b} = 0 then 0L else ({a} div {gcd(a, b)} * {b}) % 4294967296L end")


def msf_frames(m: Column, s: Column, f: Column) -> Column:
    return (m * 60 + s) * 75 + f


def frames_msf(n: str) -> Column:
    return F.expr(f"format_string('%02d:%02d:%02d', {n} div 4500, {n} div 75 % 60, {n} % 75)")


def vhd_geometry(size: str) -> Column:
    """struct<cylinders, heads, sectors> of a disk of `size` bytes."""
    total = f"least({size} div 512, 65535L * 16 * 255)"
    small = f"greatest(4L, ({total} div 17 + 1023) div 1024)"
    fits17 = f"{total} div 17 < {small} * 1024 and {small} <= 16"
    fits31 = f"{total} div 31 < 16 * 1024"
    return F.expr(
        f"""case when {total} >= 65535L * 16 * 63 then struct({total} div (16 * 255) as cylinders, 16L as heads, 255 as sectors)
        when {fits17} then struct({total} div 17 div {small} as cylinders, {small} as heads, 17 as sectors)
        when {fits31} then struct({total} div 31 div 16 as cylinders, 16L as heads, 31 as sectors)
        else struct({total} div 63 div 16 as cylinders, 16L as heads, 63 as sectors) end"""
    )


def iso_name(name: Column, is_dir: bool = False) -> Column:
    clean = F.regexp_replace(F.upper(name), "[^A-Z0-9_.]", "_")
    short = F.when(~clean.contains(".") & (F.length(clean) > 8), F.substring(clean, 1, 8)).otherwise(clean)
    return short if is_dir else F.concat(short, F.lit(";1"))


def iso_decoded(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(name, ";", 1), r"\.$", "")


def fat_name(name: Column) -> Column:
    """The 11 characters of an 8.3 name."""
    base = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    ext = F.when(name.contains("."), F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise(F.lit(""))
    plain = F.concat(F.rpad(F.substring(F.upper(base), 1, 8), 8, " "), F.rpad(F.substring(F.upper(ext), 1, 3), 3, " "))
    return F.when(name.isin(".", ".."), F.rpad(name, 11, " ")).otherwise(plain)


def fat_decoded(name: Column) -> Column:
    base, ext = F.substring_index(F.substring(name, 1, 8), " ", 1), F.substring_index(F.substring(name, 9, 3), " ", 1)
    return F.when(ext != "", F.concat(base, F.lit("."), ext)).otherwise(base)
