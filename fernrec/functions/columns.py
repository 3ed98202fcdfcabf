"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, as a Java regex
# class (Unicode separators, ASCII whitespace, \x1c-\x1f, \x85).
WHITESPACE_CLASS = r"[\p{Z}\s\x{1c}-\x{1f}\x{0b}\x{85}]"

# The same whitespace as an explicit character set, in code
# point order: \t \n \x0b \x0c \r \x1c-\x1f space \x85 \xa0 U+1680
# U+2000-U+200A U+2028 U+2029 U+202F U+205F U+3000.
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                    + "".join(chr(c) for c in range(0x2000, 0x200B))
                    + "\u2028\u2029\u202f\u205f\u3000")

# The line breaks of Python's str.splitlines(), as a Java regex
# (\R covers \r\n \n \x0b \f \r \x85 U+2028 U+2029; plus \x1c-\x1e).
LINE_BREAK_PATTERN = r"\R|[\x{1c}-\x{1e}]"


def unicode_strip(col: Column) -> Column:
    """Strip leading/trailing Unicode whitespace, as Python's ``str.strip()``
    (a character-set trim: no regex, code-generated)."""
    return F.trim(col, F.lit(WHITESPACE_CHARS))


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01: of the instant for a TIMESTAMP column, of
    the wall clock for TIMESTAMP_NTZ and DATE; the session zone plays no part."""
    c = F.col(ts) if isinstance(ts, str) else ts
    wall = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                           c.cast("timestamp_ntz"))
    return F.when(F.typeof(c) == F.lit("timestamp"),
                  F.unix_micros(c.cast("timestamp"))).otherwise(wall)


def _hash_uniform(key: Column, start: int) -> Column:
    """An unsigned 32-bit integer from 8 hex digits of md5(key), as DOUBLE."""
    return F.conv(F.substring(F.md5(key), start, 8), 16, 10).cast("double")


def hash_normal(seed: int, tag: str, idx: Column, f: Column,
                mean: float = 0.0, std: float = 1.0) -> Column:
    """N(mean, std) deterministic in (seed, tag, idx, f) via Box-Muller on md5.

    Independent of partitioning and of evaluation order, unlike ``randn(seed)``.
    u1 = (h1 + 1) / (2^32 + 1) lies in (0, 1], u2 = h2 / 2^32 in [0, 1).
    """
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), idx.cast("string"), f.cast("string"))
    u1 = (_hash_uniform(key, 1) + F.lit(1.0)) / F.lit(4294967297.0)
    u2 = _hash_uniform(key, 9) / F.lit(4294967296.0)
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return F.lit(float(mean)) + F.lit(float(std)) * z


def dot(a: Column, b: Column) -> Column:
    """Dot product of two equally long numeric arrays, in DOUBLE."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def ndcg_at(rank: Column, k: int) -> Column:
    """1/log2(rank+1) when the 1-based rank is within the top k, else 0."""
    return F.when((rank >= 1) & (rank <= F.lit(k)),
                  F.lit(1.0) / F.log2(rank.cast("double") + F.lit(1.0))).otherwise(F.lit(0.0))


def hit_at(rank: Column, k: int) -> Column:
    return F.when((rank >= 1) & (rank <= F.lit(k)), F.lit(1.0)).otherwise(F.lit(0.0))


def round6(col: Column) -> Column:
    """Round to 6 places; ``+ 0.0`` folds -0.0 into 0.0 (stable value hashes)."""
    return F.round(col, 6) + F.lit(0.0)
