"""The n smallest keys of a table, found by counting instead of sorting (E5).

A pass counts the rows per value of the next few digits of the key, among the
rows that share the digits found so far; the n-th key lies in one of these
bins. A few passes narrow it to a bin of bounded size, then one filter keeps
the rows below that bin and a small top-n picks the rest inside it. A pass
returns at most 16 ** ``digits`` counts; nothing is sorted or moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prepare import rank_rows

_DIGITS = 3   # hex digits counted per pass: 4,096 counts
_PICK = 4096  # rows of the last bin picked by one small top-n


def select_smallest(df: DataFrame, key: str, ties: list[str], n: int, digits: int = _DIGITS,
                    pick: int = _PICK) -> DataFrame:
    """The ``n`` rows of ``df`` smallest by (``key``, ``ties``), all if there are no more.

    ``key`` is a string of 32 lowercase hex digits (md5), never null. Repeated rows
    count one by one; a bin that stays larger than ``pick`` after the last digit
    (equal keys) is ranked by a distributed sort.
    """
    if n <= 0:
        return df.filter(F.lit(False))
    prefix, need, here = "", n, None
    while len(prefix) < 32 and (here is None or here > pick):
        bins = (df.filter(F.col(key).startswith(prefix))
                .groupBy(F.substring(key, len(prefix) + 1, digits).alias("bin"))
                .agg(F.count(F.lit(1)).alias("n")).collect())
        for bin_ in sorted(bins):
            if need <= bin_["n"]:
                prefix, here = prefix + bin_["bin"], bin_["n"]
                break
            need -= bin_["n"]
        else:  # only in the first pass: there are fewer than n rows
            return df
    inside = df.filter(F.col(key).startswith(prefix))
    if here <= pick:
        inside = inside.orderBy(key, *ties).limit(need)
    else:
        inside = rank_rows(inside, [key, *ties], "_r").filter(F.col("_r") < need).drop("_r")
    return df.filter(F.col(key) < F.lit(prefix)).unionByName(inside)
