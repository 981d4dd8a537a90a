"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space as the contracts name it (fixed value).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  For pure ASCII texts ``lower`` does just that, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
            .otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that are not ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front while ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: A group held by more than one of so many rows is joined by broadcast; there are at most HEAVY of them.
HEAVY = 1024


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n_rows: int) -> DataFrame:
    """``rows`` (``n_rows`` of them) joined with ``groups``, a written table of one row per value of ``keys`` whose
    column ``size`` tells how many rows hold it: those of frequent values do not meet in one task."""
    heavy = F.broadcast(groups.where(F.col(size) * HEAVY > n_rows))
    light = groups.where(F.col(size) * HEAVY <= n_rows)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return rows.join(heavy, keys).unionByName(rest)


def crc_mod(doc_id: Column, n: int) -> Column:
    """``crc32(doc_id as text) mod n``, the fold rule of the contracts."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
