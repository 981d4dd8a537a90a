"""Search results as text: JSON arrays of ``[key, rank]`` pairs (K4) and lines (K5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RANK_FORMAT = "%.6f"


def json_scalar(key: Column | str) -> Column:
    """The key as a JSON string literal (quotes and backslashes escaped)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.regexp_extract(F.to_json(F.array(k.cast("string"))), r"^\[(.*)\]$", 1)


def result_json(top: DataFrame) -> DataFrame:
    """(query_id, result): ``[["key",rank],...]`` in rank order, at most k pairs.

    Gathers at most k rows per query (the top-k input bounds the list)."""
    pair = F.concat(F.lit("["), json_scalar("doc_key"), F.lit(","),
                    F.format_string(RANK_FORMAT, F.col("rank")), F.lit("]"))
    grouped = top.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rn"), pair.alias("pair")))).alias("pairs"))
    return grouped.select("query_id", F.concat(F.lit("["), F.array_join(F.transform("pairs", lambda p: p["pair"]), ","),
                                               F.lit("]")).alias("result"))


def result_lines(top: DataFrame) -> DataFrame:
    """(query_id, rn, line) with ``line = "<key> <rank>"``."""
    return top.select("query_id", "rn", F.concat_ws(" ", F.col("doc_key").cast("string"),
                                                    F.format_string(RANK_FORMAT, F.col("rank"))).alias("line"))


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(column).write.mode("overwrite").text(path)
