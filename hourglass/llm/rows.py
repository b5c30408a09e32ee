"""Row identity shared by the document operators.

Document ids may be null or repeat, so an id alone is no join key.  A row is
identified by its id and a 64-bit hash of its text; rows equal in both are
repeats of one another and always get the same decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["_row_id", "_row_null", "_row_hash"]


def with_key(df: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """Add the three key columns; a null id becomes id 0 with the null flag set.

    ``text`` defaults to the column of that name.  Column names starting
    with ``_row_`` are reserved; any other extra column passes untouched.
    """
    text = F.col("text") if text is None else text
    return df.withColumns({
        "_row_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")),
        "_row_null": F.col(id_col).isNull(),
        "_row_hash": F.xxhash64(F.coalesce(text, F.lit(""))),
    })


def drop_losers(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """Keep one row of each group and every row outside the groups.

    ``members`` has the key columns, ``stays`` (true for the group's one
    key that stays) and covers every row of every group of two or more, once
    per row.  Rows that repeat the staying key are reduced to one.  Texts
    are not shuffled as long as the two key lists are small enough for Spark
    to broadcast; beyond that both are ordinary shuffled joins.
    """
    columns = docs.columns
    keyed = with_key(docs, id_col, text)
    losers = members.where(~F.col("stays")).select(KEY).distinct()
    repeated = members.where("stays").groupBy(KEY).count().where("count > 1").select(KEY)
    kept = keyed.join(losers, KEY, "left_anti")
    once = kept.join(repeated, KEY, "left_anti").select(columns)
    folded = kept.join(repeated, KEY, "left_semi").dropDuplicates(KEY).select(columns)
    return once.unionByName(folded)
