"""Exact deduplication by distributed most-significant-digit radix partitioning.

Every text is a byte string read digit by digit, where a digit is a run of
bytes (128 first, then four times as many each round, at most 4 MiB).  A
round groups the open documents by (class so far, next digit).  Groups of
one are finished, groups whose digit is short have ended and hold equal
texts, and the others go on as classes of the next round.  Two texts share a
class only if all their bytes so far are equal, so equality needs no digest.

Scale: a round counts its groups with map-side partial aggregation, so a
group of copies holding a third of all rows is one row per task there.  Only
documents of groups of two or more are carried on.  The join that hands the
class to its rows is a plain shuffled join of two written tables, whose hot
partition adaptive execution splits.  Each round's rows are written to the
shared folder, which cuts the lineage; their number is logarithmic in the
longest text up to a few MiB, then one for every 4 MiB, as a digit is held in
memory as a grouping key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.llm.rows import KEY, drop_losers, with_key
from hourglass.session import materialize, release

FIRST_DIGIT = 128
DIGIT_GROWTH = 4
WIDEST_DIGIT = 1 << 22


def squeeze(text: Column) -> Column:
    """Null becomes empty; every run of ASCII white space becomes one space."""
    run = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"
    return F.regexp_replace(F.coalesce(text, F.lit("")), run, " ")


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """The rows of every group of two or more equal texts, once per row.

    ``text`` is the compared string (null compares as empty).  Returns the
    row key, ``keep_id`` (smallest id of the group, null only if the group
    has no id), ``group_size`` and ``stays`` (the row key that stays: the
    smallest id, then the smallest hash).  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    rows = with_key(docs, id_col, text).select(*KEY, F.lit(0).cast("long").alias("class"), text.cast("binary").alias("rest"))
    width, done, spent = FIRST_DIGIT, [], []
    while True:
        digit = F.col("rest").substr(1, width)
        rows = rows.withColumn("digit", digit)
        groups = (rows.groupBy("class", "digit")
                  .agg(F.count(F.lit(1)).alias("group_size"),
                       F.min(F.when(~F.col("_row_null"), F.col("_row_id"))).alias("keep_id"))
                  .where("group_size > 1")
                  .withColumn("next_class", F.monotonically_increasing_id()))
        groups = materialize(groups, "radix-groups")
        ended = F.length("digit") < width
        step = materialize(
            rows.join(groups, ["class", "digit"])
            .select(*KEY, F.col("next_class").alias("class"), "keep_id", "group_size", ended.alias("ended"),
                    F.when(~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest")), "radix-rows")
        release(groups, *spent)
        done.append(materialize(step.where("ended").select(*KEY, "keep_id", "group_size"), "radix-done"))
        rows = step.where(~F.col("ended")).select(*KEY, "class", "rest")
        spent = [step]
        if rows.isEmpty():
            release(step)
            break
        width = min(width * DIGIT_GROWTH, WIDEST_DIGIT)
    members = done[0]
    for part in done[1:]:
        members = members.unionByName(part)
    stays = F.when(F.col("keep_id").isNull(), F.col("_row_null")).otherwise(
        ~F.col("_row_null") & (F.col("_row_id") == F.col("keep_id")))
    return members.withColumn("stays", stays)


def decisions(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept`` and ``text``'s SHA-256.

    Of rows that repeat both the id and the text of the staying row, one is
    kept: the least of a number per row, found by a partially aggregated
    minimum, so many such rows are no window of one task.  Null ids sort last: such a row stays only if its group has no id.
    """
    text = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    light = materialize(with_key(docs, id_col, text).select(F.col(id_col), *KEY, F.sha2(text, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_row_number")), "radix-light")
    members = equal_groups(docs, id_col, text)
    found = members.groupBy(KEY).agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"),
                                     F.first("stays").alias("stays"))
    first = light.groupBy(KEY).agg(F.min("_row_number").alias("_first"))
    return (light.join(found.join(first, KEY), KEY, "left")
            .select(id_col,
                    F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    (F.coalesce("stays", F.lit(True)) & F.coalesce(F.col("_row_number") == F.col("_first"), F.lit(True))).alias("kept"),
                    "text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their exact copies (white space runs count as one space); all columns pass."""
    text = squeeze(F.col(text_col))
    return drop_losers(docs, equal_groups(docs, id_col, text), id_col, text)
