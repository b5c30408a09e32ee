"""Spelling variants: words that differ by one code point, from pairs of trie nodes.

The words are sorted, and the nodes of their prefix trie are numbered; so are
those of the trie of the reversed words.  A word is then a list of prefix
nodes and a list of suffix nodes, and each place in it is a pair of integers:
a split pair (prefix node, node of the whole rest), or a skip pair that leaves
one code point out.  Equal pairs mean equal strings on both sides, so nothing
has to be verified:

* two words with a skip pair in common differ by one replaced code point;
* a skip pair equal to a split pair of a shorter word is a deletion, read
  backwards an insertion.  Of a run of equal code points only the first is
  skipped for this, so a neighbour is met once.

Scale: words are counted with map-side partial aggregation, so a frequent
word is one row per task.  Sorting is a range partitioning; each task numbers
the nodes of its own range with the path of one word in memory, and the paths
that reach over a border of two ranges are joined from one row per partition.
A word of L code points gives 2 L + 1 pairs of integers, never substrings.
Words that share a skip pair differ in the skipped code point alone, so a
group is no larger than the alphabet, and each member gets one message (a
count and the best other member), not one per partner.

Defined cases: null texts have no words; a null document id is written as an
empty string in the key of a deletion; repeated rows count again; an empty
table has no words.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.session import materialize, release

RUN = "([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RANGE_BITS = 40  # numbers of one partition
ROOT = -1


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, run)``: every maximal run of Latin letters, A-Z lower-cased."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(RUN), 1)
    return docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))


def drop_letters(runs: DataFrame, every: int) -> Column:
    """The run, less one code point where the CRC-32 of ``<id>:<run>`` is divisible by ``every``."""
    crc = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (crc % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return F.when(crc % every == 0, cut).otherwise(F.col("run"))


def count_words(words: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """``(word, n)`` of a column ``word``, for words of enough code points and occurrences."""
    long_enough = words.where(F.length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- trie nodes


def _local_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the words and the trie nodes of one sorted partition.

    A word's path is the path of the word before it as far as both agree,
    then new numbers; the first word of a partition has the numbers from 0.
    """
    part = TaskContext.get().partitionId()
    base = part << RANGE_BITS
    number, node, before, path = base, base, "", []
    for batch in batches:
        paths, numbers = [], []
        for word in batch.column("key").to_pylist():
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            path = path[:shared] + list(range(node, node + len(word) - shared))
            node += len(word) - shared
            before = word
            paths.append(path)
            numbers.append(number)
            number += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(paths), pa.int32()), pa.array(numbers, pa.int64()), pa.array(paths, pa.list_(pa.int64()))],
                                         [*batch.schema.names, "part", "number", "path"])


def _inherited(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(part, given): the numbers of the first word's nodes that words of earlier partitions have already; one row per partition at most."""
    ends = (paths.groupBy("part").agg(F.min_by("key", "number").alias("first"), F.max_by(F.struct("key", "path"), "number").alias("last"))
            .orderBy("part"))
    rows, before, numbers = [], "", []
    for end in ends.toLocalIterator():
        shared = 0
        for a, b in zip(before, end["first"]):
            if a != b:
                break
            shared += 1
        given, base = numbers[:shared], end["part"] << RANGE_BITS
        if given:
            rows.append((end["part"], given))
        before = end["last"]["key"]
        numbers = [given[i] if i < shared and x == base + i else x for i, x in enumerate(end["last"]["path"])]
    return spark.createDataFrame(rows, "part int, given array<long>")


def number_nodes(words: DataFrame, key: str = "key", tag: str = "trie") -> DataFrame:
    """``words`` (distinct strings in ``key``) with ``number``, ascending in code-point order, and ``path``: the trie node of each of its prefixes."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    paths = words.withColumnRenamed(key, "key").repartitionByRange("key").sortWithinPartitions("key")
    paths = materialize(paths.mapInArrow(_local_paths, f"{kinds.replace(f'`{key}`', 'key')}, part int, number long, path array<long>"), tag)
    given = _inherited(words.sparkSession, paths)
    base = F.shiftleft(F.col("part").cast("long"), RANGE_BITS)
    mended = F.transform("path", lambda x, i: F.when((i < F.size("given")) & (x == F.col("base") + i), F.get("given", i)).otherwise(x))
    out = paths.join(given, "part", "left").withColumn("base", base)
    return out.withColumn("path", F.when(F.col("given").isNull(), F.col("path")).otherwise(mended)).drop("part", "given", "base").withColumnRenamed("key", key)


# ---------------------------------------------------------------- neighbours


def node_pairs(words: DataFrame) -> DataFrame:
    """``(left, right, skip, first, neg_n, number)``: all split and skip pairs of all words.

    ``words`` has word, n, number, and the node lists ``left`` and ``right``,
    both from the root on.  ``first`` marks skips that do not repeat the code
    point before.
    """
    size, chars = F.length("word"), F.split("word", "")
    split = F.transform(F.sequence(F.lit(0), F.col("size")), lambda i: F.struct(
        F.get("left", i).alias("left"), F.get("right", F.col("size") - i).alias("right"), F.lit(0).alias("skip"), F.lit(True).alias("first")))
    skip = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct(
        F.get("left", i).alias("left"), F.get("right", F.col("size") - 1 - i).alias("right"), F.lit(1).alias("skip"),
        ((i == 0) | (F.get("chars", i) != F.get("chars", i - 1))).alias("first")))
    rows = words.withColumns({"size": size, "chars": chars}).select("number", (-F.col("n")).alias("neg_n"), F.inline(F.concat(split, skip)))
    return rows.select("left", "right", "skip", "first", "neg_n", "number")


def neighbours(words: DataFrame) -> DataFrame:
    """``(number, n_near, best)`` of the words with a near word; ``best`` is (neg_n, number) of the most frequent, of ties the first.

    A row per word and shared pair is exchanged, with the count and the best
    of the words it is near to by that pair.
    """
    member = F.struct("neg_n", "number", "skip", "first")
    groups = node_pairs(words).groupBy("left", "right").agg(F.array_sort(F.collect_list(member)).alias("all")).where(F.size("all") > 1)
    key = lambda x: F.when(x.isNotNull(), F.struct(x["neg_n"].alias("neg_n"), x["number"].alias("number")))
    groups = groups.select("all", F.filter("all", lambda x: x["skip"] == 1).alias("skips"),
                           F.filter("all", lambda x: (x["skip"] == 1) & x["first"]).alias("cuts"),
                           F.get(F.filter("all", lambda x: x["skip"] == 0), F.lit(0)).alias("whole"))
    best, second = F.get("skips", F.lit(0)), F.get("skips", F.lit(1))
    shorter = F.col("whole").isNotNull()

    def message(x: Column) -> Column:
        other = key(F.when(best["number"] == x["number"], second).otherwise(best))
        below = F.when(x["first"], key(F.col("whole")))
        near = F.when(x["skip"] == 0, F.size("cuts")).otherwise(F.size("skips") - 1 + F.when(x["first"] & shorter, 1).otherwise(0))
        return F.struct(x["number"].alias("number"), near.alias("near"),
                        F.when(x["skip"] == 0, key(F.get("cuts", F.lit(0)))).otherwise(F.least(other, below)).alias("best"))

    sent = groups.select(F.inline(F.transform("all", message))).where("near > 0")
    return sent.groupBy("number").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """``(number, form)`` chains to ``(number, root)``, by pointer doubling; chains have no cycle as counts grow along them."""
    roots = materialize(links.select("number", F.col("form").alias("root")), "variant-roots")
    while True:
        onward = roots.select(F.col("number").alias("root"), F.col("root").alias("further"))
        step = materialize(roots.join(onward, "root", "left").select("number", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        release(roots)
        roots = step.select("number", "root")
        if step.where("moved").isEmpty():
            return roots


def variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """Every word of ``(word, n)`` with its near words' number, its form and its root.

    ``form`` is the near word of the largest count (of ties the first in
    code-point order) if that is at least ``ratio`` times the word's own;
    ``root`` follows forms to the last.
    """
    counts = materialize(counts.select("word", "n"), "variant-words")
    forward = number_nodes(counts.select(F.col("word").alias("key"), "n"), tag="variant-prefixes")
    forward = materialize(forward.select(F.col("key").alias("word"), "n", "number", "path"), "variant-forward")
    backward = number_nodes(forward.select(F.reverse("word").alias("key"), F.col("number").alias("word_number")), tag="variant-suffixes")
    root = F.array(F.lit(ROOT).cast("long"))
    words = forward.join(backward.select(F.col("word_number").alias("number"), F.col("path").alias("back")), "number")
    words = words.select("word", "n", "number", F.concat(root, "path").alias("left"), F.concat(root, "back").alias("right"))
    near = materialize(neighbours(words), "variant-near")
    plain = forward.select("word", "n", "number")
    found = plain.join(near, "number", "left")
    form_n = -F.col("best.neg_n")
    found = materialize(found.select("number", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                     F.when(form_n >= ratio * F.col("n"), F.col("best.number")).alias("form"),
                                     F.when(form_n >= ratio * F.col("n"), form_n).alias("form_n")), "variant-found")
    roots = follow(found.where("form is not null").select("number", "form"))
    spelled = lambda name: plain.select(F.col("number").alias(name), F.col("word").alias(f"{name}_word"))
    linked = (found.where("form is not null").join(roots, "number").join(spelled("form"), "form").join(spelled("root"), "root")
              .select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n"))
    single = found.where("form is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return linked.unionByName(single)
