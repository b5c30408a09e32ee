from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from hourglass.llm import queries
from hourglass.llm import spelling_variants as sv
from tests.conftest import SF


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(counts: dict[str, int], ratio: int = 5) -> set:
    form, many = {}, {}
    for w, n in counts.items():
        around = sorted((-m, v) for v, m in counts.items() if near(w, v))
        many[w] = len(around)
        form[w] = around[0][1] if around and -around[0][0] >= ratio * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, many[w], counts[form[w]] if form[w] else None) for w, n in counts.items()}


def found(df) -> set:
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def some_words(seed: int, many: int, letters: str = "abé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(many)}
    return {w: rng.choice([1, 1, 2, 5, 5, 25, 25, 130, 700]) for w in words}


def test_all_neighbours_of_dense_vocabularies(spark):
    for seed, letters in ((1, "abé"), (2, "a"), (3, "ab"), (4, "漢\U0001f600z")):
        counts = some_words(seed, 250, letters)
        assert found(sv.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_numbers_over_many_partitions(spark):
    """Trie nodes are equal exactly for equal prefixes, also over the borders of sorted ranges."""
    words = [f"{'common' * 5}{a}{b}" for a in range(12) for b in range(12)] + ["c", "common", "d" * 40] + ["d" * 40 + str(i) for i in range(30)]
    table = spark.createDataFrame([(w, 1) for w in words], "key string, n long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sv.number_nodes(table).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r.number >> sv.RANGE_BITS for r in rows}) > 4
    node_of, prefix_of = {}, {}
    for r in rows:
        assert len(r.path) == len(r.key)
        for i, x in enumerate(r.path, 1):
            assert node_of.setdefault(r.key[:i], x) == x and prefix_of.setdefault(x, r.key[:i]) == r.key[:i]
    assert [r.key for r in sorted(rows, key=lambda r: r.number)] == sorted(words)


def test_groups_are_bounded_by_the_alphabet(spark):
    counts = some_words(9, 400, "abc")
    forward = sv.number_nodes(spark.createDataFrame([(w, n) for w, n in counts.items()], "key string, n long"))
    back = sv.number_nodes(forward.select(F.reverse("key").alias("key"), F.col("number").alias("of")))
    root = F.array(F.lit(-1).cast("long"))
    words = forward.join(back.select(F.col("of").alias("number"), F.col("path").alias("back")), "number")
    pairs = sv.node_pairs(words.select(F.col("key").alias("word"), "n", "number", F.concat(root, "path").alias("left"), F.concat(root, "back").alias("right")))
    assert pairs.groupBy("left", "right").count().agg(F.max("count")).first()[0] <= 4
    assert pairs.count() == sum(2 * len(w) + 1 for w in counts)


def test_very_long_and_odd_words(spark):
    long = "langeswort" * 3000
    counts = {long: 40, long + "x": 5, long[:-1]: 8, long[1:]: 8, "y" + long[1:]: 300, "aaaaaa": 9, "aaaaa": 50, "aaaaaaa": 1}
    assert found(sv.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)
    none = spark.createDataFrame([], "word string, n long")
    assert sv.variants(none).count() == 0


def words_of(rows) -> dict[str, int]:
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_query_equals_brute_force_and_sql(spark, tmp_path, odd_docs):
    base = ["Straße", "strasse", "Straßen", "chanter", "chantér", "CHANTER", "chantera", "Étoiles×÷", "étoiles"]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(base, k=40)) + "1" + rng.choice(base)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text")).withColumn("word", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = found(queries.op12_spelling_variants(spark, str(tmp_path)))
    assert got == brute(words_of([(r.doc_id, r.text) for r in docs.collect()])) and any(r[1] for r in got)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = set(con.sql("SELECT word, form, root, n, n_near, form_n FROM (" + queries.ORACLE_SQL["op12_spelling_variants"] + ")").fetchall())
    assert found(queries.op12_spelling_variants(spark, SF)) == want
