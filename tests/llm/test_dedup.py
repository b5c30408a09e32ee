from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from hourglass.llm import golay, queries, radix_dedup, simhash_golay
from hourglass.llm.components import connected_components
from tests.conftest import SF


def _squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_radix_decisions_equal_brute_force(odd_docs):
    got = radix_dedup.decisions(odd_docs.select("doc_id", "text"), text=radix_dedup.squeeze(F.col("text"))).collect()
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[_squeezed(r.text)].append(r.doc_id)
    assert len(got) == odd_docs.count()
    assert sum(r.kept for r in got) == len(groups)
    want = sorted((str(min((i for i in ids if i is not None), default=None)), len(ids), str(i)) for ids in groups.values() for i in ids)
    assert sorted((str(r.keep_id), r.group_size, str(r.doc_id)) for r in got) == want
    for r in got:
        assert not r.kept or r.doc_id == r.keep_id


def test_radix_shared_prefixes_of_every_digit_length(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("ab ") for _ in range(70_000))
    texts = []
    for cut in (0, 1, 127, 128, 129, 512, 640, 641, 2688, 10_880, 43_648, 69_999, 70_000):
        texts += [base[:cut], base[:cut] + "x", base[:cut] + "x", base[:cut] + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in radix_dedup.decisions(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (texts.index(t), texts.count(t))


def test_dedup_keeps_columns_and_one_of_each(odd_docs, no_docs):
    out = radix_dedup.dedup(odd_docs)
    assert out.columns == odd_docs.columns
    texts = [_squeezed(r.text) for r in out.collect()]
    assert sorted(texts) == sorted({_squeezed(r.text) for r in odd_docs.collect()})
    assert radix_dedup.dedup(no_docs).count() == 0 and radix_dedup.decisions(no_docs).count() == 0


def test_hot_group_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same " * 400)).otherwise(F.concat(F.lit("same " * 100), "id")).alias("text"))
    out = radix_dedup.dedup(docs)
    assert out.count() == 2001 and out.where("text like 'same same%' and doc_id = 0").count() == 1


def test_golay_words_one_bit_apart_share_a_codeword():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 5000)
    other = words ^ (1 << rng.integers(0, 23, 5000))
    near, real = golay.near(other)
    assert ((near == golay.home(words)[:, None]) & real).any(axis=1).all()
    counts = np.unique((golay.error_patterns() != golay.error_patterns()[:, :1]).sum(axis=1))
    assert counts.tolist() == [0, 5]


def _components(fps, bits=4):
    fps = sorted(fps)
    label = {f: f for f in fps}

    def find(f):
        while label[f] != f:
            f = label[f]
        return f
    for k, a in enumerate(fps):
        for b in fps[k + 1:]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_links_equal_all_pairs_also_in_tiles(spark):
    rng = random.Random(8)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << b
            fps.add(f - (1 << 64) if f >> 63 else f)
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = _components(fps)
    for tile in (2048, 7):
        edges = simhash_golay.links(table, tile=tile).collect()
        assert all(((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= 4 for e in edges)
        got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert all(got.get(f, f) == got.get(want[f], want[f]) for f in fps)
        assert len({got.get(f, f) for f in fps}) == len(set(want.values()))


def test_connected_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_in_blocks_equals_whole(monkeypatch):
    text = "A b  C d\te f g " * 500
    whole = simhash_golay.fingerprint(text)
    monkeypatch.setattr(simhash_golay, "_BLOCK_BYTES", 64)
    assert simhash_golay.fingerprint(text) == whole
    assert simhash_golay.fingerprint(None) == simhash_golay.fingerprint(" \n") == 0


def test_simhash_query_equals_brute_force(spark):
    import xxhash
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {}
    for i, text in docs.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        grams = [b" ".join(words[k:k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    label = _components(set(fps.values()))
    lowest = {}
    for i, f in fps.items():
        lowest[label[f]] = min(i, lowest.get(label[f], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_golay(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", lowest[label[f]]) for i, f in fps.items()}


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = simhash_golay.near_duplicates(odd_docs)
    assert rows.count() == odd_docs.count()
    wordless = rows.where("fp = 0").collect()
    assert len(wordless) == 4 and {r.component_id for r in wordless} == {3}
    out = simhash_golay.drop_near_duplicates(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == rows.select("label").distinct().count()
    assert simhash_golay.drop_near_duplicates(no_docs).count() == 0


def test_radix_rounds_of_very_long_texts(spark, monkeypatch):
    """Two equal texts of 10 MB, and one that differs in the last byte: eleven rounds."""
    rounds = []
    kept = radix_dedup.materialize
    monkeypatch.setattr(radix_dedup, "materialize", lambda df, tag: rounds.append(tag) or kept(df, tag))
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("0123456789"), 1_000_000), F.when(F.col("id") == 2, "x").otherwise("y")).alias("text"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in radix_dedup.decisions(docs).collect()}
    assert got == {0: (0, 2, True), 1: (0, 2, False), 2: (2, 1, True)} and rounds.count("radix-groups") <= 11


def test_radix_decisions_of_a_hot_row(spark):
    """Rows that repeat one id and text, or a null id and one text: one stays, and no window gathers them."""
    docs = spark.createDataFrame([(7, "hot")] * 500 + [(None, "none")] * 300 + [(8, "hot"), (1, "alone"), (7, "other")], "doc_id long, text string").repartition(5)
    out = radix_dedup.decisions(docs)
    rows = out.collect()
    kept = [(r.doc_id, r.group_size) for r in rows if r.kept]
    assert len(rows) == 803 and sorted(kept, key=str) == sorted([(7, 501), (None, 300), (1, 1), (7, 1)], key=str)
    assert "Window" not in out._jdf.queryExecution().toString()
