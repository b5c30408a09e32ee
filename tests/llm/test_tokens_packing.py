from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourglass.llm import queries, training_order, vector_packing
from hourglass.llm.tokens import WordTokenizer
from hourglass.llm.vector_packing import Limits
from tests.conftest import SF

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_cached_tokenizer_equals_the_file(whole):
    rng = random.Random(3)
    marks = "abc ABC' sStTéÉß×÷ 12\n\t<|>endoftext .,;!?´µªº²\x85\xa0\u0301 漢字İſ'll're\x1c\x00\x0b\x0c\r"
    texts = ["".join(rng.choice(marks if k % 2 else marks[:38]) for _ in range(rng.randint(0, 40))) for k in range(1500)]
    small = WordTokenizer(PATH, cache_pieces=30, cache_chunks=10)
    for text, ids in zip(texts, WordTokenizer(PATH).batch(texts), strict=True):
        assert ids.tolist() == whole(text) == next(small.batch([text])).tolist()


def _check_packing(rows, docs, whole, limit=4096):
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, text in docs.items():
        ids, at = np.array([*whole(text), 2], "<u4"), 0
        for r in sorted(parts[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= limit
        total += at
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding / total


def test_packing_query_covers_every_id(spark, whole):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert _check_packing(queries.op4_vector_packing(spark, SF).collect(), docs, whole) < 0.01


def test_packing_odd_rows(odd_docs, no_docs, whole):
    rows = vector_packing.pack_documents(odd_docs, PATH, 2).withColumn("ids_crc32", F.crc32("ids"))
    docs = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id not in (None, 8)}
    _check_packing([r for r in rows.where("doc_id is not null and doc_id <> 8").withColumn("sequence_id", F.monotonically_increasing_id())
                    .withColumn("offset", F.lit(0)).collect()], docs, whole)
    assert rows.where("doc_id = 8 and start = 0").count() == 3
    assert vector_packing.pack_documents(no_docs, PATH, 2).count() == 0


def test_all_three_limits_hold(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.randint(0, 90)), " ".join(["reply"] * rng.randint(0, 60))) for i in range(400)]
    limits = Limits(tokens=128, segments=3, loss=70)
    out = vector_packing.pack_instructions(spark.createDataFrame(rows, "id long, prompt string, response string"), PATH, 2, limits=limits)
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("t"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l")).collect()
    assert all(r.t <= 128 and r.s <= 3 and r.l <= 70 for r in per)
    assert out.agg(F.sum("length")).first()[0] == sum(len(p.split()) + len(r.split()) + 1 for _, p, r in rows)
    assert out.agg(F.sum("loss_tokens")).first()[0] == sum(len(r.split()) + 1 for _, _, r in rows)


def test_permutation_is_a_bijection_for_any_size():
    for n in (0, 1, 2, 3, 17, 64, 65, 1000, 4097):
        assert sorted(training_order.permute(np.arange(n), n, 42)) == list(range(n))
    assert (training_order.permute(np.arange(100), 100, 1) != training_order.permute(np.arange(100), 100, 2)).any()


def test_training_order_round_trip_and_resume(spark, odd_docs, scratch, whole):
    index = training_order.write_training_order(odd_docs, scratch, PATH, 2, key=5, pad_id=9, seq_len=64, per_shard=100)
    read = {r.slot: np.frombuffer(r.record, "<u2").tolist() for r in training_order.read_training_order(spark, scratch, seq_len=64, per_shard=100).collect()}
    rows = index.collect()
    assert sorted(read) == list(range(len(rows))) == sorted(r.slot for r in rows)
    texts = defaultdict(dict)
    for r in rows:
        at = 0
        for s in r.segments:
            texts[s["id"]].setdefault(s["start"], read[r.slot][at:at + s["length"]])
            at += s["length"]
        assert at == r.n_ids and read[r.slot][at:] == [9] * (64 - at)
        assert r.byte_offset == r.slot % 100 * 129 and r.crc32 == zlib.crc32(np.array(read[r.slot], "<u2").tobytes())
    for r in odd_docs.where("doc_id is not null and doc_id <> 8").collect():
        ids = [i for start in sorted(texts[r.doc_id]) for i in texts[r.doc_id][start]]
        assert ids == [*whole(r.text), 2]
    later = training_order.read_training_order(spark, scratch, 150, seq_len=64, per_shard=100).collect()
    assert sorted(r.slot for r in later) == list(range(150, len(rows)))


def test_training_order_query_covers_every_id(spark, whole):
    docs = {r.doc_id: len(whole(r.text)) + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_training_order(spark, SF).collect()
    assert all(r.crc32 == r.read_crc32 for r in rows)
    parts, records = defaultdict(list), defaultdict(int)
    for r in rows:
        parts[r.doc_id].append((r.start, r.length))
        records[r.slot] += r.length
        assert (r.shard, r.byte_offset) == (r.slot // 1024, r.slot % 1024 * (2 * 4096 + 1))
    assert sorted(records) == list(range(len(records))) and all(records[r.slot] == r.n_ids for r in rows)
    for doc_id, n in docs.items():
        at = 0
        for start, length in sorted(parts[doc_id]):
            assert start == at
            at += length
        assert at == n


def test_shards_do_not_depend_on_how_many_a_task_writes(spark, odd_docs, scratch):
    def written(name, **more):
        training_order.write_training_order(odd_docs, f"{scratch}/{name}", PATH, 2, key=5, seq_len=64, per_shard=30, **more)
        read = training_order.read_training_order(spark, f"{scratch}/{name}", seq_len=64, per_shard=30)
        return [(r.slot, bytes(r.record)) for r in read.orderBy("slot").collect()]

    one = written("one", shards_per_task=1)
    assert [s for s, _ in one] == list(range(len(one))) and len(one) > 60
    assert written("many", shards_per_task=1000) == written("some", shards_per_task=3) == one


def test_training_order_empty(spark, no_docs, scratch):
    assert training_order.write_training_order(no_docs, f"{scratch}/x", PATH, 2, key=5).count() == 0
    assert training_order.read_training_order(spark, f"{scratch}/x").count() == 0


def test_loss_limit_binds_by_default_for_instructions(spark):
    rows = [(i, "ask", "word and other words " * 100) for i in range(60)]
    out = vector_packing.pack_instructions(spark.createDataFrame(rows, "id long, prompt string, response string").coalesce(1), PATH, 2).collect()
    loss, tokens = defaultdict(int), defaultdict(int)
    for r in out:
        loss[r.sequence_id] += r.loss_tokens
        tokens[r.sequence_id] += r.length
    assert {r.id for r in out} == set(range(60)) and max(loss.values()) <= vector_packing.INSTRUCTION_LIMITS.loss < Limits().tokens
    least = min(r.loss_tokens for r in out)
    assert any(loss[s] + least > 2048 and tokens[s] + least <= 4096 for s in loss)
