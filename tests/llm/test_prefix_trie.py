from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from hourglass.llm import prefix_trie, queries
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(talks: dict[int, list[tuple[str, str]]]) -> dict:
    """(conv_id, depth) to the other columns, from all prefixes."""
    members = defaultdict(list)
    for c in sorted(talks):
        for d in range(len(talks[c]) + 1):
            members[tuple(talks[c][:d])].append(c)
    out = {}
    for path, convs in members.items():
        sub = [p for p in members if p[:len(path)] == path]
        kids = [p for p in sub if len(p) == len(path) + 1]
        leaves = [p for p in sub if not any(q[:-1] == p for q in sub if q)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in sub if p)
        ends = ",".join(str(c) for c in convs if len(talks[c]) == len(path))
        out[convs[0], len(path)] = (members[path[:-1]][0] if path else None, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def talks_of(rows) -> dict[int, list[tuple[str, str]]]:
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    return {c: [v[-1] for v in sorted(turns)] for c, turns in by.items()}


def spliced(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        out[c] = talks.get(c - rest, [])[:h] + own[h:]
    return out


def found(df) -> dict:
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def odd_rows():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"é{(c * 7 + t * t) % (2 + t)}") for c in range(-7, 60) for t in range(abs(c) % 6 + 1)]
    long = [(100, t, "user", str(t)) for t in range(300)]
    return rows + long + [(103, t, r, x) for _, t, r, x in long[:200]] + [(106, t, r, x if t < 130 else "b") for _, t, r, x in long] + [
        (None, 0, "user", "left out"), (70, None, None, None), (70, None, "z", ""), (70, 0, "user", "a"), (70, 0, "user", "a"), (71, 5, "x", "long " * 50_000),
        (72, 3, "b", "tie"), (72, 3, "a", "tie"), (72, 3, "a", "tie")]


def test_trie_equals_all_prefixes(spark):
    rows = odd_rows()
    table = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("pos", F.lit(1))
    assert found(prefix_trie.build(table)) == brute(talks_of(rows))


def test_shards_and_bands_add_up(spark, monkeypatch):
    """The same nodes come out of many small shards, and a hot first turn, a group of copies and a long conversation spread over them."""
    rows = [(c, t, "user", "hot" if t == 0 else f"{c % 40}") for c in range(0, 400) for t in range(1 + c % 4)]
    rows += [(1000 + c, t, "user", "copy") for c in range(200) for t in range(3)] + [(5000, t, "user", "copy") for t in range(500)]
    monkeypatch.setattr(prefix_trie, "SHARD", 16)
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.build(table)) == brute(talks_of(rows))
    shares = prefix_trie.shard_nodes(*prefix_trie.number_turns(table))
    most = shares.agg(F.max(F.size("members"))).first()[0]
    assert most <= 16 and shares.where("depth = 1").select("shard").distinct().count() > 30


def test_query_rule_and_sql(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(queries.op11_conversation_trie(spark, str(tmp_path))) == brute(spliced(talks_of(rows)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    got = {tuple(r) for r in queries.op11_conversation_trie(spark, SF).collect()}
    assert got == set(con.sql(queries.ORACLE_SQL["op11_conversation_trie"]).fetchall())


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.build(none).count() == 0
    turns, convs = prefix_trie.number_turns(spark.createDataFrame([(6, 0, "user", "x"), (None, 0, "user", "y")], SCHEMA))
    alone = prefix_trie.splice_heads(turns, convs, F.lit(8), F.col("conv_id") - F.col("conv_id") % 5, 4, 8)
    assert found(prefix_trie.trie(*alone)) == {(6, 0): (None, 1, 0, 1, 0, hashlib.sha256(b"6").hexdigest())}
