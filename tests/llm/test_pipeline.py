from __future__ import annotations

import math
import re

import duckdb

import corpus_pipeline
from hourglass.llm import decontaminate, queries, radix_dedup, simhash_golay, toxicity
from tests.conftest import SF, SF01
from tests.llm.test_dedup import _components, _squeezed
from tests.llm.test_tokens_packing import _check_packing


def test_sql_gives_the_queries_rows(spark):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF01}/{table}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, SF01)
        columns = sorted(got.columns)
        con.sql(f"CREATE VIEW v_{name} AS {sql}")
        want = con.sql(f"SELECT {', '.join(columns)} FROM v_{name}").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want)), name


def test_stages_hold_what_they_promise(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF01).cache()
        assert after.columns == docs.columns and 0 < after.count() <= docs.count(), name
        assert after.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0, name
        docs = after
    assert radix_dedup.equal_groups(docs).count() == 0
    rows = simhash_golay.near_duplicates(docs)
    assert rows.select("label").distinct().count() == docs.count()
    bench = spark.read.parquet(f"{SF01}/benchmark.parquet")
    assert decontaminate.find_contamination(docs, bench).where("hits.n_hit > 0").count() == 0


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF01).count() <= max(60, 60 * docs.count())


def test_run_returns_pieces(spark):
    assert corpus_pipeline.run(spark, SF01).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _without_windows(text, windows):
    """Brute force of the span removal: cut all words inside any occurrence; None if more than half are hit."""
    places = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[a:b]) for a, b in places]
    hit = [False] * len(words)
    for w in windows:
        for i in range(len(words) - len(w) + 1):
            if words[i:i + len(w)] == w:
                hit[i:i + len(w)] = [True] * len(w)
    if sum(hit) > 0.5 * len(words):
        return None
    out, at, i = [], 0, 0
    while i < len(words):
        if hit[i]:
            j = i
            while j < len(words) and hit[j]:
                j += 1
            out.append(text[at:places[i][0]])
            at, i = places[j - 1][1], j
        else:
            i += 1
    return "".join(out) + text[at:]


def test_run_equals_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    matcher = toxicity.Matcher(model)

    def score(text):
        line = sum(w * x for w, x in zip(model.weights, [*toxicity.hit_features(text, matcher), 1.0], strict=True))
        return 1 / (1 + math.exp(-line))
    docs = {i: t for i, t in docs.items() if score(t) < 0.7}
    first = {}
    for i in sorted(docs):
        first.setdefault(_squeezed(docs[i]), i)
    docs = {i: docs[i] for i in first.values()}
    fps = {i: simhash_golay.fingerprint(t) for i, t in docs.items()}
    label, kept = _components(set(fps.values())), {}
    for i in sorted(docs):
        kept.setdefault(label[fps[i]], i)
    docs = {i: docs[i] for i in kept.values()}
    windows = []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = [w.decode() for w in decontaminate.words_of(r.text)]
        windows += [words[k:k + 10] for k in range(len(words) - 9)] or ([words] if words else [])
    docs = {i: c for i, t in docs.items() if (c := _without_windows(t, windows)) is not None}

    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(queries.tokenizer_path())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs)
    _check_packing(rows, docs, lambda t: whole.encode(t, add_special_tokens=False).ids)
