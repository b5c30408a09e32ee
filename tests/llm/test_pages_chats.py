from __future__ import annotations

import math
from datetime import datetime
from itertools import product

from pyspark.sql import functions as F

from hourglass.llm import chat_collapse, queries, revisits, url_filter
from tests.conftest import SF


def _turns(spark, talks):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", x) for i, talk in talks for t, x in enumerate(talk)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_collapse_keeps_maximal_conversations(spark):
    talks = [(1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"]), (4, ["a", "x"]), (5, ["a", "b", "c"]), (6, ["z"]), (7, ["z"])]
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat_collapse.collapse(_turns(spark, talks)).collect()}
    assert got == {3: (3, 2), 4: (2, 1), 6: (1, 2)}


def test_collapse_of_long_and_odd_conversations(spark):
    long = [str(i) for i in range(700)]
    turns = _turns(spark, [(1, long), (2, long[:512]), (3, long[:300] + ["other"])])
    odd = spark.createDataFrame([(None, 0, "user", None), (9, None, None, "last"), (9, 0, "user", ""), (9, 0, "user", "")], turns.schema)
    out = chat_collapse.collapse(turns.unionByName(odd).withColumn("block", F.lit("clash")))
    rows = out.orderBy("conv_id", "part").collect()
    whole = "".join(r.text for r in rows if r.conv_id == 1)
    assert [r.part for r in rows if r.conv_id == 1] == [0, 1, 2]
    assert whole == "".join(f"<|im_start|>{'user' if i % 2 == 0 else 'assistant'}\n{i}<|im_end|>\n" for i in range(700))
    assert {r.conv_id for r in rows} == {1, 3, 9}  # the one of the null id begins conversation 9
    assert {r.n_turns for r in rows if r.conv_id == 9} == {2}
    assert chat_collapse.collapse(turns.where("1 = 0")).count() == 0


def test_collapse_spreads_ties_and_null_ids(spark):
    """Null ids, null turns and repeated turn numbers: parts and window groups stay bounded, and nothing is lost."""
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, i % 3, "user", f"n{i}") for i in range(5000)] + [(1, None, "user", f"a{i}") for i in range(3000)] + [(2, 7, "user", f"b{i}") for i in range(1500)]
    turns = spark.createDataFrame(rows + rows[:700], schema)
    out = chat_collapse.collapse(turns).orderBy("conv_id", "part").collect()
    for conv, n in ((None, 5000), (1, 3000), (2, 1500)):
        parts = [r for r in out if r.conv_id == conv]
        assert [r.part for r in parts] == list(range(-(-n // 256))) and {r.n_turns for r in parts} == {n}
        assert max(r.text.count("<|im_start|>") for r in parts) <= 256
        said = "".join(r.text for r in parts).replace("<|im_start|>user\n", "").split("<|im_end|>\n")[:-1]
        assert sorted(said) == sorted({x for c, _, _, x in rows if c == conv})
        if conv is None:
            assert [int(x[1:]) % 3 for x in said] == sorted(int(x[1:]) % 3 for x in said)
    chunked = chat_collapse._chunked(turns)
    assert chunked.groupBy("conv_id", "chunk").count().agg(F.max("count")).first()[0] <= chat_collapse.CHUNK_ROWS
    prefixes = chat_collapse.prefix_hashes(turns)
    assert prefixes.groupBy("conv_id").agg(F.countDistinct("position").alias("n")).where("conv_id is null").first().n == 5000


def test_collapse_drops_beginnings_of_conversations_over_chunks(spark):
    long = [str(i) for i in range(3000)]
    out = chat_collapse.collapse(_turns(spark, [(1, long[:2500]), (2, long), (3, long[:1024]), (4, long[:2000] + ["x"])])).collect()
    assert {r.conv_id for r in out} == {2, 4} and {r.n_turns for r in out if r.conv_id == 2} == {3000}


def test_collapse_runs_no_python(spark):
    plan = chat_collapse.collapse(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_rules_and_url_parts(spark):
    urls = {"http://A.NET/x?y": ("a.net", "/x", "net/"), "net://net/": ("net", "/", "net/"), "http://x.example.net/en/1#f": ("x.example.net", "/en/1", "example.net/en/"),
            "http://example.com/de/": ("example.com", "/de/", "example.com/de/"), "http://myexample.com/de/": ("myexample.com", "/de/", None),
            "http://a.org/fr/b": ("a.org", "/fr/b", "org/fr/"), "http://a.net": ("a.net", "", None), "plain": ("", "", None), None: ("", "", None),
            "a://b://c/d": ("b:", "//c/d", None), "http://ÄB.org/FR/": ("Äb.org", "/FR/", None)}
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    corpus = spark.createDataFrame([("the cat and the dog",), (None,)], "text string")
    got = {r.page_id: r for r in url_filter.judge(pages, corpus).collect()}
    for i, want in enumerate(urls.values()):
        assert (got[i].host, got[i].path, got[i].rule) == want
        assert got[i].verdict == dict(url_filter.RULES).get(want[2], "allow")
    assert url_filter.judge(pages.where("1 = 0"), corpus).count() == 0


def test_viterbi_equals_all_splits():
    counts, total = {"the": 50, "cat": 9, "at": 20, "he": 30, "t": 5, "thecat": 1}, 1000
    for word in ("thecat", "hecat", "tthe", "xyz", "catx"):
        def cost(split):
            return sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in split)
        splits = []
        for cuts in product((0, 1), repeat=len(word) - 1):
            out, at = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    out.append(word[at:k])
                    at = k
            splits.append([*out, word[at:]])
        assert math.isclose(cost(url_filter.viterbi(word, counts, total)), max(map(cost, splits)))


def test_unwanted_hosts_are_blocked_also_when_concatenated(spark):
    rows = [(i, f"http://{'casino' if i % 20 == 0 else 'cat'}{'' if i % 40 == 0 else '-'}{'win' if i % 20 == 0 else 'dog'}.example.com/en/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    corpus = spark.createDataFrame([("the cat and the dog win " * 20,)], "text string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, corpus).collect()}
    assert all((got[i] == "block") == (i % 20 == 0) for i in range(400))


def test_parts_with_digits_are_segmented(spark):
    counts = spark.createDataFrame([("best", 50), ("free", 40), ("cat", 30), ("u", 5)], "word string, n long")
    parts = ["bestcasino24", "bet365", "freeporn4u", "2024", "cat", "24bestcat7free"]
    got = {r.part: r.words for r in url_filter.segment(spark.createDataFrame([(p,) for p in parts], "part string"), counts).collect()}
    assert got == {"bestcasino24": ["best", "casino", "<number>"], "bet365": ["bet", "<number>"], "freeporn4u": ["free", "porn", "<number>", "u"],
                   "2024": ["<number>"], "cat": ["cat"], "24bestcat7free": ["<number>", "best", "cat", "<number>", "free"]}


def test_unwanted_hosts_with_digits_are_blocked(spark):
    bad = ("bestcasino24", "bet365", "freeporn4u", "7casino")
    rows = [(i, f"http://{bad[i // 20 % 4] if i % 20 == 0 else f'cat{i}dog'}.example/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    corpus = spark.createDataFrame([("the cat and the dog win best free " * 20,)], "text string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, corpus).collect()}
    assert all((got[i] == "block") == (i % 20 == 0) for i in range(400))


def test_url_query_covers_all_pages(spark):
    out = queries.op7_url_filter(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/pages.parquet").count() and out.where("verdict is null").count() == 0


def _capture(n, url, day, hour, kind, etag=None, digest=None, **headers):
    at = datetime(2024, 1, day, hour) if day else None
    return (n, url, at, kind, {**({"etag": etag} if etag else {}), **headers}, digest)


def test_revisits_as_of_and_validators(spark):
    schema = "record_id long, url string, captured_at timestamp, kind string, headers map<string,string>, payload_digest string"
    u = "HTTP://WWW.a.org:80/p?b=2&a=1#x"
    rows = [_capture(1, u, 1, 1, "response", '"v1"', "d1", server="s", **{"content-length": "9"}), _capture(2, "http://a.org/p?a=1&b=2", 1, 2, "revisit", 'W/"v1"', None, server="t", **{"content-length": "0"}),
            _capture(3, u, 5, 0, "revisit", '"v1"'), _capture(4, u, 6, 0, "response", '"v2"', "d2"), _capture(5, u, 7, 0, "revisit", '"v1"'),
            _capture(6, "http://b.org", 1, 0, "revisit", '"q"'), _capture(7, None, 1, 0, "revisit"), _capture(8, u, 0, 0, "revisit"),
            _capture(9, "http://b.org/", 2, 0, "response", None, "d3"), _capture(10, "http://b.org", 2, 1, "revisit", None, "d3"), _capture(10, "http://b.org", 2, 1, "revisit", None, "d3"),
            _capture(11, "http://b.org", 2, 2, "revisit", None, None)]
    table = spark.createDataFrame(rows, schema).withColumn("number", F.lit("clash"))
    got = sorted((r.record_id, r.refers_to, r.outcome, r.payload_digest) for r in revisits.resolve(table).collect())
    assert got == [(2, 1, "resolved", "d1"), (3, 1, "resolved", "d1"), (5, 4, "validator_mismatch", None), (6, None, "no_response", None), (7, None, "no_response", None),
                   (8, None, "no_response", None), (10, 9, "resolved", "d3"), (10, 9, "resolved", "d3"), (11, 9, "validator_mismatch", None)]
    merged = revisits.resolve(table).where("record_id = 2").first().headers
    assert merged == {"etag": 'W/"v1"', "server": "t", "content-length": "9"}
    assert revisits.resolve(table.where("1 = 0")).count() == 0


def test_order_of_rows_does_not_change_revisits(spark):
    """Responses at one time: the largest record id, then digest, then headers decide; a URL's day is spread over partitions."""
    schema = "record_id long, url string, captured_at timestamp, kind string, headers map<string,string>, payload_digest string"
    rows = [_capture(i, "http://t.org/", 1, 1, "response", f'"{i}"', f"d{i}") for i in (20, 10, 30)] + [_capture(30, "http://t.org/", 1, 1, "response", '"x"', "d9"),
            _capture(30, "http://t.org/", 1, 1, "response", '"x"', None), _capture(40, "http://t.org/", 1, 1, "revisit", '"x"')]
    rows += [(100 + i, "http://hot.org/", datetime(2024, 1, 2, 0, i // 60, i % 60), "response" if i % 7 == 0 else "revisit", {"etag": f'"{i // 70}"'}, None) for i in range(900)]
    want = None
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = sorted((r.record_id, r.refers_to, r.outcome, r.payload_digest, str(r.headers)) for r in revisits.resolve(spark.createDataFrame(order, schema).repartition(3)).collect())
        want = want or got
        assert got == want
    assert want[0][:4] == (40, 30, "resolved", "d9")
    for record, refers, outcome, *_ in want[1:]:
        i = record - 100
        assert refers == 100 + i // 7 * 7 and outcome == ("resolved" if (i // 7 * 7) // 70 == i // 70 else "validator_mismatch")


def _blocked(spark, urls, texts, labels, **how):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, v) for i, v in enumerate(labels)] + [(None, 1), (0, None)], "doc_id long, toxic int")
    return {urls[r.page_id]: r for r in url_filter.judge(pages, corpus, labels=marks, **how).collect()}


def test_verdicts_that_no_list_gives(spark):
    """Blocked: words of toxic texts in concatenated names, and words that go with listed ones.  Allowed: a listed word inside another word."""
    clean, toxic = "the garden forum shows alphabet and recipes for sussex town " * 30, "you are scum and vermin the scum of the town vermin " * 30
    urls = [f"http://garden{k}.example/forum/{i}" for k in ("", "forum", "recipes", "town") for i in range(30)]
    urls += [f"http://{h}.example/{i}" for h in ("casino-jackpot", "jackpotpoker", "jackpot-bets") for i in range(4)]
    urls += ["http://scumvermin.example/", "http://vermin-scum.example/x", "http://jackpotjackpot.example/jackpot", "http://alphabet.example/sussex", "http://town.example/"]
    got = _blocked(spark, urls, [clean, clean, toxic, toxic], [0, 0, 1, 1])
    bad = {u for u in urls if got[u].verdict == "block"}
    assert {"http://scumvermin.example/", "http://vermin-scum.example/x", "http://jackpotjackpot.example/jackpot"} <= bad
    assert bad == {u for u in urls if any(w in u for w in ("scum", "casino", "poker", "bets", "jackpot"))}


def test_naive_bayes_equals_a_count_by_hand(spark):
    texts, labels = ["red red blue", "blue green", "green green red"], [1, 0, 0]
    urls = ["http://red-blue.x/1", "http://green.x/2", "http://casino.x/red", "http://blue-red.x/3"]
    got = _blocked(spark, urls, texts, labels, unwanted=("casino",), rules=())
    words = {u: [w if not w.isdigit() else "<number>" for w in u[7:].replace(".", "-").replace("/", "-").split("-")] for u in urls}
    listed = {u: "casino" in words[u] for u in urls}
    vocab = {w for ws in words.values() for w in ws}
    url_n = {c: {w: sum(words[u].count(w) for u in urls if listed[u] == c) for w in vocab} for c in (True, False)}
    text_n = {c: {w: sum(t.split().count(w) for t, v in zip(texts, labels) if bool(v) == c) for w in vocab} for c in (True, False)}
    all_text = {c: sum(len(t.split()) for t, v in zip(texts, labels) if bool(v) == c) for c in (True, False)}
    all_url = {c: sum(url_n[c].values()) for c in (True, False)}

    def log_p(w, c):
        return math.log((url_n[c][w] + text_n[c][w] * all_url[c] / all_text[c] + 1) / (2 * all_url[c] + len(vocab) + 1))

    for u in urls:
        odds = math.log(1 / 3) + sum(log_p(w, True) - log_p(w, False) for w in words[u])
        assert math.isclose(got[u].block_odds, odds, rel_tol=1e-9) and got[u].verdict == ("block" if odds > 0 else "allow")


def test_very_long_urls_and_words(spark, monkeypatch):
    """A path of a hundred thousand letters, words over blocks of a run, and words longer than any usual one."""
    long_word, alien = "donaudampfschifffahrtsgesellschaft", "zq" * 50
    counts = spark.createDataFrame([("the", 50), ("cat", 30), (long_word, 20)], "word string, n long")
    monkeypatch.setattr(url_filter, "BLOCK", 7)
    parts = [f"thecat{long_word}the", "cat" * 9, f"the{alien}", "x"]
    got = {r.part: r.words for r in url_filter.segment(spark.createDataFrame([(p,) for p in parts], "part string"), counts).collect()}
    assert got[parts[0]] == ["the", "cat", long_word, "the"] and got[parts[1]] == ["cat"] * 9 and got[parts[2]] == ["the", alien] and got["x"] == ["x"]
    monkeypatch.setattr(url_filter, "BLOCK", 1024)
    url = "http://cat.example/" + "thecat" * 17_000
    pages = spark.createDataFrame([(1, url), (1, url), (2, "http://cat.example/"), (None, None)], "page_id long, url string")
    out = url_filter.judge(pages, spark.createDataFrame([(1, "the cat " * 20)], "doc_id long, text string")).collect()
    assert len(out) == 4 and {r.verdict for r in out} == {"allow"}
