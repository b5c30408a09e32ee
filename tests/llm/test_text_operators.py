from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from hourglass.llm import decontaminate, queries, toxicity
from hourglass.llm.html_render import extract_text, render
from hourglass.llm.levenshtein import TrieAutomaton, default_edits
from hourglass.llm.suffix_automaton import ItemAutomaton
from tests.conftest import SF, SF01


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_trie_automaton_equals_edit_distance():
    rng = random.Random(4)
    for _ in range(25):
        terms = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 11))) for _ in range(8)]
        automaton = TrieAutomaton(terms)
        for _ in range(40):
            word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))
            best = min(((_distance(word, t), t) for t in terms if _distance(word, t) <= default_edits(t)), default=None)
            assert automaton.match(word) == (best and (best[1], best[0]))


def test_suffix_automaton_equals_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        words = [b"abcdefgh"[i:i + 1] for i in range(rng.randint(2, 6))]
        window = rng.randint(2, 5)
        items = [(str(i), [rng.choice(words) for _ in range(rng.randint(0, 9))]) for i in range(rng.randint(0, 6))]
        text = [rng.choice([*words, b"z"]) for _ in range(40)]
        hit, found = np.zeros(40, bool), set()
        ItemAutomaton(items, window).scan(text, hit, found)
        want_hit, want = np.zeros(40, bool), set()
        for name, w in items:
            for gram in [w[i:i + window] for i in range(len(w) - window + 1)] or ([w] if w else []):
                for i in range(40 - len(gram) + 1):
                    if text[i:i + len(gram)] == gram:
                        want_hit[i:i + len(gram)] = True
                        want.add(name)
        assert (hit == want_hit).all() and found == want


def test_decontamination_spans_blocks_and_odd_rows(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, "A bc é, dé ef! gh. ij kl mn op"), (2, None), (3, ""), (3, ""), (4, "x y z q"), (None, "Dé ef gh nö x y z more words éé")],
                                 "doc_id long, text string").withColumn("hits", F.lit("clash"))
    bench = spark.createDataFrame([("i1", "dé ef gh"), ("i2", "x y"), (None, "kl mn"), ("i4", None), ("i5", "!!")], "item_id string, text string")
    for block_words in (10_000, 2):
        found = {r.text: r.hits for r in decontaminate.find_contamination(docs, bench, window=3, block_words=block_words).collect()}
        assert [found["x y z q"][k] for k in ("n_words", "n_hit", "items")] == [4, 2, ["i2"]]
        assert found["A bc é, dé ef! gh. ij kl mn op"]["n_hit"] == 5
    clean = decontaminate.decontaminate(docs.drop("hits"), bench, window=3)
    assert sorted(r.text or "" for r in clean.collect()) == ["", "", "", " nö  z more words éé", " z q", "A bc é, . ij  op"]
    assert decontaminate.decontaminate(odd_docs, bench).exceptAll(odd_docs).count() == 0
    assert decontaminate.decontaminate(odd_docs, bench.where("1 = 0")).count() == odd_docs.count()
    assert decontaminate.decontaminate(no_docs, bench).count() == 0


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = queries.op6_toxicity(spark, SF01).join(labels, "doc_id").where("held_out").collect()
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted for r in rows if not r.toxic)
    assert caught > 0.7 and wrong <= 0.02 * len(rows)


def _plain_lexicon(rows):
    """Terms and clean spellings by the definition, over lists of texts and labels."""
    seen = {}
    for text, toxic in rows:
        words = re.findall(r"[^\W_]+(?:[@$*!][^\W_]+)*", (text or "").lower())
        for k, word in enumerate(words):
            key = word, words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""
            seen[key] = max(seen.get(key, 0), toxic)
    counts = {}
    for (word, _, _), toxic in seen.items():
        counts.setdefault(word, [0, 0])[1 - toxic] += 1
    a, b = (sum(c[i] for c in counts.values()) for i in (0, 1))
    p = a / (a + b)
    terms = set()
    for word, (x, y) in counts.items():
        ratio = 2 * ((x * math.log(x / (x + y) / p) if x else 0) + (y * math.log(y / (x + y) / (1 - p)) if y else 0))
        if x / (x + y + 0.5) >= 0.85 and x >= 0.9 * (x + y) and ratio >= 2 * math.log(len(counts) / 0.01):
            terms.add(word)
    clean = {w for w, (x, y) in counts.items() if y >= 2 and x < 0.9 * (x + y) and w not in terms
             and any(abs(len(w) - len(t)) <= 2 and _distance(w, t) <= default_edits(t) for t in terms)}
    return terms, clean


def test_lexicon_equals_its_definition(spark):
    rng = random.Random(9)
    common = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    bad = ["scum", "worthles", "zz", "z" * 50]
    rows = []
    for i in range(200):
        words = [rng.choice(common) for _ in range(60)]
        if i % 4 == 0:
            words = [w if rng.random() < 0.6 else rng.choice(bad) for w in words]
        elif i % 3 == 0:
            words[rng.randrange(60)] = rng.choice(["scam", "worthies"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    rows += [(300, None, 0), (301, "", 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    terms, clean = _plain_lexicon([(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1])
    assert set(bad) <= terms == set(model.terms) and {"scam", "worthies"} <= clean == model.clean


def test_lexicon_has_no_limit_of_terms(spark):
    rng = random.Random(4)
    bad = [f"bad{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6] * (i // 600 + 2)}" for i in range(2400)]
    texts = []
    for i in range(2000):
        words = rng.sample(bad, 150) if i % 2 else [f"w{rng.randrange(900)}" for _ in range(150)]
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    assert set(toxicity.learn(docs, labels).terms) == set(bad)


def test_logistic_weights_are_the_optimum():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(80, 3)), rng.integers(0, 2, 80).astype(float)
    w = np.array(toxicity.fit_logistic(x, y, ridge=0.1))
    ones = np.column_stack((x, np.ones(80)))
    slope = ones.T @ (1 / (1 + np.exp(-ones @ w)) - y) + np.array([0.1, 0.1, 0.1, 1e-6]) * w
    assert np.abs(slope).max() < 1e-6


def test_context_windows_and_misspellings():
    matcher = toxicity.Matcher(toxicity.Model(["worthless", "idiot"], frozenset({"idiom"})))
    exact, fuzzy, quoted, _, directed = toxicity.hit_features("You idiot, you are w0rthless idiom", matcher)
    assert exact > 0 and fuzzy > 0 and directed > 0 and quoted == 0
    exact, _, quoted, _, _ = toxicity.hit_features('The "worthless idiot" of the play', matcher)
    assert exact == 0 and quoted > 0
    assert toxicity.hit_features(None, matcher) == toxicity.hit_features("", matcher) == [0.0] * 5


def test_misspellings_of_four_letter_terms():
    matcher = toxicity.Matcher(toxicity.Model(["scum", "ass"], frozenset({"scam"})))
    assert [matcher.kind(w) for w in ("scum", "sc*m", "scumm", "scu", "scam", "sc**m", "as", "asss")] == [2, 1, 1, 1, 0, 0, 0, 0]


def test_quotations_of_any_length():
    matcher = toxicity.Matcher(toxicity.Model(["worthless"]))
    long = "some other things " * 20

    def counts(text):
        exact, _, quoted, _, _ = toxicity.hit_features(text, matcher)
        return exact > 0, quoted > 0

    for a, b in ('""', "«»", "“”", "„“", "‹›"):
        assert counts(f"x {a}{long}worthless {long}{b} y") == (False, True)
        assert counts(f"x {a}{long}{b} worthless y {a}{long}{b}") == (True, False)
        assert counts(f"x {a}{long} worthless\n y{b}") == (True, False)
        assert counts(f"x {a}b{b} worthless {a}") == (True, False)
    assert counts('x «a "worthless" b» y «c» worthless') == (True, True)


def test_quoted_spans_are_in_order_and_apart():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice('"«»“”„‹›\na') for _ in range(rng.randint(0, 25)))
        spans = toxicity.quoted_spans(text)
        assert all(a < b and "\n" not in text[a:b] for a, b in spans)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))  # noqa: B905


def test_training_rows_of_repeated_ids_are_bounded(spark):
    rows = [(7, f"text {i}") for i in range(500)] + [(8, "same")] * 500 + [(i, f"doc {i}") for i in range(10, 200)] + [(9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    kept = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert {7, 8, 9} <= set(kept)
    got = toxicity.training_rows(docs, labels).collect()
    assert len(got) == toxicity.MAX_PER_ID + 2 + sum(i >= 10 for i in kept)
    assert sum(r.text == "same" for r in got) == 1 and sum((r.text or "").startswith("text ") for r in got) == toxicity.MAX_PER_ID
    assert toxicity.training_rows(docs, labels, 20).count() <= 20


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (None, 1), (3, None), (5, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.learn(odd_docs, labels)
    scored = toxicity.score(odd_docs, model).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.drop_toxic(odd_docs.withColumn("score", F.lit("x")), labels.where("1 = 0")).columns == [*odd_docs.columns, "score"]
    assert toxicity.drop_toxic(no_docs, labels).count() == 0


def test_html_layout():
    page = """<!doctype html><head><title>x</title><style>.ad,#z{display : none}</style><script>var a="</p>";</script><body>Hi <b>there</b>
<p>one<p>two <br>three<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>x<li value=7>y<li>z</ol><div class=ad>AD</div>
<div style="visibility:hidden">no<span style="visibility:visible">yes</span></div>
<table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>wide cell<tr><td>b<br>c<td>4</table><pre> keep
   this</pre><dl><dt>t<dd>def</dl><div hidden>h</div>a<div>b</div>c&amp;d<p>end</p><a href="x>y">q</a>"""
    assert render(page).split("\n") == [
        "Hi there", "", "one", "", "two", "three", "", "- a", "- b", "  - c", "- d", "", "3. x", "7. y", "8. z", "", "yes", "", "Cap",
        "Name       Qty", "apple pie  3", "wide cell", "b          4", "c", "", " keep", "   this", "", "t", "  def", "", "a", "b", "c&d", "", "end", "", "q"]


def _styled(css: str, page: str = '<p class="nav">text', media: str = "") -> str:
    return render(f"<style{media}>{css}</style>{page}")


def test_html_rules_of_print_and_other_screens_hide_nothing():
    for css in ("@media print{.nav{display:none}}", "@media (max-width:600px){.nav{display:none}}", "@media screen and (max-width: 40em){p{display:none}}",
                "@media (width < 600px){.nav{display:none}}", "@media not all and (min-width:600px){.nav{display:none}}", "@media tv, print{.nav{display:none}}",
                "@media screen{@media print{.nav{display:none}}}", "@supports not (display:grid){.nav{display:none}}", "@container (width>1px){.nav{display:none}}",
                ".nav{display:none}@media (min-width:600px){.nav{display:block}}", ".nav{@media print{display:none}}", ".nav{.x{display:none}}",
                "@media (unknown:1){.nav{display:none}}", "@keyframes a{p{visibility:hidden}}", ":not(b,.nav,i){display:none}"):
        assert _styled(css) == "text", css
    assert _styled(".nav{display:none}", media=' media="print"') == "text"
    assert render('<noscript><style>.nav{display:none}</style></noscript><p class="nav">text') == "text"
    for css in (".nav{display:none}", "@media screen{.nav{display:none}}", "@media (min-width:600px) and (orientation:landscape){.nav{display:none}}",
                "@media print, (600px <= width <= 90em){.nav{display:none}}", "@media not print{.nav{display:none}}", "@supports (display:grid){.nav{display:none}}",
                "@import 'a;b.css';@media print{a{color:red}}.nav{display:none}", "b,P{color:red;display : none !important}.nav{display:block}", ".nav{display:none"):
        assert _styled(css) == "", css


def test_html_only_display_and_visibility_hide():
    for css in ("-webkit-backface-visibility:hidden", "backface-visibility:hidden", "content-visibility:hidden", "--display:none", "content:';display:none'",
                "background:url(a;display:none)", "visibility:hidden;visibility:visible", "display:none;display:block", "/*display:none*/color:red", "visibility:odd"):
        assert _styled(f".nav{{{css}}}") == "text", css
        assert render(f'<p style="{css}">text') == "text", css
    assert render('<div style="VISIBILITY : Hidden">no<b style="visibility:visible">yes</b></div>') == "yes"
    assert _styled("#a{display:block}.nav{display:none}", '<p id="a" class="nav">text') == "text"


def test_html_form_text():
    assert render("a <textarea>\nx &lt; <b>y\n  z</textarea> c") == "a x < <b>y\n  z c"
    assert render("<xmp><b>&amp;</xmp>") == "<b>&amp;"
    assert render("<select><optgroup label=g><option>a<option selected>b<optgroup label=h><option>c</select>") == "b"
    assert render("<select><optgroup disabled><option>a</optgroup><option>b<option>c</select>") == "b"
    assert render("<select><option hidden selected>pick<option>b</select>") == "pick" and render("<select size=3><option>a<option>b</select>") == "a\nb"


def test_html_odd_pages(spark):
    assert render(None) == render("") == render("<p><div></div>") == ""
    assert render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert render('<a title="open>text') .endswith("text") and render("a < b") == "a < b"
    assert render("<table><td>x<table><tr><td>in</table><td>y") == "x   y\n\nin"
    pages = spark.createDataFrame([(1, None, "t"), (1, "<p>a", "t")], "page_id long, html string, text string")
    assert sorted(r.text for r in extract_text(pages).collect()) == ["", "a"]
    assert extract_text(pages.where("1 = 0")).count() == 0


def test_html_stray_quotes_are_no_text():
    assert render('<p title="a"">Hello') == render("<p title=it's>Hello") == render('<p "x">Hello') == render("<p title = 'a>b' x=\"c>d\">Hello") == "Hello"
    assert render("<a href=x=\"y>Hello</a> world") == "Hello world" and render("<p a=>Hello") == "Hello" and render("<p a='>Hello") == "Hello"


def test_html_cells_that_span_rows():
    assert render("<table><tr><td rowspan=2>A<td>B<td>C<tr><td>D<td>E</table>") == "A  B  C\n   D  E"
    assert render("<table><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>") == "a  b   c\nd      e\nf      g"
    assert render("<table><tr><td>x<td rowspan=9>y<tr><td>z</table>") == "x  y\nz"


def test_html_values_of_inputs():
    assert render('<form>Name <input value="Ann"><input type=hidden value=h><input type=submit value="Send it"><input placeholder=City><input type=checkbox value=on> yes') == "Name Ann Send it City yes"


def test_html_query_over_all_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op8_html_render(spark, SF).collect()
    assert len(got) == len(pages) and all(r.text == render(pages[r.page_id]) and "<p" not in r.text and r.text for r in got)
