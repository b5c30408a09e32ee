"""One query per operator over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.llm import (bpe_stream, chat_collapse, decontaminate, html_render, prefix_trie, radix_dedup, revisits, simhash_golay,
                           spelling_variants, toxicity, training_order, url_filter, vector_packing)

END_ID = 2
ORDER_KEY = 20240607


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' sequences in training order, read every shard back, and return one row per document part with both checksums."""
    path = training_order.new_path(spark)
    index = training_order.write_training_order(_read(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_path(), END_ID, ORDER_KEY)
    back = training_order.read_training_order(spark, path).select("slot", F.crc32("record").alias("read_crc32"))
    parts = index.join(back, "slot", "left").select("*", F.posexplode("segments").alias("segment", "part"))
    return parts.select("slot", "shard", "byte_offset", "n_ids", "segment", F.col("part.id").alias("doc_id"), F.col("part.start").alias("start"),
                        F.col("part.length").alias("length"), "crc32", "read_crc32")


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    rows = simhash_golay.near_duplicates(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash_golay.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op3_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return chat_collapse.collapse(_read(spark, sf_dir, "conversations"))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 4096 tokens."""
    packed = vector_packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays for it."""
    return radix_dedup.decisions(_read(spark, sf_dir, "documents").select("doc_id", "text"), text=radix_dedup.squeeze(F.col("text")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; rows with crc32(doc_id) modulo 3 = 1 are held out."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    judged = url_filter.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), _read(spark, sf_dir, "documents"), labels=_read(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_odds")


def op8_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_render.extract_text(_read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


def captures(pages: DataFrame) -> DataFrame:
    """Stand-in archive records for the pages table: up to four captures of each page, a few hours apart.

    The first is a full response, later ones are revisits or, for some
    pages, a second response with another entity tag.
    """
    k = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k")
    rows = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), k)
    again = (F.col("k") == 2) & (F.col("page_id") % 4 == 0)
    kind = F.when((F.col("k") == 0) | again, "response").otherwise("revisit")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 61 % 864000 + F.col("k") * (F.col("page_id") % 40 + 1) * 3600)
    version = F.when(again | ((F.col("k") == 3) & (F.col("page_id") % 8 == 0)), "2").otherwise("1")
    headers = F.create_map(F.lit("etag"), F.concat(F.lit('"'), F.substring("digest", 1, 8), F.lit("-"), version, F.lit('"')),
                           F.lit("date"), F.date_format(at, "yyyy-MM-dd HH:mm:ss"),
                           F.lit("content-length"), F.when(kind == "response", "100").otherwise("0"))
    return rows.select((F.col("page_id") * 4 + F.col("k")).alias("record_id"), "url", at.alias("captured_at"), kind.alias("kind"),
                       headers.alias("headers"), F.when(kind == "response", F.col("digest")).alias("payload_digest"))


def op9_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit record with the response it refers to and its merged headers."""
    out = revisits.resolve(captures(_read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return out.select("record_id", "canonical_url", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured_at"), "refers_to", "outcome",
                      F.expr("headers['etag']").alias("etag"), F.expr("headers['date']").alias("date"),
                      F.expr("headers['content-length']").alias("content_length"), "payload_digest")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    found = decontaminate.find_contamination(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each begun with the first turns of the first conversation of its five."""
    rows, conversations = prefix_trie.number_turns(_read(spark, sf_dir, "conversations"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    return prefix_trie.trie(*prefix_trie.splice_heads(rows, conversations, head, base, reach=4, most=8))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent words of all documents, after deletions that a checksum picks, with their near words, form and root."""
    runs = spelling_variants.letter_runs(_read(spark, sf_dir, "documents"))
    words = runs.select(spelling_variants.drop_letters(runs, every=199).alias("word"))
    return spelling_variants.variants(spelling_variants.count_words(words, min_length=6, min_count=5), ratio=5)


def byte_tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the streaming transducer and decoded again, as digests."""
    return bpe_stream.round_trip(_read(spark, sf_dir, "documents"), byte_tokenizer_path())


QUERIES = {f.__name__: f for f in (
    op1_training_order, op2_simhash_golay, op3_chat_collapse, op4_vector_packing, op5_radix_dedup, op6_toxicity,
    op7_url_filter, op8_html_render, op9_revisit_resolution, op10_decontaminate, op11_conversation_trie, op12_spelling_variants, op13_bpe_round_trip)}

# CRC-32 of a list of bytes, table driven; the table is made from the polynomial.
CRC_TABLE_SQL = """crc_table AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i,
  list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(byte_list: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], {byte_list}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE_SQL = {
    "op11_conversation_trie": f"""
WITH {CRC_TABLE_SQL},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc_sql("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))")} % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM t), crc_table),
joined AS (SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
           UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
r AS (SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS n_bytes, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER w) AS path
      FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT conv_id, depth, n_bytes, path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM e GROUP BY depth, path),
parent AS (SELECT a.*, up.conv_id AS parent_conv_id, up.path AS parent_path FROM n a
           LEFT JOIN p x ON x.conv_id = a.conv_id AND x.depth = a.depth - 1 LEFT JOIN n up ON up.depth = x.depth AND up.path = x.path),
kids AS (SELECT depth - 1 AS depth, parent_path AS path, count(*) AS n_children FROM parent WHERE depth > 0 GROUP BY ALL),
own AS (SELECT parent.*, coalesce(n_children, 0) AS n_children FROM parent LEFT JOIN kids USING (depth, path)),
sub AS (SELECT p.depth, p.path, count(*) FILTER (WHERE o.n_children = 0) AS n_leaves, CAST(sum((o.n_convs - 1) * o.n_bytes) AS BIGINT) AS saved_tokens
        FROM p JOIN own o ON o.conv_id = p.conv_id AND o.depth >= p.depth GROUP BY p.depth, p.path)
SELECT own.conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM own JOIN sub USING (depth, path)""",
    "op3_chat_collapse": """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
             md5(string_agg(md5(role || chr(31) || text), '') OVER w) AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
whole AS (SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM o WHERE pos = n GROUP BY n, prefix),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.pos < o.n AND o.pos = w.n AND o.prefix = w.prefix))
SELECT k.conv_id, CAST(floor(o.turn / 256) AS BIGINT) AS part, k.n AS n_turns, k.n_copies,
       string_agg('<|im_start|>' || o.role || chr(10) || o.text || '<|im_end|>' || chr(10), '' ORDER BY o.pos) AS text
FROM kept k JOIN o ON o.conv_id = k.conv_id GROUP BY ALL""",
    "op12_spelling_variants": f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY doc_id, run),
coded AS (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, k, {crc_sql("list_transform(range(1, length(x), 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(x, i, 1)) - 1) + instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 1 AS BIGINT))")} AS h
           FROM coded, crc_table),
counted AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n
            FROM hashed GROUP BY 1),
words AS MATERIALIZED (SELECT word, n FROM counted WHERE length(word) >= 6 AND n >= 5),
skips AS (SELECT word, n, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s, i = 1 OR substr(word, i, 1) <> substr(word, i - 1, 1) AS first
          FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
cuts AS (SELECT a.word AS long, a.n AS long_n, b.word AS short, b.n AS short_n FROM skips a JOIN words b ON b.word = a.p || a.s WHERE a.first),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM skips a JOIN skips b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
         UNION ALL SELECT long, short, short_n FROM cuts UNION ALL SELECT short, long, long_n FROM cuts),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
           FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
last AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM formed f JOIN last l USING (word)""",
    "op5_radix_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op9_revisit_resolution": r"""
WITH c AS (
  SELECT page_id, k, url, md5(coalesce(html, '')) AS digest,
         to_timestamp(1704067200 + page_id * 61 % 864000 + k * (page_id % 40 + 1) * 3600) AT TIME ZONE 'UTC' AS taken,
         (k = 0 OR (k = 2 AND page_id % 4 = 0)) AS full_response,
         CASE WHEN (k = 2 AND page_id % 4 = 0) OR (k = 3 AND page_id % 8 = 0) THEN '2' ELSE '1' END AS version
  FROM pages, (SELECT unnest([0, 1, 2, 3]) AS k)),
u AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM c),
p AS (SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
         regexp_replace(lower(regexp_extract(bare, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.', '') AS host,
         regexp_extract(bare, '^[^:/?#]+://[^/?#]*([^?]*)', 1) AS path, regexp_extract(bare, '\?(.*)$', 1) AS query FROM u),
r AS (SELECT *, CASE WHEN scheme = '' THEN bare ELSE
         (CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END)
         || CASE WHEN path = '' THEN '/' ELSE path END
         || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END END AS curl,
         page_id * 4 + k AS record_id, '"' || substring(digest, 1, 8) || '-' || version || '"' AS etag FROM p),
j AS (SELECT v.*, f.record_id AS refers_to, f.etag AS stored_etag, f.digest AS stored_digest
      FROM (SELECT * FROM r WHERE NOT full_response) v
      ASOF LEFT JOIN (SELECT * FROM r WHERE full_response QUALIFY row_number() OVER (PARTITION BY curl, taken ORDER BY record_id DESC, digest DESC) = 1) f ON v.curl = f.curl AND v.taken >= f.taken),
q AS (SELECT *, CASE WHEN refers_to IS NULL THEN 'no_response' WHEN etag = stored_etag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM j)
SELECT record_id, curl AS canonical_url, strftime(taken, '%Y-%m-%d %H:%M:%S') AS captured_at, refers_to, outcome, etag,
       strftime(taken, '%Y-%m-%d %H:%M:%S') AS date, CASE WHEN outcome = 'resolved' THEN '100' ELSE '0' END AS content_length,
       CASE WHEN outcome = 'resolved' THEN stored_digest END AS payload_digest FROM q""",
    "op10_decontaminate": r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, fold),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, fold),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
          FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT g.doc_id, g.i, g.size, win.item_id FROM grams g JOIN win ON win.gram = g.gram AND win.size = g.size),
hit AS (SELECT doc_id, count(DISTINCT word_no) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word_no FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
