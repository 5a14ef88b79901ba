"""The registered queries of the corpus operators and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave.llm import (
    chat, decontaminate, embedding, fim, html, language, line_dedup, minhash, mixing, negatives, packing, quality, warc)
from assetweave.llm.common import reach_workers

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _ORACLES[fn.__name__] = sql
        return fn
    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query()
def op1_language_id(spark, sf_dir):
    """Language of every document, learned from labelled documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(language.training_rows(docs), tokenizer_file("piece_bpe_32k.model"))
    return language.predict(docs.withColumn("held_out", language.held_out()), model, "doc_id", "held_out")


LINE_DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS pos, unnest(p) AS line
   FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
 f AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS x FROM l),
 n AS (SELECT doc_id, pos, x, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM f WHERE x <> ''),
 w AS (SELECT * FROM (SELECT doc_id, i, x || chr(10) || lead(x, 1) OVER o || chr(10) || lead(x, 2) OVER o AS win
   FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE win IS NOT NULL),
 r AS (SELECT *, first_value(doc_id) OVER o AS d1, first_value(i) OVER o AS i1 FROM w
   WINDOW o AS (PARTITION BY win ORDER BY doc_id, i)),
 s AS (SELECT doc_id, CASE WHEN doc_id = d1 THEN greatest(i, i1 + 3) ELSE i END AS a, i + 2 AS b FROM r
   WHERE NOT (doc_id = d1 AND i = i1)),
 g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM s WHERE a <= b),
 k AS (SELECT n.doc_id, n.pos FROM n JOIN g USING (doc_id, i)),
 t AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text FROM l ANTI JOIN k USING (doc_id, pos) GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
 coalesce((SELECT count(*) FROM n WHERE n.doc_id = d.doc_id), 0) AS n_lines,
 coalesce((SELECT count(*) FROM k WHERE k.doc_id = d.doc_id), 0) AS n_removed
FROM documents d LEFT JOIN t USING (doc_id)"""


@query(LINE_DEDUP_SQL)
def op2_line_dedup(spark, sf_dir):
    """Documents without passages of three lines and more that occurred before."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"))


def packed_digests(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op3_packing(spark, sf_dir):
    """All documents packed into sequences of 1024 tokens with lexical neighbours."""
    return packed_digests(table(spark, sf_dir, "documents"))


DECONTAMINATE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
 b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
 bw AS (SELECT DISTINCT item_id, array_to_string(w[s:s+9], ' ') AS win, least(len(w), 10) AS n
   FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT n FROM bw),
 dw AS (SELECT doc_id, p, n, array_to_string(w[p:p+n-1], ' ') AS win
   FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d), sizes WHERE p + n - 1 <= len(w)),
 hits AS (SELECT doc_id, p, bw.n AS n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
 words AS (SELECT doc_id, count(DISTINCT q) AS n_hit
   FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i COLLATE C) AS ids
   FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""".replace(" COLLATE C", "")


@query(DECONTAMINATE_SQL)
def op4_decontaminate(spark, sf_dir):
    """Documents whose words contain windows of benchmark items."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
   UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
   UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
 e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|'))
   + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 24 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), ''))
   AS loss_sha256,
 CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


@query(CHAT_SQL)
def op10_chat(spark, sf_dir):
    """All conversations formatted, read back and digested; conversation -1 comes in another layout."""
    odd = "<|im_end|><|im_start|>assistant ok"
    records = chat.conversations_as_messages(table(spark, sf_dir, "conversations")).unionByName(
        spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(odd).alias("prompt"), F.lit(odd).alias("completion")),
        allowMissingColumns=True)
    read = chat.parse_formatted(chat.format_conversations(records))
    lost = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256)
        .alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query()
def op5_quality(spark, sf_dir):
    """Quality score of every document from two views that have taught each other."""
    return quality.learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op6_html(spark, sf_dir):
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
   AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 p AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a, v b
   WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
 r AS (SELECT vec_id AS s, vec_id AS t FROM embeddings UNION SELECT r.s, p.w FROM r JOIN p ON r.t = p.u),
 c AS (SELECT s AS vec_id, min(t) AS component_id FROM r GROUP BY s)
SELECT c.vec_id, (SELECT count(*) FROM p WHERE p.u = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c"""


@query(EMBEDDING_SQL)
def op7_embedding_dedup(spark, sf_dir):
    """Links and components of near vectors."""
    return embedding.link_vectors(table(spark, sf_dir, "embeddings"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS s FROM p),
 d AS (SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
   (CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INT), 1)), 'string_agg', '')
   AS payload_digest, max(page_id) OVER (PARTITION BY s) AS first FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""


@query(WARC_SQL)
def op8_warc(spark, sf_dir):
    """Pages written to Zstandard WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op9_minhash(spark, sf_dir):
    """Class of near-duplicates of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


FIM_SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 d AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
   ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM h),
 c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
 p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


@query(FIM_SQL)
def op11_fim(spark, sf_dir):
    """All documents rearranged for filling in the middle, and taken apart again."""
    moved = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
   ('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS o FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
 r AS (SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER e, 0) AS words,
   sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight
   FROM w WINDOW e AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (SELECT source, source_size, w, 3 * source_size * weight < w * words AS clamped FROM r),
 l AS (SELECT (SELECT sum(source_size) FROM s) - coalesce(sum(CASE WHEN clamped THEN 3 * source_size END), 0) AS words,
   sum(CASE WHEN clamped THEN 0 ELSE w END) AS weight FROM c),
 t AS (SELECT source, source_size, CASE WHEN clamped THEN 3.0::DOUBLE * source_size ELSE (w * words)::DOUBLE / weight::DOUBLE END AS target FROM c, l),
 g AS (SELECT *, CAST(least(round(target), 3 * source_size) AS BIGINT) AS goal FROM t),
 p AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole,
   CASE WHEN source_size > 0 THEN goal % source_size ELSE 0 END AS rest,
   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, d.doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p"""


@query(MIXING_SQL)
def op12_mixing(spark, sf_dir):
    """All documents mixed by source, three times at most."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
   list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
   FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 pos AS (SELECT a, b, score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
 neg AS (SELECT pos.a, pos.b, pos.score AS ps, p.b AS n, p.score AS ns,
   row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY p.score DESC, p.b) AS k
   FROM pos JOIN p ON p.a = pos.a AND NOT p.same AND 50 * pos.score <= 100 * p.score AND 100 * p.score <= 95 * pos.score)
SELECT a AS anchor_id, b AS positive_id, CAST(k AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM neg WHERE k <= 3"""


@query(NEGATIVES_SQL)
def op13_negatives(spark, sf_dir):
    """Hard negatives for every fiftieth vector; labels of every seventh are moved on."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)
