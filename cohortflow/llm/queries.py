"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, byte_bpe, chat, embedding_dedup, exact_dedup, mixing, packing, secrets, sharding, simhash, spelling, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PROBE = "<|im_end|><|im_start|>assistant ok"


@query("op1_chat_format", rf"""
    WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      sum(length(role) + 24 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars,
      regexp_full_match(string_agg(role, ',' ORDER BY turn, role, text), '(system,)?user,assistant(,user,assistant)*') AS valid
    FROM turns GROUP BY conv_id""")
def op1(spark, sf_dir):
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.chat_digests(chat.format_chats(turns))


@query("op2_embedding_near_dedup", """
    WITH RECURSIVE valid AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
    unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM valid),
    link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b
      ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND list_inner_product(a.u, b.u) >= 0.9),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
    SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links,
      least(vec_id, (SELECT min(b) FROM reach WHERE a = vec_id)) AS component_id,
      vec_id = least(vec_id, (SELECT min(b) FROM reach WHERE a = vec_id)) AS kept FROM embeddings""")
def op2(spark, sf_dir):
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


@query("op3_secret_scan")
def op3(spark, sf_dir):
    return secrets.secret_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


@query("op4_toxicity")
def op4(spark, sf_dir):
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op5_packing")
def op5(spark, sf_dir):
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_simhash_near_dedup")
def op6(spark, sf_dir):
    return simhash.simhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


#: Domains of the documents' sources and the weights that the mixing query aims at.
DOMAIN = "CASE WHEN right(source, 1) IN ('0', '2', '4', '6', '8') THEN 'web' ELSE 'books' END"
WEIGHTS = {"domain": {"web": 3, "books": 2}, "lang": {"en": 4, "de": 2}}


def fill_sql(source: str, parent: str, key: str, budget: str, out: str) -> str:
    """SQL of ``mixing.fill``."""
    over = f"PARTITION BY {parent}" if parent else ""
    return f"""(SELECT * EXCLUDE (_rank, _left, _open, _first, _num, _den), CASE WHEN _rank >= _first
        THEN (weight::HUGEINT * _num // _den)::BIGINT ELSE cap::BIGINT END AS {out} FROM (
      SELECT *, max(CASE WHEN _rank = _first THEN _left END) OVER ({over}) AS _num,
        max(CASE WHEN _rank = _first THEN _open END) OVER ({over}) AS _den FROM (
      SELECT *, min(CASE WHEN cap::HUGEINT * _open > weight::HUGEINT * _left THEN _rank END) OVER ({over}) AS _first FROM (
      SELECT *, row_number() OVER o AS _rank, {budget} - coalesce(sum(cap) OVER b, 0) AS _left,
        sum(weight) OVER ({over}) - coalesce(sum(weight) OVER b, 0) AS _open FROM {source}
      WINDOW o AS ({over} ORDER BY cap::DOUBLE / weight::DOUBLE, {key}),
        b AS ({over} ORDER BY cap::DOUBLE / weight::DOUBLE, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))))"""


MIX_SQL = rf"""
    WITH base AS (SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
        len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS tokens FROM documents),
    leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, 2 * sum(tokens)::BIGINT AS cap, 1 AS weight
      FROM base GROUP BY ALL),
    lang1 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 ELSE 1 END AS weight
      FROM leaf GROUP BY domain, lang),
    dom1 AS (SELECT domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'web' THEN 3 ELSE 2 END AS weight FROM lang1 GROUP BY domain),
    dom2 AS (SELECT *, least((SELECT sum(cap) FROM dom1), (SELECT floor(0.75::DOUBLE * sum(tokens)::DOUBLE) FROM leaf))::BIGINT AS total FROM dom1),
    dom3 AS (SELECT domain, domain_quota FROM {fill_sql("dom2", "", "domain", "total", "domain_quota")}),
    lang2 AS (SELECT * FROM lang1 JOIN dom3 USING (domain)),
    lang3 AS (SELECT domain, lang, lang_quota FROM {fill_sql("lang2", "domain", "lang", "domain_quota", "lang_quota")}),
    leaf2 AS (SELECT * FROM leaf JOIN lang3 USING (domain, lang)),
    plan AS (SELECT domain, lang, source, tokens AS leaf_tokens, quota FROM {fill_sql("leaf2", "domain, lang", "source", "lang_quota", "quota")}),
    drawn AS (SELECT doc_id, domain, lang, source, tokens, quota, leaf_tokens, unnest(range((quota + leaf_tokens - 1) // leaf_tokens)) AS epoch
      FROM base JOIN plan USING (domain, lang, source) WHERE quota > 0),
    placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch
        ORDER BY md5('7:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, tokens
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM drawn)
    SELECT doc_id, domain, lang, source, epoch, tokens, start, least(tokens, quota - epoch * leaf_tokens - start) AS taken
    FROM placed WHERE quota - epoch * leaf_tokens - start > 0""".replace("\\\\", "\\")


@query("op7_mix_sources", MIX_SQL)
def op7(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), F.expr(DOMAIN), weights=WEIGHTS)
    return mixed.drop("_id", "_null_id", "_text_key")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op8_jump_sharding", f"""
    WITH RECURSIVE table_step(i, k, c) AS (
      SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL
      SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM table_step WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM table_step WHERE k = 8),
    hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    sized AS (
      SELECT doc_id, length(h) // 2 + 1 AS size,
        xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(h) // 2),
            lambda i: ('0x' || h[(2 * i + 1):(2 * i + 2)])::BIGINT),
          lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) AS text_crc32
      FROM hexed, crc_table),
    jump(doc_id, state, b, j) AS (
      SELECT doc_id, (CASE WHEN coalesce(doc_id, 0) < 0 THEN coalesce(doc_id, 0)::HUGEINT + {sharding.WRAP}
                      ELSE coalesce(doc_id, 0)::HUGEINT END * {sharding.MULTIPLIER} + 1) % {sharding.WRAP}, -1, 0::BIGINT
      FROM (SELECT DISTINCT doc_id FROM documents) UNION ALL
      SELECT doc_id, (state * {sharding.MULTIPLIER} + 1) % {sharding.WRAP}, j,
        floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((state // 8589934592)::DOUBLE + 1)))::BIGINT
      FROM jump WHERE j < 17),
    placed AS (SELECT doc_id, max(j) FILTER (WHERE j < 16)::INT AS shard, max(j) FILTER (WHERE j < 17)::INT AS grown_shard,
        min(state // {sharding.WRAP // sharding.BUCKETS}) FILTER (WHERE b = -1) AS bucket FROM jump GROUP BY doc_id)
    SELECT s.doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
      row_number() OVER (PARTITION BY shard ORDER BY bucket, s.doc_id, text_crc32, size) - 1 AS slot
    FROM sized s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id""")
def op8(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op9_suffix_dedup")
def op9(spark, sf_dir):
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op10_exact_dedup", f"""
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
      doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, {LOWER} AS t FROM documents) WINDOW g AS (PARTITION BY t)""")
def op10(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


VARIANTS_SQL = rf"""
    WITH RECURSIVE table_step(i, k, c) AS (
      SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL
      SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM table_step WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM table_step WHERE k = 8),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    own AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs GROUP BY ALL),
    hashed AS (SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(h) // 2),
        lambda i: ('0x' || h[(2 * i + 1):(2 * i + 2)])::BIGINT),
        lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) AS crc FROM own, crc_table),
    slipped AS (SELECT CASE WHEN crc % 97 = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    place AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
    less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM place),
    near AS (
      SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, max(near_n) AS most, min(near) FILTER (WHERE near_n = top) AS near
      FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
    forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN near END AS form,
      CASE WHEN most >= 2 * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)),
    path(word, root, step) AS (SELECT word, word, 0 FROM forms UNION ALL
      SELECT p.word, f.form, step + 1 FROM path p JOIN forms f ON p.root = f.word WHERE f.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, step) AS root FROM path GROUP BY word) USING (word)"""


@query("op11_spelling_variants", VARIANTS_SQL)
def op11(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_token_alignment")
def op12(spark, sf_dir):
    import public_tokenizers

    found = alignment.link_statistics(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                      public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


@query("op13_byte_bpe")
def op13(spark, sf_dir):
    import public_tokenizers

    return byte_bpe.bpe_digest(byte_bpe.byte_bpe(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
