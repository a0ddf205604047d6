"""One query per operator over the driver's tables, with DuckDB SQL where SQL can state it."""

from __future__ import annotations

import hashlib
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, jaccard, langid, quality, repeats, resample, sharding, tokenbin, trie, urlfilter, viterbi
from .common import Workspace, held_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Fixed values of the URL query.
URL_RULES = [urlfilter.Rule("allow", "com", "/"), urlfilter.Rule("block", "example.com", "/en/"),
             urlfilter.Rule("allow", "www.example.com", "/en/"), urlfilter.Rule("block", "net", "/es/"),
             urlfilter.Rule("block", "net", "/fr/")]
QUALITY_THRESHOLD = 0.7


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@register("op1_learned_partitions")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(spark, rows, rows.filter(F.col("vec_id") % 20 == 0), id_col="vec_id", vector_col="embedding", k=20)


@register("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id")), "text", "lang")
    found = langid.predict(spark, docs.select("doc_id", "text"), "text", model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "fits")


def quality_model(docs: DataFrame, labels: DataFrame, features: str) -> quality.QualityModel:
    """Fit on the labelled rows of ``docs`` (doc_id, features) outside the test fold."""
    known = quality.label_table(labels, "doc_id", "quality")
    rows = docs.filter(~held_out("doc_id")).join(known, F.col("doc_id") == F.col("label_id"))
    return quality.fit_sample(rows, features, "y", "doc_id")


@register("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ws = Workspace(spark, "quality")
    measured = ws.save(quality.with_statistics(docs, "text", "x").select("doc_id", "x"), "statistics")
    model = quality_model(measured, table(spark, sf_dir, "labels"), "x")
    scored = quality.with_scores(spark, measured, "x", "score", model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("op4_ngram_jaccard", rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT DISTINCT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x),
c AS (SELECT node, min(seen) AS c FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard.groups(spark, table(spark, sf_dir, "documents"), "doc_id", "text", n=4, percent=85)
    return got.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@register("op5_token_planes")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(spark, table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary("byte_bpe_50k.json"), end_id=0)


@register("op6_byte_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.assign(spark, table(spark, sf_dir, "documents"), "doc_id", "text", shards=24)
    return got.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@register("op7_piece_viterbi")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.with_ids(table(spark, sf_dir, "documents"), "text", vocabulary("piece_bpe_32k.model"), only=("doc_id",), digests=True)


@register("op8_decontaminate", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, unnest(list_transform(range(1, greatest(len(ws) - 8, 2)),
        lambda i: ws[i:i + least(len(ws), 10) - 1])) AS g FROM b WHERE len(ws) > 0),
g AS (SELECT doc_id, n, i, ws[i:i + n - 1] AS g FROM (
        SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w))),
m AS (SELECT g.doc_id, w.item_id, g.i, g.n FROM g JOIN w ON g.g = w.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.ws), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), id_col="doc_id",
                                   text_col="text", item_id="item_id", item_text="text", window=10, unnamed=True)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return found.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_CONFLICT = "</s>[INST] ok [/INST]"


@register("op9_chat_round_trip", rf"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{_CONFLICT}' UNION ALL SELECT -7, 1, 'assistant', '{_CONFLICT}'),
f AS (
    SELECT *, length(regexp_replace(regexp_replace(regexp_replace(text, '&(amp|lt|lb|rb);', '&amp;\1;', 'g'),
            '<(/?s>)', '&lt;\1', 'g'), '\[(/?(?:INST|SYS|ANS|TURN)[\]:])', '&lb;\1', 'g'))
        + CASE role WHEN 'user' THEN 18 WHEN 'system' THEN 16 WHEN 'assistant' THEN 13
          ELSE 19 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), ']', '&rb;')) END AS n
    FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_CONFLICT).alias("text"))
    back = chat.read_back(chat.format_conversations(rows.unionByName(planted)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@register("op10_url_filter")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, keep=("page_id",))


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substr(hex({0}), 2 * i - 1, 2))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))"""


def crc32_sql(text: str) -> str:
    """DuckDB has no crc32: the bitwise definition over the text's UTF-8 bytes."""
    return f"xor({_CRC.format(text)}, 4294967295)"


def rebuilt(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Each conversation's first h turns are those of conversation c - c % 5; h = crc32(c) % 9."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    own = rows.filter(F.col("pos") >= h)
    base = rows.filter((F.col("conv") % 5 == 0) & (F.col("pos") < 8)).withColumnRenamed("conv", "base")
    lent = convs.withColumn("base", F.col("conv") - F.col("conv") % 5).join(base, "base").filter(F.col("pos") < h)
    return own.select("conv", "pos", "digest", "bytes").unionByName(lent.select("conv", "pos", "digest", "bytes"))


@register("op11_conversation_trie", f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) - 1 AS p, g, b
           FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
                        strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL)),
i AS (SELECT c, c - c % 5 AS base, {crc32_sql('c::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
u AS (SELECT c, p, g, b FROM t JOIN i USING (c) WHERE p >= h UNION ALL SELECT i.c, p, g, b FROM i JOIN t ON t.c = i.base WHERE p < h),
l AS (SELECT i.c, coalesce(gs, []::VARCHAR[]) AS gs, bs FROM i LEFT JOIN (SELECT c, list(g ORDER BY p) AS gs, list(b ORDER BY p) AS bs FROM u GROUP BY c) USING (c)),
n AS (SELECT c, d, len(gs) AS size, array_to_string(gs[1:d], '') AS k, CASE WHEN d = 0 THEN 0 ELSE bs[d] END AS b
      FROM (SELECT *, unnest(range(0, len(gs) + 1)) AS d FROM l)),
m AS (SELECT k, min(c) AS conv_id, min(d) AS depth, count(*) AS n_convs, min(b) AS b, count(*) FILTER (d = size) AS stopped,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = size), '')) AS ends_sha256 FROM n GROUP BY k),
s AS (SELECT n.k, count(*) FILTER (n.d = m.depth - 1) AS n_children, count(*) FILTER (stopped = n_convs) AS n_leaves,
             sum((n_convs - 1) * m.b) AS saved_tokens FROM m JOIN n ON n.c = m.conv_id AND n.d <= m.depth GROUP BY n.k)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, s.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (k) LEFT JOIN n ON n.c = m.conv_id AND n.d = m.depth - 1 LEFT JOIN m p ON p.k = n.k""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "conversations")
    rows = ws.save(trie.turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"), "turns")
    convs = rows.filter("pos = 0").select("conv")
    built = trie.build(spark, rebuilt(rows, convs), convs)
    got = built.nodes.join(built.end_digests(), "node", "left")
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


@register("op12_repetition_rules")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, limits = F.col("rules"), repeats.Limits()
    got = repeats.with_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", spans=False)
    failed = repeats.base_failed(rules, limits)
    return got.select("doc_id", *[rules[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                      failed.alias("base_failed"), (~failed & repeats.verdict(rules, limits)).alias("kept"),
                      *[rules[c].alias(c) for c in ("n_covered", "longest", "n_repeats")])


@register("op13_importance_resampling", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
sw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM d) GROUP BY w),
tw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY w),
c AS (SELECT w, {crc32_sql('w')} % 10000 AS k FROM (SELECT w FROM sw UNION SELECT w FROM tw)),
s AS (SELECT k, sum(n) AS s FROM sw JOIN c USING (w) GROUP BY k),
t AS (SELECT k, sum(n) AS t FROM tw JOIN c USING (w) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM sw) + 10000)::DOUBLE
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM tw) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM (SELECT DISTINCT k FROM c) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
f AS (SELECT doc_id, n, weight, weight + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE)
        / 4294967296::DOUBLE)))::BIGINT AS score
      FROM (SELECT d.doc_id, coalesce(len(ws), 0) AS n, coalesce((SELECT sum(gain) FROM (SELECT unnest(ws) AS w) JOIN c USING (w) JOIN g USING (k)), 0)::BIGINT AS weight
            FROM d)),
r AS (SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS r FROM f)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN r <= 10 * (SELECT count(*) FROM f WHERE n >= 20) // 100 THEN r END AS rank FROM r""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), id_col="doc_id", text_col="text",
                            target_text="text", seed="2024", percent=10, min_words=20, buckets=10_000, max_run=1)
    return got.withColumnRenamed("id", "doc_id")
