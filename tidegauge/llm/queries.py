"""The registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, langid, media, mixing, packing, pii, quality, simhash, tokens
from .common import crc_mod3, table


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s0),
s2 AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / w AS fill FROM s1),
s3 AS (
  SELECT *, row_number() OVER o AS place,
         (1.5 * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
           / (sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s2 WINDOW o AS (ORDER BY fill, source NULLS LAST)),
lv AS (SELECT arg_min(level, place) AS lam FROM s3 WHERE fill >= level),
s4 AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(w * lv.lam, cap::DOUBLE)) AS target FROM s3, lv),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM s4),
hs AS (SELECT source, h, sum(size)::BIGINT AS s FROM d GROUP BY source, h),
c AS (SELECT source, h, s, sum(s) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto FROM hs),
e AS (
  SELECT c.source, max(c.h + CASE WHEN c.upto - b.budget <= b.budget - (c.upto - c.s) THEN 1 ELSE 0 END) AS threshold
  FROM c JOIN (SELECT source, target - whole * source_size AS budget FROM s5) b ON c.source IS NOT DISTINCT FROM b.source
  WHERE c.upto - c.s < b.budget AND b.budget <= c.upto GROUP BY c.source)
SELECT d.doc_id, d.size, s5.source_size, s5.target,
       d.size * (s5.whole + CASE WHEN d.h < coalesce(e.threshold, 0) THEN 1 ELSE 0 END) AS taken
FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.corpus_path(spark)
    tokens.write(table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"), "byte", 2)
    return tokens.checksums(tokens.read(spark, path))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod3(F.col("doc_id")) == 1)
    profiles = langid.learn(docs.filter("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = quality.measures(quality.sampled(docs))
    out = quality.cascade(quality.measures(docs).withColumn("base_failed", quality.base_failed()), quality.default_rules(), sample)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
i AS (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM i),
r AS (SELECT rid, count(DISTINCT i + o) AS n FROM g, (SELECT unnest([0, 1, 2]) AS o) WHERE c >= 2 GROUP BY rid),
m AS (
  SELECT doc_id, ws, text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines
            OR (n_words > 0 AND (word_chars / n_words < 2 OR word_chars / n_words > 14))
            OR 100 * len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}'))) > 30 * n_words
            OR regexp_matches(text, '[^\x20\x09-\x0D]{1000}')) AS kept
FROM b
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [k.name for k in pii.BASE_KINDS]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in base]
    return out.select("doc_id", *counts, F.sha2(said(of_base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def _luhn_sql(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    v = f"substr({d}, j::INT, 1)::INT"
    return f"(list_sum(list_transform(range(1, length({d}) + 1), lambda j: CASE WHEN (length({d}) - j) % 2 = 1 THEN CASE WHEN {v} > 4 THEN 2 * {v} - 9 ELSE 2 * {v} END ELSE {v} END)) % 10 = 0)"


def _near_sql(words: str) -> str:
    return f"regexp_matches(lower(substr(text, greatest(s.e - length(s.x) - 39, 1)::INT, length(s.x) + 80)), '{words}')"


def _op5_sql() -> str:
    """For each kind the matches and the pieces between them, then running lengths, then what validates."""
    runs = r"[0-9]([\x20-]?[0-9])+"
    size = "length(regexp_replace(s.x, '[^0-9]', '', 'g'))"
    iban = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(regexp_replace(s.x, ' ', '', 'g'), 5) || substr(regexp_replace(s.x, ' ', '', 'g'), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE 100 + ascii(c) - 55 END)), lambda a, c: CASE WHEN c < 100 THEN (a * 10 + c) % 97 ELSE (a * 100 + c - 100) % 97 END) = 1"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(s.x, '.'), lambda p: p::HUGEINT)) <= 255"),
        ("card", runs, f"{size} BETWEEN 16 AND 19 AND {_luhn_sql('s.x')}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"{size} BETWEEN 8 AND 15"),
        ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", iban),
        ("ssn", r"[0-9-]+", "regexp_full_match(s.x, '[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}') AND s.x[1:3] NOT IN ('000', '666') AND s.x[5:6] <> '00' AND s.x[8:] <> '0000' AND " + _near_sql("ssn|social security")),
        ("shortcard", runs, f"{size} BETWEEN 13 AND 15 AND {_luhn_sql('s.x')} AND {_near_sql('card|visa|amex|credit|karte|carte|tarjeta')}"),
    ]
    cols = []
    for k, p, valid in kinds:
        at = f"list_transform(regexp_extract_all(text, '{p}'), lambda x, i: {{'x': x, 'e': list_sum(list_transform(regexp_extract_all(text, '{p}')[1:i], lambda y: length(y))) + list_sum(list_transform(string_split_regex(text, '{p}')[1:i], lambda y: length(y)))}})"
        cols.append(f"list_transform(list_filter({at}, lambda s: {valid}), lambda s: '{k}:' || (s.e - length(s.x))::BIGINT || ':' || s.e::BIGINT) AS {k}")
    join = lambda ks: "array_to_string(" + " || ".join(k for k, *_ in ks) + ", ',')"
    return "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), k AS (SELECT doc_id, " + ", ".join(cols) + " FROM t) SELECT doc_id, " + ", ".join(f"len({k})::BIGINT AS n_{k}" for k, *_ in kinds[:4]) + f", sha256({join(kinds[:4])}) AS base_sha256, {join(kinds)} AS spans FROM k"


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod3(F.col("doc_id")) == 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").filter(crc_mod3(F.col("doc_id")) != 1)
    scored = classifier.score(docs, classifier.learn(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    path = tokenizer("byte_bpe_50k.json")
    return chat.digests(chat.format_chats(rows, path), path)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), "word", 2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.features(media.text_media(table(spark, sf_dir, "documents")))
    payload = F.col("payload")
    return found.select(
        "doc_id",
        "n_bytes",
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "frames", F.size("fingerprint"), F.lower(F.hex(F.xxhash64("fingerprint")))).alias("feature"),
    )


QUERIES = {f.__name__: f for f in (op1_token_files, op2_language_id, op3_simhash_dedup, op4_quality_rules, op5_pii, op6_quality_classifier, op7_chat_format, op8_packing, op9_media_columns, op10_mix_sources)}

ORACLE_SQL = {"op4_quality_rules": OP4_SQL, "op5_pii": _op5_sql(), "op10_mix_sources": OP10_SQL}
