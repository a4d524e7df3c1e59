"""Queries of the training-data operators over the standard tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.llm import (
    chat,
    collocations,
    decontaminate,
    language_id,
    lm_score,
    ngram_join,
    path_join,
    piece_codec,
    substring_dedup,
    suffix_dedup,
    url_filter,
    vector_search,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


CONTROL_TURNS = """
SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')
AS t(conv_id, turn, role, text)"""

OP2_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, length(replace(replace(replace(role, '~', '~0'), '<', '~1'), '[', '~2'))
        + length(replace(replace(replace(text, '~', '~0'), '<', '~1'), '[', '~2')) + 20 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@query("op2_chat_format", OP2_SQL)
def op2_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.format_conversations(given.unionByName(spark.sql(CONTROL_TURNS)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# Host, path, verdict.
URL_RULES = """
SELECT * FROM VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block') AS t(host, path, verdict)"""

OP6_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS r, page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (r)"""


@query("op6_url_filter", OP6_SQL)
def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf, "pages"), spark.sql(URL_RULES))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix_dedup.drop_repeated_bytes(table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substring_dedup.drop_repeated_passages(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def piece_model() -> bytes:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@query("op4_piece_codec")
def op4_piece_codec(spark: SparkSession, sf: str) -> DataFrame:
    out = piece_codec.encode(table(spark, sf, "documents"), piece_model())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("source_bytes"),
    )


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""


@query("op8_vector_search", OP8_SQL)
def op8_vector_search(spark: SparkSession, sf: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op7_ngram_join")
def op7_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf, "documents"))


@query("op5_lm_score")
def op5_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return lm_score.score_texts(table(spark, sf, "documents"), held_out, piece_model())


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    rest = F.crc32(F.col("doc_id").cast("string")) % 3
    model = language_id.fit(docs.where(rest != 1))
    out = language_id.predict(docs, model)
    return out.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "parts")


@query("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE size > 1 AND f >= 10),
parts AS (SELECT lang, phrase, a, 1 AS k, s[1] AS head, array_to_string(s[2:], ' ') AS tail FROM c
  UNION ALL SELECT lang, phrase, a, 2, s[1] || ' ' || s[2], s[3] FROM c WHERE size = 3),
cuts AS (SELECT parts.lang, parts.phrase, a, k, l.f AS l, r.f AS r,
    CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM parts JOIN f l ON l.lang = parts.lang AND l.phrase = head JOIN f r ON r.lang = parts.lang AND r.phrase = tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, s[1] || ' ' || s[2] AS phrase, a FROM c WHERE size = 3
  UNION ALL SELECT lang, s[2] || ' ' || s[3], a FROM c WHERE size = 3),
held AS (SELECT lang, phrase, max(a) AS held FROM inside GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE held IS NULL OR 100 * held < 50 * a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""


@query("op12_collocations", OP12_SQL)
def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents")).withColumn("rank", F.col("rank").cast("long"))


@query("op13_path_join")
def op13_path_join(spark: SparkSession, sf: str) -> DataFrame:
    return path_join.near_duplicates(table(spark, sf, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf)
