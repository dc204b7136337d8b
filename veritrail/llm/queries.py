"""The registered queries of the corpus operators, with the parameters they run with in production."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, interaction_audit, jaccard, language, licenses, lm, packing, quality, token_files, urls, vector_codes, wordpieces
from .common import crc_mod, shared_dir, table

#: The URL rules.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Documents whose score is at least this are of quality 1.
QUALITY_THRESHOLD = 0.3


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = {"fingerprint": ("digest", "suffix"), "edited_fingerprint": ("edited_digest", "edited_suffix")}
    rows = fingerprints.settle(fingerprints.with_next(docs), fingerprints.collisions(docs), columns)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    scored = quality.classify(table(spark, sf_dir, "documents"), known)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def byte_encoder():
    """Made on each executor; the vocabulary's path is looked up there."""
    import public_tokenizers as public

    return token_files.byte_pair_encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


#: Operators 5 and 12 share it.
byte_pair_encoder = byte_encoder


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.crc32_of(packing.pack(table(spark, sf_dir, "documents"), byte_encoder))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", crc_mod("doc_id", 10) != 0)
    scored = lm.score(docs, "train")
    return scored.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "score_order2")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(crc_mod("doc_id", 4) != 2))
    found = language.identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = wordpieces.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return wordpieces.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), 85, 100, 4)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/veritrail/op12-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), byte_encoder, path)
    return token_files.with_crc32(token_files.read(spark, path))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_fingerprints, op3_url_filter, op4_quality, op5_packing, op6_licenses, op7_language_model, op8_language, op9_token_counts, op10_ngram_jaccard, op11_vector_codes, op12_token_files, op13_filter_audit)}

_ROUND = """assigned{0} AS MATERIALIZED (SELECT row, p, v, min(list_inner_product(v, v) - 2 * list_inner_product(v, e) + list_inner_product(e, e)) AS error, arg_min(i, (list_inner_product(v, v) - 2 * list_inner_product(v, e) + list_inner_product(e, e)) * 256 + i) AS i FROM parts JOIN books{0} USING (p) GROUP BY ALL)"""
_NEXT = """books{1} AS MATERIALIZED (SELECT b.p, b.i, coalesce(n.e, b.e) AS e FROM books{0} b LEFT JOIN (SELECT p, i, list(x ORDER BY place) AS e FROM (SELECT p, i, place, floor(sum(x) / count(*)) AS x FROM (SELECT p, i, unnest(v) AS x, unnest(range(len(v))) AS place FROM assigned{0}) GROUP BY ALL) GROUP BY ALL) n USING (p, i))"""
#: Sums of whole numbers stay below 2^53 here, so doubles hold them exactly.
OP11 = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM kept, range(4) r(p)),
books0 AS MATERIALIZED (SELECT p, row AS i, v AS e FROM parts WHERE row < 256),
{_ROUND.format(0)}, {", ".join(f"{_NEXT.format(k, k + 1)}, {_ROUND.format(k + 1)}" for k in range(4))},
coded AS (SELECT row, string_agg(printf('%02x', i), '' ORDER BY p) AS code, sum(error) AS error FROM assigned4 GROUP BY row),
digest AS (SELECT sha256(string_agg(list_aggregate(list_transform(e, lambda x: CAST(x::BIGINT AS VARCHAR)), 'string_agg', ','), ',' ORDER BY p, i)) AS h FROM books4)
SELECT vec_id, code, error::BIGINT AS error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (row), digest"""
OP13 = r"""WITH known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
masks AS MATERIALIZED (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM texts LEFT JOIN known USING (doc_id)),
failing AS MATERIALIZED (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM orders, range(1, 6) r(step)),
cells AS (SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS hit, translate(fails, before, '') <> fails AS gone FROM failing, steps),
sums AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
  coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM cells GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM sums"""
ORACLES: dict[str, str] = {"op11_vector_codes": OP11, "op13_filter_audit": OP13}
