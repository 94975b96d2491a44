"""The queries of this subpackage, each an operator on its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, jaccard, packing, pii, pitman_yor, quality, rules, spm, topk, toxicity, urls


def _held_out(mod: int, remainder: int) -> Column:
    return F.coalesce(base.fold("doc_id", mod) == remainder, F.lit(False))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels, train=base.fold("doc_id", 5) != 0)
    return quality.score_documents(docs, model, threshold=0.3).select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels")
    return rules.apply_rules(docs, rules.fit_ratio(docs, labels.where("quality = 1")))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(base.table(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(base.table(spark, sf_dir, "pages"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_personal_data(docs, key=pii.session_key(spark))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    held = _held_out(7, 2)
    model = pitman_yor.fit(docs, ~held)
    scored = pitman_yor.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(base.table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels, train=base.fold("doc_id", 5) != 0)
    return quality.score_documents(docs, model, threshold=0.5).select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    return spm.encode_documents(base.table(spark, sf_dir, "documents"), raw)


def byte_bpe_spec() -> str:
    """JSON of the public byte-level BPE that the packing contract names."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(base.table(spark, sf_dir, "documents"), byte_bpe_spec(), end_id=2, capacity=1024)


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_quality_rules, op3_exact_top_k, op4_url_filter, op5_pii_surrogates, op6_pitman_yor, op7_ngram_jaccard_join, op8_toxicity, op9_sentencepiece, op10_best_fit_packing)}
ORACLES: dict[str, str] = {
    "op3_exact_top_k": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op4_url_filter": """
        WITH split AS (
            SELECT page_id,
                coalesce(translate(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        ruled AS (
            SELECT *, CASE
                WHEN ('.' || host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN ('.' || host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN ('.' || host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                WHEN ('.' || host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                WHEN ('.' || host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
            FROM split)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN '.' || host LIKE '%spam%' OR '.' || host LIKE '%cheap-%' OR '.' || host LIKE '%casino%' OR '.' || host LIKE '%pills%'
                OR '.' || host LIKE '%adult%' OR path LIKE '%/ads/%' OR path LIKE '%/login%' OR path LIKE '%.exe' THEN 'block'
            ELSE 'allow' END AS verdict
        FROM ruled""",
}
