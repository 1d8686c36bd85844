"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import ann, bpe, language, lm, mixing, neardup, quality, substrings, toxicity, warc
from loomgraph.llm.common import documents, held_out, word_count


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file's content; the default is the public 50k byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer_json(), digests=True)


def op2_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), digests=True)


def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir)).select("doc_id", "class_id", "keep")


def page_captures(pages: DataFrame) -> DataFrame:
    """Two captures of each page: its response, and two days later a not-modified answer to the same URL.

    The answer's validators are those of the page; every 7th has no entity tag, every 11th a stale one.
    Every 13th response is a 404 and so not full.
    """
    tag = F.substring(F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), 1, 16)
    date = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("day-"), F.col("page_id").cast("string")))
    rows = pages.select("page_id", "url", tag.alias("tag"), date.alias("date"), F.length(F.coalesce(F.col("html"), F.lit(""))).cast("string").alias("n"))
    seen = F.when(F.col("page_id") % 11 == 0, F.lit("stale")).when(F.col("page_id") % 7 > 0, F.concat(F.lit("W/"), F.col("tag")))
    first = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("n"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("server"), F.lit("origin"))
    again = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=120"), F.lit("age"), F.lit("1"))
    both = F.explode(
        F.array(
            F.struct((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), (F.col("page_id") * 60).alias("ts"), F.col("tag").alias("etag"), F.col("date").alias("last_modified"), first.alias("headers"), F.when(F.col("page_id") % 13 == 0, 404).otherwise(200).alias("status_code")),
            F.struct((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), (F.col("page_id") * 60 + 172830).alias("ts"), seen.alias("etag"), F.col("date").alias("last_modified"), again.alias("headers"), F.lit(304).alias("status_code")),
        )
    )
    return rows.select("url", both.alias("c")).select("url", "c.*")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve(page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")), unkeyed=True)
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return done.select("record_id", "url_key", "status", "response_id", fields.alias("headers"))


OP4_SQL = r"""
WITH c AS (
  SELECT page_id, url, substr(md5(coalesce(html, '')), 1, 16) AS tag, CASE WHEN page_id % 3 > 0 THEN 'day-' || page_id END AS lm,
         length(coalesce(html, '')) AS n,
         regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?@]*@', '') AS u
  FROM pages),
k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), ':(80|443)$', ''), '^www[0-9]*[.]', '')
         || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '^[^/?]*', ''),
            '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '[?]&+', '?', 'g'), '&&+', '&', 'g'), '[?&/]+$', '') AS url_key
  FROM c),
again AS (
  SELECT url_key, page_id * 2 + 1 AS record_id, page_id * 60 + 172830 AS ts,
         CASE WHEN page_id % 11 = 0 THEN 'stale' WHEN page_id % 7 > 0 THEN tag END AS etag, lm FROM k),
full_ AS (SELECT url_key, page_id * 2 AS response_id, page_id * 60 AS ts, tag, lm AS olm, n FROM k WHERE page_id % 13 <> 0),
m AS (SELECT a.*, f.response_id, f.tag, f.olm, f.n FROM again a ASOF LEFT JOIN full_ f ON a.url_key = f.url_key AND a.ts >= f.ts),
s AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'orphan'
                 WHEN etag IS NOT NULL AND tag IS NOT NULL THEN CASE WHEN etag = tag THEN 'resolved' ELSE 'mismatch' END
                 WHEN lm IS NOT NULL AND olm IS NOT NULL THEN CASE WHEN lm = olm THEN 'resolved' ELSE 'mismatch' END
                 ELSE 'unchecked' END AS status
  FROM m)
SELECT record_id, url_key, status, response_id,
       CASE WHEN status = 'resolved' THEN 'age=1;cache-control=max-age=120;content-length=' || n || ';content-type=text/html;server=origin' END AS headers
FROM s
"""


def op5_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lm.score(docs, ~held_out(F.col("doc_id"), 5, 1))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = held_out(F.col("doc_id"), 4, 2)
    names, logp = language.learn(docs, ~held)
    return language.predict(docs, names, logp, keep=[F.col("doc_id"), held.alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score", "lang_set")


def op7_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = held_out(F.col("doc_id"), 4, 2)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)
    scored = toxicity.score(docs, model, keep=[F.col("doc_id"), held.alias("held_out")])
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_hits", "n_windows")


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.references(docs))


def op9_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("n_words"), mixing.key(F.col("doc_id"), F.col("text")).alias("key"))
    mixed = mixing.mix(docs, F.col("n_words"), key=F.col("key"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


OP10_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT AS h
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS most
  FROM sizes),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM targets),
done AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.times, round(p.target - p.times * p.source_size)::BIGINT AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (times * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM done
"""


def queries() -> dict:
    return {
        "op1_bpe_round_trip": op1_bpe_round_trip,
        "op2_recompression_dedup": op2_recompression_dedup,
        "op3_probminhash": op3_probminhash,
        "op4_warc_revisits": op4_warc_revisits,
        "op5_log_bilinear": op5_log_bilinear,
        "op6_language_mixture": op6_language_mixture,
        "op7_compression_toxicity": op7_compression_toxicity,
        "op8_quality_divergence": op8_quality_divergence,
        "op9_multiprobe_ann": op9_multiprobe_ann,
        "op10_mix_sources": op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_revisits": OP4_SQL, "op10_mix_sources": OP10_SQL}
