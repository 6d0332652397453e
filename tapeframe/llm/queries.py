"""One registered query for each operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tapeframe.llm import ann, bpe, centroids, decontamination, licenses, mixing, secrets, sharding, simhash, suffixes, toxicity, warc, whitening
from tapeframe.llm.registry import query, table

SHARDS = 24


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_decontamination")
def op1_decontamination(spark, sf_dir):
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_simhash")
def op2_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_licenses", licenses.checking_sql())
def op3_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op4_ann")
def op4_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = ann.search(vectors, vectors.where("vec_id % 100 = 0"))
    return found.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("vec_id").cast("long").alias("vec_id"), "score")


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.CharacterModel.of(docs)
    scorer = toxicity.fit(docs, labels, model, allowed=~toxicity.held_out())
    scored = toxicity.score(docs.select("doc_id", "text"), scorer, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op6_suffixes")
def op6_suffixes(spark, sf_dir):
    cleaned = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                          F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_warc")
def op7_warc(spark, sf_dir):
    folder = warc.archive_folder(spark)
    index = warc.write(table(spark, sf_dir, "pages"), folder)
    records = warc.read(index, folder)
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes"))
    return records.select(F.col("key").cast("long").alias("page_id"), size.alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                          "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query("op8_sharding")
def op8_sharding(spark, sf_dir):
    placed = sharding.place(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op9_secrets")
def op9_secrets(spark, sf_dir):
    return secrets.Scanner(table(spark, sf_dir, "documents")).report()


@query("op10_bpe")
def op10_bpe(spark, sf_dir):
    encoded = bpe.encode(table(spark, sf_dir, "documents"), default_vocabulary())
    decoded = bpe.decode(encoded, default_vocabulary())
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


@query("op12_centroids", centroids.checking_sql())
def op12_centroids(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


@query("op13_mixing")
def op13_mixing(spark, sf_dir):
    mixed, sources = mixing.mix(table(spark, sf_dir, "documents"))
    known = sources.select(mixing.token(F.col("source")).alias("token"), F.col("size").alias("source_size"), "target")
    return mixed.withColumn("token", mixing.token(F.element_at("sources", 1))).join(known, "token").select("doc_id", "size", "source_size", "target", "taken")
