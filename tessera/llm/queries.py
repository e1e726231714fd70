"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, fingerprint, idfiles, licences, merkle, mixing, pages, pii, secrets, simhash, toxicity, vptree


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    found = fingerprint.compared(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint.as_text("cells").alias("fingerprint"),
        fingerprint.as_text("cells2").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def joined(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.find(table(spark, sf, "documents"))

    def count(kind: str) -> Column:  # the filter function takes one argument: a second one would be the index
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op3_main_text(spark: SparkSession, sf: str) -> DataFrame:
    source = table(spark, sf, "pages")
    found = pages.main_text(source, pages.train(source))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_id_files(spark: SparkSession, sf: str) -> DataFrame:
    files = idfiles.write(table(spark, sf, "documents"), idfiles.folder_for(spark), public_tokenizers.path("word_bpe_49k.json"))
    return idfiles.read(files)


def op7_licences(spark: SparkSession, sf: str) -> DataFrame:
    return licences.find(table(spark, sf, "documents"), licences.template_table(spark))


def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    made = bpe.encode(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    found = mixing.accounts(mixing.mix(table(spark, sf, "documents")))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op10_vp_trees(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return vptree.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = align.align(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(table(spark, sf, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op13_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.checked(table(spark, sf, "documents"))


QUERIES = {
    "op1_fingerprints": (op1_fingerprints, None),
    "op2_secrets": (op2_secrets, None),
    "op3_main_text": (op3_main_text, None),
    "op4_simhash": (op4_simhash, None),
    "op5_toxicity": (op5_toxicity, None),
    "op6_id_files": (op6_id_files, None),
    "op7_licences": (op7_licences, None),  # licences.oracle() has no runs
    "op8_bpe": (op8_bpe, None),
    "op9_mixing": (op9_mixing, None),
    "op10_vp_trees": (op10_vp_trees, None),
    "op11_alignment": (op11_alignment, None),
    "op12_pii": (op12_pii, None),
    "op13_merkle": (op13_merkle, merkle.oracle()),
}
