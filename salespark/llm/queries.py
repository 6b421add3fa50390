"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salespark.llm import (chat, common, hardneg, langid, manifest, neighbours, packing, piecebpe, private, quality, secrets,
                           simhash, tokenfiles, toxicity)


def word_tokenizer() -> str:
    """Path of the public word-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to token files and read back by key."""
    docs = common.table(spark, sf_dir, "documents")
    folder = tokenfiles.write(docs, word_tokenizer())
    return tokenfiles.read_digest(docs.select("doc_id"), folder)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens with their lexical neighbours."""
    return packing.pack(common.table(spark, sf_dir, "documents"), word_tokenizer(), payload=False)


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return private.digest(private.find(common.table(spark, sf_dir, "documents")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digest(secrets.find(common.table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and the learned quality verdict of every document."""
    return quality.quality(common.table(spark, sf_dir, "documents"),
                           common.table(spark, sf_dir, "labels"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for each vec_id divisible by 50."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors.filter("vec_id % 50 = 0"), vectors)


def op8_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by merge rounds and decoded again."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return piecebpe.round_trip_digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(common.table(spark, sf_dir, "documents"),
                             common.table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.languages(common.table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of the documents, each folded to the root after tampering."""
    return manifest.tamper_check(common.table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each vec_id divisible by 50, for its five positives."""
    return hardneg.mine(common.table(spark, sf_dir, "embeddings"), hardneg.op12_anchor(), hardneg.op12_label())


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, written, read back and digested."""
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(chat.CONTROL_ROWS, rows.schema))
    return chat.digest(common.written(chat.formatted(chat.text_parts(rows)), "chat"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_packing": op2_packing,
    "op3_private_data": op3_private_data,
    "op4_secrets": op4_secrets,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_neighbours": op7_neighbours,
    "op8_piece_bpe": op8_piece_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
    "op11_manifest": op11_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_chat": op13_chat,
}

#: DuckDB SQL per key, where SQL can express the query.
ORACLE: dict[str, str] = {
    "op11_manifest": manifest.oracle(),
    "op12_hard_negatives": hardneg.oracle(),
    "op13_chat": chat.oracle(),
}
