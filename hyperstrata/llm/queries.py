"""The thin registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperstrata.llm.common import doc_crc, new_folder, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hyperstrata.llm.language_id import fit, predict

    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(doc_crc(F.col("doc_id")), F.lit(3)) == 1
    found = predict(docs, fit(docs, learn_from=~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hyperstrata.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hyperstrata.llm.line_dedup import drop_recurring_lines

    found = drop_recurring_lines(table(spark, sf_dir, "documents"))  # long lines that share no run too; the SQL has the rounds alone
    return found.select("doc_id", "n_lines", "n_dropped", "text")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hyperstrata.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), max_distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hyperstrata.llm.token_files import read_token_files, write_token_files

    folder = new_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hyperstrata.llm.warc import read_warc, write_warc

    folder = new_folder(spark, "warc")
    index = write_warc(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return read_warc(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hyperstrata.llm.decontamination import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles", "longest")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hyperstrata.llm.lm_scoring import score

    held_out = F.pmod(doc_crc(F.col("doc_id")), F.lit(7)) == 2
    found = score(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), learn_from=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hyperstrata.llm.licenses import scan

    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["phrase"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        "score",
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hyperstrata.llm.packing import pack, token_pieces

    pieces = token_pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), max_len=2048, end_id=0, payload="crc32")
    return pack(pieces, 2048)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from hyperstrata.llm import oracles

    return oracles.oracle_sql()
