"""The registered queries of the training-data operators: thin digests of their outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bpe import decode_documents, encode_documents
from .chat import format_records, masked_text, parse_chat, turn_records
from .common import let, table
from .html import extract_main_text
from .media import media_columns
from .mixing import plan_mix, taken_words
from .oracles import ORACLES
from .neardup import NearDup, near_duplicates
from .quality import COUNTS, score_quality
from .sharding import shard_by_bytes
from .suffixes import find_repeats
from .tokencount import token_counts


def vocabulary(name="byte_bpe_multi_50k.tiktoken"):
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark, sf_dir):
    texts = extract_main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_chat_formatting(spark, sf_dir):
    """All conversations and conversation -1, whose texts look like another template's control strings."""
    probe = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    done = format_records(turn_records(rows))
    turns = parse_chat(F.col("formatted"))
    said = let(masked_text(F.col("formatted"), F.col("loss")), lambda a: F.array_join(a, ""))
    return done.select(
        "conv_id", let(turns, lambda t: F.struct(
            F.size(t).cast("long").alias("n"),
            F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("sha"))).alias("t"),
        let(said, lambda s: F.struct(F.char_length(s).cast("long").alias("n"), F.sha2(s.cast("binary"), 256).alias("sha"))).alias("l"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    ).select("conv_id", F.col("t.n").alias("n_turns"), F.col("t.sha").alias("turns_sha256"),
             F.col("l.n").alias("loss_chars"), F.col("l.sha").alias("loss_sha256"), "formatted_chars")


def op3_mixing(spark, sf_dir):
    mixed = taken_words(plan_mix(table(spark, sf_dir, "documents")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_media_columns(spark, sf_dir):
    media = media_columns(table(spark, sf_dir, "documents"))
    return media.select(
        F.col("id").cast("long").alias("doc_id"), "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op5_byte_level_bpe(spark, sf_dir):
    vocab = vocabulary()
    encoded = encode_documents(table(spark, sf_dir, "documents"), vocab, keep=["doc_id"])
    digests = encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode_documents(digests, vocab).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), NearDup(width=3, percent=85))


def op7_suffix_array_dedup(spark, sf_dir):
    """`text` is what is left, to be read: parts of characters that a cut splits show as U+FFFD there, and in the texts only.

    Strings of 400 bytes decide all columns up to `text`.  The last two are without runs of 51 words that repeat as
    well, however short; that text is joined to the rows only where it differs.
    """
    found = find_repeats(table(spark, sf_dir, "documents"), words=51, bytes_apart=True)
    shown = lambda c: F.make_valid_utf8(F.col(c).cast("string"))
    digests = found.texts.select(
        "k1", "k2", "n_bytes", F.col("bytes_removed").alias("n_removed"), F.size("bytes_spans").cast("long").alias("n_spans"), F.sha2("bytes_kept", 256).alias("kept_sha256"),
        F.octet_length("bytes_kept").cast("long").alias("n_kept"), shown("bytes_kept").alias("text"),
        F.col("n_removed").alias("n_removed_with_passages"), F.when(F.col("n_removed") > F.col("bytes_removed"), shown("kept")).alias("shorter"))
    return found.docs.join(digests, ["k1", "k2"]).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "text",
        "n_removed_with_passages", F.coalesce("shorter", "text").alias("text_without_passages"))


def op8_sharding(spark, sf_dir):
    return shard_by_bytes(table(spark, sf_dir, "documents"), 24)


def op9_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op10_quality_rules(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", *COUNTS, "base_failed", "kept")


def queries():
    return {f.__name__: f for f in (op1_html_extraction, op2_chat_formatting, op3_mixing, op4_media_columns, op5_byte_level_bpe, op6_minhash_near_dedup, op7_suffix_array_dedup, op8_sharding, op9_token_counts, op10_quality_rules)}


def oracle_sql():
    """SQL where it can express a query's rows: the others need code point classes, checksums, hashes or iteration that it lacks."""
    return {name: sql() for name, sql in ORACLES.items()}
