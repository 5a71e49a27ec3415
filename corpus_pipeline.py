"""A training corpus from `documents`: quality rules, near-dedup, substring dedup, mixing, tokens.

STAGES lists (name, function).  Each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cdfloom.llm.bpe import encode_documents
from cdfloom.llm.common import materialize, release, scratch_owner
from cdfloom.llm.mixing import plan_mix, taken_words
from cdfloom.llm.neardup import keep_one
from cdfloom.llm.quality import QualityRules, filter_quality
from cdfloom.llm.queries import vocabulary
from cdfloom.llm.suffixes import drop_repeats

#: Short documents are no junk by their length: of labelled ones under 50 words most are good, so only texts without a
#: word fail by it here, and the statistics judge the rest.
QUALITY = QualityRules(min_words=1)
#: Passages of over 50 words that repeat go, short as their words may be.
PASSAGE_WORDS = 51


def _stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage gives back the scratch of the one before, whose result is written by then."""
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "pipeline")
        with scratch_owner("pipeline"):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return filter_quality(docs, QUALITY)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return keep_one(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages: runs of PASSAGE_WORDS words, or of 400 bytes, that also start elsewhere.

    n_chars follows the text.  Documents left empty stay.
    """
    cut = drop_repeats(docs, words=PASSAGE_WORDS)
    return cut.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: its words over the document's words, at most twice.

    A fraction left over is rounded up or down by a hash of the id, with the
    fraction as the chance, so a source's words stay near its target; a null id
    is replaced by a hash of the text there.  Copies of a document are rows of the
    same doc_id; one without words isn't taken.  Every row is a document of its
    own, with a null doc_id or one that other rows have as well.
    """
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-keyed")
    share = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0)
    named = F.when(F.col("id").isNotNull(), F.xxhash64("id", F.lit(23))).otherwise(F.xxhash64("h", F.lit(23)))
    chance = F.pmod(named, F.lit(1 << 20)) / (1 << 20)
    taken = taken_words(plan_mix(rows, keep=("__row",)), keep=("h", "__row")).select(F.col("__row").alias("__taken"), F.floor(share + chance).cast("int").alias("__times")).where("__times > 0")
    joined = rows.join(taken, rows["__row"] == taken["__taken"])
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them again."""
    encoded = encode_documents(docs, vocabulary(), keep=["doc_id", "lang", "source"], verify=True)
    return encoded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix),
    ("byte_bpe", tokens),
]

#: The near-dedup, suffix and token stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
