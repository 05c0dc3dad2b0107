"""The registered queries of the corpus operators, each over its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerflow.llm.chat import prefix_tree, read_back
from titerflow.llm.common import table
from titerflow.llm.contamination import contaminated
from titerflow.llm.language import language_id
from titerflow.llm.licences import licence_scan
from titerflow.llm.mixing import mixture
from titerflow.llm.neardup import near_duplicates
from titerflow.llm.neighbours import nearest
from titerflow.llm.quality import quality_scores
from titerflow.llm.ranked import ranked_search
from titerflow.llm.repeats import remove_repeats
from titerflow.llm.sql_forms import FORMS
from titerflow.llm.tokens import tokenized
from titerflow.llm.variants import spelling_variants
from titerflow.llm.warc import archived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = dict(FORMS)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares, _ = mixture(table(spark, sf_dir, "documents"), weights=(5, 2, 1), limit=3)
    seats = F.flatten(F.col("uses.seats"))
    shards = F.array_distinct(F.transform(F.coalesce(seats, F.array()), lambda seat: seat["shard"]))
    return shares.select(
        "doc_id", "size", "source_size", "target", "taken", F.size(shards).cast("bigint").alias("n_shards"), F.array_min(shards).alias("first_shard")
    )


def word_tokenizer() -> str:
    """The public vocabulary file that the token queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tokenized(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=1)
    return done.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)
    return scores.select("doc_id", "held_out", "score", "predicted")


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=5, percent=80)
    return pairs.select("doc_id", "item_id", "item_shingles", "shared", "containment")


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents")).drop("places")


@query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    own = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], kinds)
    segments, _, conversations = prefix_tree(rows.unionByName(own))
    back = read_back(segments, conversations)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return best.select("item_id", "rank", "doc_id", "score")


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archived(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
