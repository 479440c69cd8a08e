"""A training-data pipeline of five operators. Counted as part of the subpackage ``llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs. All but the last return the columns of ``docs``, whatever they are called, with their values; ``n_chars``,
where there is one, follows the text. ``docs`` needs doc_id, text and source, and any of them may be null. Repeated and
null ids are rows of their own, ties are broken by a hash of the whole row, texts are used whole, and an empty table gives
an empty one; what a stage makes of null and empty texts is said there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alleleweave.llm import bpe, lines, mixing, shingles, toxicity
from alleleweave.llm.common import shared_folder
from alleleweave.llm.queries import VOCABULARY, read_table, remainder

#: No SQL: the model of toxicity, the fingerprints and the tokenizer are beyond it; tests compare with brute force.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, __rest): the other columns go into a struct, where their names can't clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("__none"), *rest).alias("__rest"))


def _unpacked(packed: DataFrame, like: DataFrame) -> DataFrame:
    return packed.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__rest").getField(c).alias(c) for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.3 or more go; it learns as op8 does. Null and empty texts have the
    score of no evidence, and stay. Rows of one id and text go or stay together."""
    labels = read_table(spark, sf_dir, "labels")
    model = toxicity.fit(*toxicity.labelled_sample(docs.select("doc_id", "text"), labels, remainder("doc_id", 4) == 2))
    scored = toxicity.toxicity(_packed(docs), model, keep=("text", "__rest"), score_col="__toxicity")
    return _unpacked(scored.where("__toxicity < 0.3"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more hold stay in the largest of these only. A null text becomes an empty one, and
    no row goes; rows of one id are one document."""
    out = _unpacked(lines.line_dedup(_packed(docs), keep=("__rest",)), docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, five-word shingles alike to 0.8, one row stays: that with the least doc_id, a null
    id last. Null, empty and blank texts are copies of each other. Rows that repeat an id are rows of their own."""
    return shingles.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, every copy at its own place in the order of training. Null and empty
    texts have no words and are taken with their source; a null source is one of its own; a source without any word
    is not taken."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether the ids decode to the text: a row for each row of ``docs``. Null and empty texts
    have no ids."""
    import public_tokenizers

    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    both = docs.select(F.struct("doc_id", digest.alias("digest")).alias("doc"), "text")
    t = bpe.encode(both, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, "doc", "text", decoded=True)
    same = F.col("doc.digest") == F.xxhash64("decoded")
    return t.select("doc.doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what they hand on is written below spark.checkpoint.dir."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
