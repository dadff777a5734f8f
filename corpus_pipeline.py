"""From raw documents to packed training sequences, in stages that each work on what the stage
before has kept.

A stage takes (spark, docs, folder) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs.  All but the last return the columns of ``documents`` as they are.

Every stage decides by row, so rows that share a doc_id, or have none, have a verdict each.  A null
text counts as empty; texts are judged whole, whatever their length; rows that are alike in doc_id
and text share what is said of them; an empty table gives an empty one; columns beyond doc_id and
text are carried along unread.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import decontam, packing, rules, simhash, toxicity
from tripweave.llm.common import remainder
from tripweave.llm.decontam import text_hash
from tripweave.plans.lineage import cut_lineage, owns_copies, shared_folder
from tripweave.queries.folders import name_folder

#: SQL cannot express the noisy-or training or the fingerprints; the tests use brute force.
ORACLE_SQL = None


def _stage(work):
    """Name a folder for copies where the session has none, and remove those not read further."""

    @functools.wraps(work)
    def staged(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        name_folder(spark)
        return owns_copies(work)(spark, docs, folder)

    return staged


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that the base rules or the repetition rules reject, by the query's limits;
    so null, empty and blank texts go."""
    return rules.passing(docs, **rules.LIMITS)


@_stage
def toxic_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents whose noisy-or score is one half or more.  The labels of a fifth of the
    doc_ids are held out from training, as in the operator's own query.  A null or empty text has
    no sentence and stays; repeated rows score alike."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(remainder("doc_id", 5) != 0)
    return toxicity.passing(docs, toxicity.train(docs, labels), below=0.5)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one row of each component of linked fingerprints: that of the smallest doc_id, of
    several rows with that doc_id the one with the smallest fingerprint, then text hash.  A row
    without a doc_id stays only where no row of its component has one.

    Linked are fingerprints of 3-word shingles at most three bits apart, as in op6.  Null, empty
    and blank texts are one component.
    """
    found = cut_lineage(simhash.near_duplicates(docs, words=3, distance=3))
    place = F.struct(F.col("doc_id").isNull().alias("keyless"), "doc_id", "fp")
    first = cut_lineage(found.groupBy("component").agg(F.min(place).alias("first")).select("component", "first.*"))
    counted = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    shared = cut_lineage(counted.filter((F.col("n") > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias("_shared")))
    # Of ids with one row it names those to drop: they are far fewer than those that stay.
    own = first.select(F.col("doc_id").alias("_own")).join(shared, F.col("_own") == F.col("_shared"), "left_anti")
    ids = found.select(F.col("doc_id").alias("_bad")).filter("_bad IS NOT NULL").distinct()
    bad = cut_lineage(ids.join(own, F.col("_bad") == F.col("_own"), "left_anti"))
    kept = docs.filter(docs["doc_id"].isNotNull()).join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
    if shared.isEmpty():
        return kept

    # Rows whose doc_id does not tell which they are: found again by their text.
    open_rows = docs.join(shared, docs["doc_id"].eqNullSafe(shared["_shared"]), "left_semi").select(
        F.struct(*docs.columns).alias("row"), text_hash().alias("hash")
    )
    texts = open_rows.select("hash", F.col("row.text").alias("text")).distinct()
    prints = simhash.fingerprints(texts, key="hash").select(F.col("doc_id").alias("hash"), "fp")
    candidates = open_rows.join(prints, "hash").join(
        first.select("component", F.col("doc_id").alias("own"), F.col("fp").alias("least")),
        F.col("row.doc_id").eqNullSafe(F.col("own")) & (F.col("fp") == F.col("least")),
    )
    once = candidates.groupBy("component").agg(F.min_by("row", F.struct("hash", "row.text")).alias("row"))
    return kept.unionByName(once.select("row.*"))


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents of which a twentieth or more of the words lie in benchmark passages.  Null
    and empty texts have no words and stay; with no benchmark items all stay."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = decontam.contamination(docs, items, window=13)
    hit = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    # Written first, so Spark knows its size and broadcasts it if, and only if, its threshold allows.
    bad = cut_lineage(
        found.filter(hit).select(F.col("doc_id").alias("_rejected"), F.col("text_hash").alias("_text")).distinct()
    )
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_rejected"]) & (text_hash() == bad["_text"]), "left_anti")


@_stage
def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents, each with its sequence and place there.  A null or empty text is
    one piece of the end token; repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage is written to the shared folder."""
    name_folder(spark)
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return result
        result.write.parquet(f"{root}/{number}")
        docs = spark.read.schema(result.schema).parquet(f"{root}/{number}")
