"""A corpus pipeline of five stages; each works on all that its predecessor kept.

language: documents without a language (no letter, or no text) go.
near_duplicates: of each group of documents that the n-gram Jaccard join connects, the one of the smallest id stays.
decontamination: documents that hold an item of the benchmark go.
secrets: secrets in texts are replaced by a mark.
pieces: what is left is encoded; returns ids, counts and digests instead of the columns of documents.

Ids may be null or repeated: rows that agree in id and text are one document, rows that agree in
id alone are different ones, and a document without an id stays only where no other of its group
has one. An empty table passes through every stage; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard, language, pieces, secrets
from quarry.llm.common import staged, table

#: Words of a shingle and similarity in hundredths of near duplicates; jaccard's own defaults are those of op3's contract.
NEAR_WORDS, NEAR_HUNDREDTHS = 5, 80
#: Ids that a broadcast join takes at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


#: Names of columns that stages add for themselves, and the smallest stand-in for an id.
KEY, LANGUAGE, SCORE = "__key", "__language", "__score"
STAND_IN = 1 << 62


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without those keys; keys is written first, so its size is known before the join is chosen."""
    keys = staged(keys.select(KEY).distinct(), "dropped")
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, KEY, "left_anti")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents that aren't held out, predict all, drop those that get no language.

    Null and letterless texts go; where nothing is labelled, only they do.
    """
    model = language.fit(docs.where(~language.held_out()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.predict(docs, model, lang=LANGUAGE, score=SCORE).where(F.col(LANGUAGE) != language.UNKNOWN).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similarity links, the smallest id stays; null texts link with nothing and stay; of rows that are repeated one stays."""
    repeated = staged(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    marked = docs.join(repeated.withColumn(KEY, F.lit(True)), "doc_id", "left") if not repeated.isEmpty() else docs.withColumn(KEY, F.lit(None).cast("boolean"))
    stand_in = F.lit(STAND_IN) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(STAND_IN >> 1))
    keyed = marked.withColumn(KEY, F.when(F.col("doc_id").isNull() | F.col(KEY), stand_in).otherwise(F.col("doc_id")))
    groups = jaccard.jaccard_groups(keyed, NEAR_WORDS, NEAR_HUNDREDTHS, id_col=KEY)
    kept = _without(keyed, groups.where(F.col("component_id") != F.col(KEY)))
    once = kept.where(F.col(KEY) < STAND_IN).unionByName(kept.where(F.col(KEY) >= STAND_IN).dropDuplicates([KEY]))
    return once.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, with or without an id; null texts hold none."""
    keyed = docs.withColumn(KEY, F.xxhash64("doc_id", "text"))
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=KEY)
    return _without(keyed, found).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document goes; secrets are replaced in place, null texts stay null."""
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a row: id, number and digests of the pieces; null texts count as empty."""
    return pieces.digests(docs)


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("pieces", encode_pieces),
]

#: Stages 1 and 5 have no SQL form; tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
