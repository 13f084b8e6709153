"""A corpus pipeline in five stages, each on all that the one before kept.

1. language ID: documents without a letter go, and those for whose language the network's odds are less than half of
   those of all but one in a thousand of the labelled documents of like length that it hasn't learnt from, each of which is
   looked at; without labels to learn from, all with letters stay;
2. exact dedup: of texts that are equal when A-Z are lower-cased the one with the largest doc_id stays;
3. n-gram Jaccard join: of each class of near duplicates the one with the least doc_id stays;
4. mixing: sources are mixed to their target weights, documents taken more than once are there more than once;
5. best-fit packing: the tokens of what is left are packed into sequences.

All but the last stage return the columns of ``documents``, whatever these are. From stage 2 on texts are different, so a
row is known by its doc_id and text. An empty table gives an empty result. Tables that a run writes on its way are in
the shared folder until that is cleared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwork.llm import exact_dedup, langid, mixing, ngram_join, packing, rows
from shelfwork.llm.queries import tokenizer_path
from shelfwork.llm.storage import drop, fold, new_path, stash, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that a language is found for; the network learns from labelled ones outside the held-out fold, and
    the least odds that count as found come from all those that it hasn't learnt from, inside and outside that fold."""
    held_out = fold(F.col("doc_id"), 5) == 0
    model = langid.train(docs.where(~held_out))
    if model is None:
        return docs.where(langid.has_letter(F.col("text")))
    known = F.col("lang").isNotNull() & langid.has_letter(F.col("text")) & (held_out | ~langid.learnt(model))
    marked = docs.select("doc_id", "text", known.alias("known"), langid.size_class(F.col("text")).alias("size"))
    found = stash(langid.identify(marked, model, ("known", "size")), "languages")
    kept = rows.keep(docs, found.withColumn("kept", langid.is_found(langid.least_odds(found.where("known")))))
    drop(found)
    return kept


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of equal texts (nulls are empty ones) the row with the largest doc_id; of several with that id the first by their columns."""
    return rows.keep(docs, exact_dedup.exact_dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the least doc_id of each class of near duplicates; texts without words are alone and stay."""
    return rows.keep(docs, ngram_join.ngram_join(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each row as often as its source's target asks; rows without words aren't taken."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row, copies too, with its place in a sequence."""
    return packing.best_fit_packing(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mix", source_mix),
    ("best_fit_packing", packed),
]

#: Packing isn't expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
