"""From raw documents to packed sequences: language ID, line dedup, near-duplicate join, PII, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before has
kept; its result is written as Parquet and read again. All but the last return the
columns of ``docs`` as they came; ``n_chars``, where there is one, follows the text.

All stages: an empty table gives none; null ids, sources and languages are values like any
other; other columns, whatever their names, pass through, but for the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import disclosure, jaccard, line_spread, mixture_lang, packing
from muster.llm.common import table, written
from muster.llm.queries import held_out


def _as(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with the number of characters of the text as it is now."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in like.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null and empty texts and those without a letter.

    The likeliest language mixture is found for every other text; one always is, so clean
    documents of any language stay. Equal rows share their fate. In a table without any
    label nothing is learned, and only texts without a letter go.
    """
    model = mixture_lang.learn(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # Numbered names, so that no column is taken for a result's.
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = mixture_lang.identify(rows, model, names["text"]).where(F.col("lang_pred") != mixture_lang.UNDETERMINED)
    return found.select([F.col(n).alias(c) for c, n in names.items()])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines, and documents of which no word is left.

    A null text has no lines and stays. A line's first place (a null id first, then the
    smallest, then the earliest line) keeps it; repeated rows are treated alike.
    """
    out = line_spread.remove_spread_lines(docs)
    return _as(out.where((F.col("_n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies.

    Null and blank texts are in no group and stay. The smallest id stays, null ids last, of
    equal ids one text; of rows equal in id and text one stays.
    """
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that give it away, in the texts.

    No row goes; null and empty texts stay as they are.
    """
    return _as(disclosure.sanitise(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens.

    A null or empty text is the end token alone; a null source is a queue of its own.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("packing", packed),
]

# Neither EM inference nor a tokenizer's merges can be put in SQL: tests/llm/test_pipeline.py
# holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
