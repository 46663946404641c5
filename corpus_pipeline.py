"""Corpus pipeline: language, near copies, benchmark leaks, source mix, token files.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the
documents that the next one works on (the last returns the report of the written files).

Edge cases, in every stage: a row is a row whatever its id, so null and repeated ids neither join with
each other nor lose a text; a null or empty text has no letter and goes at the first stage; of rows
that are equal in all columns one stays (they are copies); very long texts are worked on whole;
further columns pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import _scratch, copies, decontam, langid, mixing, tokens
from quillon.llm.queries import id_remainder

#: Documents whose language is less sure than this are rejected.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that have no letter or whose language is not sure.

    Where no row tells its language nothing is learnt, and only texts without a letter go."""
    model = langid.fit(docs, id_remainder(5) != 0)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = (_free(docs, name) for name in ("found_lang", "found_score"))
    named = langid.predict(docs, model, lang_name=lang, score_name=score)
    return named.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of exact and edited copies, that of the smallest id.

    Links are five-word Jaccard similarities of 0.8 or more, not op6's four differing bits."""
    return copies.without_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold question and answer of a benchmark item."""
    return decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents once for each copy that the budgets take, cut where a budget ends."""
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in seekable files; returns what reading them back gives."""
    folder = _scratch.new_path(spark, "pipeline-tokens")
    manifest = tokens.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2, added=True)
    return tokens.read_tokens(spark, manifest)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_token_files),
]

#: The stages are no SQL (hashes, fitted models); tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        # A stage's working tables, and the stage before it, go once it is written.
        before = docs
        docs = _scratch.staged_in(spark, f"stage-{name}", lambda f=function, d=before: f(spark, d, sf_dir))
        if name != STAGES[0][0]:
            _scratch.drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
