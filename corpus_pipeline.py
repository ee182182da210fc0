"""The corpus pipeline: five stages from documents to token ids and the text decoded from them.

Each stage takes the documents that its predecessor kept, written as Parquet and
read again, and all but the last return the columns of `documents`, whatever their names.

Defined results.  Null and empty texts have no language and go in the language stage.
Rows with a null doc_id are documents like others; of rows that repeat both id and text
one stays in the near-duplicate stage, rows that repeat an id with other texts are documents of their own.
Of near duplicates that with the least doc_id stays, one without an id last.  Every text is read whole,
however long.  Empty tables give empty stages; without labels of both classes no document is toxic.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, decontam, langid, simhash, toxicity
from marlstone.llm.common import fresh, materialize, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOXIC = 0.5
#: A document without a language, or in which no language has half of the letters, goes.
LEAST_LANGUAGE_SHARE = 0.5
#: Near duplicates have this Jaccard similarity of their five-word shingles. Candidates are found by 256 bits, of which
#: 39 are expected to differ at 0.8, with a deviation of 6.
NEAR = {"shingle_words": 5, "lanes": 4, "radius": 60, "similarity": 0.8}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, trained on the labelled rows, scores below 0.5."""
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs.columns, "toxicity")
    return toxicity.score(docs, net, keep=docs.columns, score_col=score).where(F.col(score) < TOXIC).drop(score)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that has at least half of their letters."""
    lang, share, spans = fresh(docs.columns, "lang_pred", "share", "spans")
    found = langid.identify(docs, langid.train(docs), keep=docs.columns, lang_col=lang, score_col=share, spans_col=spans)
    known = (F.col(lang) != langid.UNKNOWN) & (F.col(share) >= LEAST_LANGUAGE_SHARE)
    return found.where(known).drop(lang, share, spans)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one_of_each(docs, **NEAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the token ids of each remaining document, and the text decoded from them.

    The ids are written before they are decoded, so that no task runs two Python workers at once.
    """
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.decode(materialize(bpe.encode(docs, tokenizer), "bpe-ids"), tokenizer)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: Trained networks and SimHash have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's rows having been written to the shared folder."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(done.schema).parquet(f"{base}/{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
