"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of ``documents``. ``docs`` is a stored table.

All stages: nulls may stand in any column; rows repeat; other columns pass through, also with names that an operator
gives its own results; a very long text is read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id, mixing, ngram_join, packing, quality
from millrace.llm.common import Scratch, read

#: A document goes when its quality score is below this.
LEAST_QUALITY = 0.3
#: A document goes when it has no letters, or when its best language has less than this.
LEAST_LANGUAGE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects. Null and empty texts score the labelled rows' own share of label 1; without labels all score 0.5 and stay."""
    out = quality.classify(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return out.where(F.col(out.columns[-1]) >= LEAST_QUALITY).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is in no language that can be told, null texts and texts without a letter among them; nothing goes if no language can be learned."""
    model = language_id.train(docs)
    if model is None:
        return docs
    out = language_id.identify(docs, model)
    lang, score = out.columns[-2:]
    return out.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE)).select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the smallest doc_id. Texts without words are copies of nothing and stay; repeated rows become one; rows without a doc_id stay, one for each text."""
    return ngram_join.deduplicate(docs, Scratch(spark, "dedup"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents so that sources come near their targets; a document can come up to three times. Documents without words, and so null texts, are not taken; null sources are one source."""
    return mixing.mixed_rows(docs, Scratch(spark, "mixing"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 2048 tokens; a row for each piece. A document that comes more than once is packed as often."""
    import public_tokenizers

    return packing.pack(docs, Scratch(spark, "packing"), path=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models, components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
