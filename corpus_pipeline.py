"""The corpus pipeline: good documents, without exact and near copies, personal data masked, packed into sequences."""

from __future__ import annotations

import public_tokenizers

from bourse.llm import common, exact, near, personal, quality, tokens
from bourse.llm.queries import BYTE_BPE


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def exact_stage(spark, docs, sf_dir):
    """Of equal texts, the row with the largest doc_id stays."""
    return exact.drop_copies(docs)


def near_stage(spark, docs, sf_dir):
    """Of each group of near copies, the row with the smallest doc_id stays."""
    return near.drop_near_copies(docs)


def personal_stage(spark, docs, sf_dir):
    """Personal data in the texts is masked."""
    return personal.redact(docs)


def packing_stage(spark, docs, sf_dir):
    """Every document is cut into sequences of binary lengths."""
    return tokens.pack(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("personal", personal_stage), ("packing", packing_stage)]

#: No SQL expresses the classifier, the near copies' search and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, one after another, over ``documents``; each one's rows are written as Parquet and read again, and
    removed, as are a stage's own tables, when the next stage's are written."""
    since = common.mark()
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.sweep(since, common.materialise(stage(spark, docs, sf_dir), f"stage-{name}"))
    return common.sweep(since, STAGES[-1][1](spark, docs, sf_dir))
