"""The corpus pipeline: STAGES in order, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir), is written as Parquet by whoever runs it, and gets what its predecessor returned. All but the last
return the columns of documents; the last returns the token ids of each text that is left.
"""

from stockyard.llm import common, decontaminate, omh, pieces, pii, quality


def quality_rules(spark, docs, sf_dir):
    """Without the documents that the rules reject, and without boilerplate lines."""
    return quality.clean(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each class of near-duplicates."""
    return omh.deduplicated(docs)


def decontamination(spark, docs, sf_dir):
    """Without documents that hold a benchmark item."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """With personal data masked."""
    return pii.redact(docs)


def tokens(spark, docs, sf_dir):
    """doc_id, ids, n_ids, decoded_sha256, round_trip."""
    return pieces.encoded(docs)


STAGES = [("quality", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("personal-data", personal_data), ("sentencepiece", tokens)]
#: SQL can't say alignment, the tagger or the encoder; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """STAGES over documents, each stage's table written in the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
