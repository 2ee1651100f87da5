"""Corpus pipeline: from raw documents to token files of a clean mixture.

Five stages, each one of the corpus operators, each over all that the one before kept. Between stages the
documents are written as Parquet and read again.
"""

from pyspark.sql import functions as F

from fleetscope.llm import common, decontaminate, jaccard_join, mixing, quality, token_files


def keep_quality(spark, docs, sf_dir):
    """Drops documents that the classifier takes for label 0. It learns from the labelled documents of the folds not held out."""
    labels = common.table(spark, sf_dir, "labels", "doc_id", "quality").where(~quality.held_out())
    # written, so that measuring and adding up are not two Python workers of one task
    measured = common.written(quality.measure(docs), "statistics")
    return quality.keep_good(docs, quality.fit(measured, labels))


def _with_rows(docs):
    """The documents with a number for each row, written, so that it stays the same row's."""
    return common.written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


def keep_one_of_each_group(spark, docs, sf_dir):
    """Of documents connected by near-equal shingle sets only the one with the smallest id stays. Rows without an id go after all ids, then by row."""
    rows = _with_rows(docs)
    groups = jaccard_join.join(rows, width=5, percent=80, doc="__row").where("n_shingles > 0").select("__row", "component_id")
    named = common.written(groups.join(rows.select("__row", "doc_id"), "__row"), "groups")
    first = named.groupBy("component_id").agg(F.min("doc_id").alias("first_id"), F.min("__row").alias("first_row"), F.count("*").alias("n")).where("n > 1")
    extra = named.join(first, "component_id").where("first_id < doc_id OR (doc_id IS NULL AND (first_id IS NOT NULL OR first_row < __row))").select("__row")
    return rows.join(extra, "__row", "left_anti").select(docs.columns)


def keep_uncontaminated(spark, docs, sf_dir):
    """Drops documents that hold too much of the benchmark."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark", "item_id", "text"))


def take_mixture(spark, docs, sf_dir):
    """Documents of the mixture, whole, once for each epoch that takes them."""
    rows = _with_rows(docs)
    taken = mixing.mix(rows, row="__row").select("__row", "epoch")
    return rows.join(taken, "__row").select(docs.columns)


def write_tokens(spark, docs, sf_dir):
    """Token files of the mixture, and what they hold of each document."""
    # the workers go on to other stages, whose memory the words would take
    return token_files.round_trip(docs, keep=False)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", keep_uncontaminated),
    ("mixture", take_mixture),
    ("tokens", write_tokens),
]

#: the classifier and the tokenizer have no SQL; tests hold the stages near_duplicates and mixture against plain versions
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``. Each stage's rows are written and read again; an empty table passes through all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
