"""The corpus pipeline over documents: each stage works on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each
stage's rows as Parquet into the shared folder and reads them again for the next.

Cases: a null or empty text or one without letters goes with the language stage; a row with a null id belongs to no
group of copies and stays; rows with the same id stay or go together; of a group of copies the least id stays; whole
texts of any length are judged; further columns, whatever their names, are carried to the last stage, which has its
own; an empty table passes through empty. A stage's files are removed once the next one has been written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, golay_simhash, language_id, packing, toxicity
from keyloom.llm.common import keep_rows, shared_folder, table
from keyloom.llm.queries import tokenizer_path

#: Cosine with the nearest language below which a text is in none of the learned languages.
LEAST_LANGUAGE = 0.12
#: Near copies: five-word shingles, words of a fingerprint, and bits of all its words in which texts of a similarity
#: (Jaccard) of 0.8 differ at most, but for three standard deviations; then their shingles decide.
COPY_WORDS, COPY_PRINTS, COPY_BITS = 5, 3, 44
#: Toxicity score from which a document goes.
MOST_TOXIC = 0.7


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in."""
    model = spark.sparkContext.broadcast(language_id.fit(docs, F.lit(True)))

    def passes():
        if not model.value:  # no language to be in
            return lambda values: [any(map(str.isalpha, t or "")) for t in values]
        score = language_id.scorer(model.value)
        return lambda values: [lang != language_id.UNKNOWN and s >= LEAST_LANGUAGE for lang, s in score(values)]

    return keep_rows(docs, "text", passes)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below MOST_TOXIC."""
    model = spark.sparkContext.broadcast(toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True)))

    def passes():
        score = model.value.scorer()
        return lambda values: (score(values) < MOST_TOXIC).tolist()

    return keep_rows(docs, "text", passes)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    found = golay_simhash.near_duplicates(docs, size=COPY_WORDS, bits=COPY_BITS, words=COPY_PRINTS)
    copies = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words of benchmark windows cut out; those that are hardly anything else go."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, with their token ids."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", by_language),
    ("toxicity", without_toxic),
    ("simhash_dedup", without_copies),
    ("decontaminate", without_benchmark),
    ("packing", into_sequences),
]

#: SQL can express none of the model-based stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{at}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            done = spark._jvm.org.apache.hadoop.fs.Path(before)
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
        docs, before = spark.read.parquet(path), path
    return docs
