"""The corpus pipeline: language ID, quality classifier, n-gram Jaccard join, PII, best-fit packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each
result is written as Parquet in the shared folder and read again as the next stage's docs.

- language: rows whose language is undetermined, or less than LANGUAGE_KNOWN of whose n-grams any learned language holds
  (texts in languages that weren't learned, random letters), go; so do null, empty and letterless texts. Texts in two
  learned languages stay. Rows without a language of their own are judged, and teach nothing; without any row that
  teaches, all go.
- quality: rows that the weak-label classifier holds for bad go; a score of just a half stays. Null and empty texts get
  abstentions of all labellers.
- near duplicates: of each group of linked documents the one with the smallest doc_id stays; documents without words link
  with nothing and stay, rows that repeat a doc_id share its fate, rows with a null doc_id stay.
- private data: base spans are generalised to their kind, disclosing terms removed or generalised; n_chars is counted
  again. Null texts stay null.
- packing: the placement of every piece (its columns are those of the packing operator); null texts are one end id.

No stage needs more of a row than doc_id, text and, where it teaches, lang; any column may be null, and columns beyond
those of documents are dropped. Equal texts get equal results, but for which of them stays and where it is placed. An
empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import langid, ngram_join, packing, pii, quality
from lakeloom.llm.common import id_bucket, materialise, table

#: Of the test tables' texts learned languages hold 0.75 of the n-grams at least, in all but one of 2,000 0.9; of texts in
#: other languages and of random letters 0.55 at most.
LANGUAGE_KNOWN = 0.6

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.filter(id_bucket(F.col("doc_id"), 3) != 1))
    found = langid.identify(docs, model, keep=COLUMNS, known=True)
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("known") >= LANGUAGE_KNOWN)).select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.classify(docs, quality.fit(docs), keep=COLUMNS).filter("kept").select(*COLUMNS)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.join(docs)
    # the rows that go; where a doc_id repeats, all its rows are one document and share its fate
    gone = groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", identified), ("quality", good), ("near duplicates", single), ("private data", private), ("packing", packed)]

#: Fitted models and hashed sets have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
