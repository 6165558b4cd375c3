"""The corpus pipeline: quality, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes each stage's rows as Parquet in the shared folder and gives
them, reread, to the next. Rows that repeat an id and text are one document: quality and secrets
decide alike for all of them, and the de-duplicating stages keep one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import discard, prepare, read_table, staged
from spindle.llm.exactdedup import exact_dedup
from spindle.llm.quality import train, with_score
from spindle.llm.queries import packed
from spindle.llm.secrets import find_secrets, redacted
from spindle.llm.simhash import simhash_groups


BROADCAST_ROWS = 1_000_000  # row numbers (8 bytes each) that may be broadcast
BROADCAST_BYTES = 64 << 20  # bytes of changed texts that may be


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a score of 0.5 or more."""
    prepare(spark)
    model = train(docs, read_table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("d"), F.col("text").alias("t"))
    return with_score(rows, model, text="t", out="s").where("s >= 0.5").select("d.*")


_numbered: list[DataFrame] = []


def row_name(docs: DataFrame, name: str = "__row") -> str:
    """A column name that ``docs`` has not."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` as a table with a row number in the column ``row_name(docs)``, so that rows without
    an id, or that repeat one, are rows of their own.

    A stage's result is written before the next stage begins, so the tables of earlier stages
    that ``docs`` does not read any more are deleted here and do not add up.
    """
    read = docs.inputFiles()
    spent = [t for t in _numbered if t.sparkSession is not docs.sparkSession or not any(t._staged_path in f for f in read)]
    discard(*[t for t in spent if t.sparkSession is docs.sparkSession])
    _numbered[:] = [t for t in _numbered if not any(t is x for x in spent)]
    out = staged(docs.withColumn(row_name(docs), F.monotonically_increasing_id()), name)
    _numbered.append(out)
    return out


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the row with the smallest id (without one, last;
    among rows of one id the first)."""
    return _one_of_each(docs, lambda rows: exact_dedup(rows).select(F.col("doc_id").alias("n"), F.col("keep_id").alias("g")), "exact-in")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, chosen likewise."""
    return _one_of_each(docs, lambda rows: simhash_groups(rows, shingle=3, radius=2).select(F.col("doc_id").alias("n"), F.col("component_id").alias("g")), "near-in")


def _one_of_each(docs: DataFrame, groups, name: str) -> DataFrame:
    """The row with the smallest id of every group ``g`` that ``groups`` gives the row numbers ``n``.

    Texts stay where they are: ids and numbers alone are grouped, and the numbers that go are few
    and mostly broadcast.
    """
    prepare(docs.sparkSession)
    rows, n = numbered(docs, name), row_name(docs)
    ids = rows.select(F.col(n).alias("n"), F.col("doc_id").alias("id"))
    found = staged(groups(rows.select(F.col(n).alias("doc_id"), "text")).join(ids, "n"), "groups")
    first = found.groupBy("g").agg(F.min(F.struct(F.col("id").isNull(), "id", "n")).alias("w")).select(F.col("w.n").alias("n"))
    gone = staged(found.select("n").join(first, "n", "left_anti"), "gone")
    discard(found)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone.withColumnRenamed("n", n), n, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each secret is replaced by its kind in angle brackets."""
    prepare(spark)
    rows, n, clean = numbered(docs, "secrets-in"), row_name(docs), row_name(docs, "__clean")
    found = find_secrets(rows.select(F.col(n).alias("doc_id"), "text"))
    hit = found.where(F.size("spans") > 0).select(F.col("__id").alias(n), redacted(F.col("__text"), F.col("spans")).alias(clean))
    hit = staged(hit, "redacted")
    if (hit.agg(F.sum(F.octet_length(clean) + 8)).first()[0] or 0) <= BROADCAST_BYTES:
        hit = F.broadcast(hit)
    out = rows.join(hit, n, "left")
    replaced = {
        "text": F.coalesce(clean, "text"),
        "n_chars": F.when(F.col(clean).isNull(), F.col("n_chars")).otherwise(F.length(clean)).cast("long"),
    }
    return out.select(*[replaced.get(c, F.col(c)).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packed(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_copies),
    ("simhash_dedup", near_copies),
    ("secret_scan", secrets),
    ("packing", packing),
]
# learned scores and tokenizer ids have no SQL; tests/llm holds the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
