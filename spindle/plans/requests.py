"""On-request analysis: JSON lines in, results stored, nothing marked.

A request is one line of text. Lines that are no JSON object of the request's form, and requests that
break a rule, go to a quarantine table with their reasons; the others are analysed and upserted by their
business key. The source's status and the status log are left alone: a request is not part of
the backlog, and a document of the backlog that also came as a request is still due.

Edge cases: blank lines are no requests; an id may be absent; requests of one key in one call keep the
latest; a call without a valid request stores nothing; replaying a call replaces the same keys and the
same quarantine folder.

The lines are read twice, for the analysis and for the quarantine, and parsed each time: parsed requests
take many times the lines' bytes. They must be the same both times, as files are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.config import EngineConfig
from spindle.functions.text import non_blank
from spindle.operators.enrich import Models, analyse
from spindle.operators.validate import normalize, validate
from spindle.plans.batch import analyse_apart
from spindle.schemas import REQUEST_JSON, ROW_KEY
from spindle.session import ensure_checkpoint_dir
from spindle.sinks import results as rs

DAMAGED = "line is not a request in JSON"
FAILED = "analysis failed"
_RAW = "_damaged"
QUARANTINE = "line string, reasons array<string>, batch_id bigint"


@dataclass
class RequestOutcome:
    batch_id: int
    lines: int
    stored: int
    rejected: int


def request_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of every file below ``path``; blank lines are left out."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.where(non_blank("line"))


def read_requests(lines: DataFrame) -> DataFrame:
    """Normalised, validated requests with their ``line``.

    A line that is damaged, is no object or holds a value of another type than its field's keeps
    one reason and no fields: what a parser makes of half a line is not validated.
    """
    kind = T.StructType([*REQUEST_JSON.fields, T.StructField(_RAW, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW}
    parsed = lines.select("line", F.from_json("line", kind, options).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{_RAW}").isNotNull()
    fields = [F.when(~bad, F.col(f"r.{f.name}")).alias(f.name) for f in REQUEST_JSON.fields]
    checked = validate(normalize(parsed.select(*fields, F.struct("line", bad.alias("bad")).alias(ROW_KEY))))
    why = F.when(F.col(f"{ROW_KEY}.bad"), F.array(F.lit(DAMAGED))).otherwise(F.col("reasons"))
    out = checked.withColumn("reasons", why).withColumn("line", F.col(f"{ROW_KEY}.line"))
    return out.withColumn("is_valid", F.size("reasons") == 0).drop(ROW_KEY)


def analyse_requests(
    spark: SparkSession, lines: DataFrame, batch_id: int, models: Models, results_root: str, quarantine_root: str,
    cfg: EngineConfig = EngineConfig(),
) -> RequestOutcome:
    """Analyse the valid requests, upsert their results, and write the others to the quarantine.

    Only the analysis, a small row for each valid request, is checkpointed before the store. A request
    on which the analysis itself fails is found by halving and quarantined like a damaged one; the
    valid requests are checkpointed for that. A failing store is the caller's error, since there is no
    status from which a retry would start.
    """
    ensure_checkpoint_dir(spark)
    rows = read_requests(lines).withColumn("_n", F.monotonically_increasing_id())
    # the filter reads the row number too: it stays above the parse, which it would repeat below it
    bad = rows.where(~F.col("is_valid") & (F.col("_n") >= 0)).select("line", "reasons")
    try:
        analysed = analyse(rows.drop("line", "_n"), models, cfg.top_n_keywords, "is_valid").checkpoint(eager=True)
    except Exception:
        valid = rows.where("is_valid").checkpoint(eager=True)
        analysed, broken = analyse_apart(valid, "_n", lambda df: analyse(df.drop("line"), models, cfg.top_n_keywords))
        failed = valid.where(F.col("_n").isin(list(broken)))
        bad = bad.unionByName(failed.select("line", F.array(F.lit(FAILED)).alias("reasons")))
    stored = analysed.count()
    if stored:
        rs.write_upsert(spark, results_root, rs.result_rows(analysed, batch_id, cfg.model_version), batch_id, new_rows_bound=stored)
    bad.write.mode("overwrite").parquet(f"{quarantine_root.rstrip('/')}/batch_id={batch_id}")
    rejected = read_quarantine(spark, quarantine_root).where(F.col("batch_id") == batch_id).count()
    return RequestOutcome(batch_id, stored + rejected, stored, rejected)


def read_quarantine(spark: SparkSession, quarantine_root: str) -> DataFrame:
    """(line, reasons, batch_id) of every call."""
    return spark.read.schema(QUARANTINE).option("basePath", quarantine_root).parquet(quarantine_root)
