"""Incoming findings as a stream: each content is worked on once, however often its file is delivered.

The file source remembers paths, not contents; so a state table of content
digests stands beside the checkpoint. A micro-batch is joined with the state by
digest, and what is new is matched with the notes it affects and appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tabularium.operators.connect import affected, extract

FINDING = "titulo string, tipo_achado string, area array<string>, data string, fonte string, url string, alerta boolean, corpo string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def digest(df: DataFrame) -> DataFrame:
    """Adds ``digest``: md5 of a finding's content; nulls count as empty."""
    return df.withColumn("digest", F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("titulo", "tipo_achado", "data", "url", "corpo")])))


def start(spark: SparkSession, inbox: str, notes_ids: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Reads JSON findings from ``inbox`` until none is left; writes matches below ``out``/matches, digests below ``out``/seen.

    A batch that is delivered again after a failure finds its digests in the
    state and adds nothing twice: matches carry the batch id, and are written
    before the digests, with rows of the same batch replaced.
    """
    stream = spark.readStream.schema(FINDING).json(inbox)

    def work(batch: DataFrame, batch_id: int) -> None:
        seen = _table(spark, f"{out}/seen", "digest string, batch long").where(F.col("batch") != batch_id).select("digest")
        new = digest(batch).dropDuplicates(["digest"]).join(seen, "digest", "left_anti")
        ids = extract(new.select("digest", F.concat_ws(" ", "titulo", "corpo").alias("t")), "digest", "t").withColumnRenamed("digest", "finding")
        affected(ids, notes_ids).write.mode("overwrite").parquet(f"{out}/matches/batch={batch_id}")
        new.select("digest").write.mode("overwrite").parquet(f"{out}/seen/batch={batch_id}")

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def intake(findings: DataFrame, known_titles: DataFrame, today: str) -> DataFrame:
    """findings + (accepted, reason, warning): what an intake would take.

    Rejected are findings without title or text, with another address than
    http(s), or whose title is there already; a date of another shape is
    replaced by ``today`` with a warning.
    """
    j = findings.join(known_titles.select(F.col("titulo"), F.lit(True).alias("known")).distinct(), "titulo", "left")
    reason = (
        F.when(F.coalesce(F.trim("titulo"), F.lit("")) == "", "no title")
        .when(F.coalesce(F.trim("corpo"), F.lit("")) == "", "no text")
        .when(F.col("url").isNotNull() & (F.col("url") != "") & ~F.col("url").rlike("^https?://"), "address")
        .when(F.col("known"), "exists")
    )
    odd = ~F.coalesce(F.col("data"), F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}$")
    out = j.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).withColumn("warning", F.when(odd, "date"))
    return out.withColumn("data", F.when(odd, F.lit(today)).otherwise(F.col("data"))).drop("known")
