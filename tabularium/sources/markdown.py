"""Folders of Markdown notes and ledgers in CSV as tables, and the files written from tables."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "arquivo caminho idioma paginas pgs_sem_texto tem_camada_texto precisou_ocr ocr_status arquivo_ocr tipo_fonte_provavel exige_ancora_pagina rota proximo_passo area status confiabilidade".split()


def scan(spark: SparkSession, root: str, recursive: bool = True, ignored: tuple[str, ...] = ("99-Templates", "Radar", ".obsidian", ".trash"), skip_name: str = "^(RELATORIO|_)") -> DataFrame:
    """(path, file_name, stem, mtime, size, text) of the notes below ``root``, one row a file.

    ``path`` is relative; folders above ``root`` are never tested against ``ignored``.
    """
    raw = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    base = "/" + os.path.abspath(root).strip("/") + "/"
    rel = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^file:/+" + base.strip("/").replace(".", r"\.") + "/", "")
    rows = raw.select(rel.alias("path"), F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B")).alias("file_name"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
    keep = ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in ignored])) & ~F.col("file_name").rlike(skip_name)
    return rows.where(keep).withColumn("stem", F.regexp_replace("file_name", r"(?i)\.md$", ""))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The control ledger: 16 text columns, all quoted; a missing file is an empty ledger."""
    schema = ", ".join(f"{c} string" for c in LEDGER)
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def write_ledger(df: DataFrame, path: str) -> None:
    """Ledger rows as quoted CSV with a header."""
    df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEDGER]).write.option("header", True).option("quoteAll", True).option("escape", '"').mode("overwrite").csv(path)


def nul_list(spark: SparkSession, path: str) -> DataFrame:
    """File names parted by NUL, as written by ``find -print0``."""
    return spark.read.option("lineSep", "\0").text(path).select(F.col("value").alias("path")).where("path != ''")


def export(df: DataFrame, root: str) -> int:
    """Write rows (path, text) as files below ``root``, each whole or not at all; returns how many.

    Files are written by the executors, so ``root`` must be a folder they share.
    """

    def save(rows: Iterator) -> Iterator:
        for r in rows:
            at = os.path.join(root, *[x for x in r["path"].split("/") if x not in ("", ".", "..")])
            os.makedirs(os.path.dirname(at), exist_ok=True)
            part = f"{at}.{hashlib.md5(r['path'].encode()).hexdigest()[:8]}.part"
            with open(part, "w", encoding="utf-8") as f:
                f.write(r["text"] or "")
            os.replace(part, at)
            yield 1

    return df.select("path", "text").rdd.mapPartitions(save).count()


def stale(listing: DataFrame, fresh: DataFrame) -> DataFrame:
    """(path): files of an earlier run that the new one doesn't write again."""
    return listing.select("path").distinct().join(fresh.select("path").distinct(), "path", "left_anti")
