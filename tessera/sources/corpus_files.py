"""Corpus folders: recursive reading, decoding, manifests, receipts, XML routes and the harvest report."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.arrow import decoded_text, visible_html, xml_text

MANIFEST = "name string, kind string, url string, path string"


def ensure_folder(path: str) -> str:
    """Make the watched folder if it isn't there; a file in its place is refused."""
    at = Path(path)
    if at.exists() and not at.is_dir():
        raise NotADirectoryError(path)
    at.mkdir(parents=True, exist_ok=True)
    return str(at.resolve())


def folder_state(path: str) -> tuple[bool, list[str]]:
    """(whether the folder is there, its files in order, not following links): what a scan reads."""
    if not os.path.isdir(path):
        return False, []
    found = [os.path.join(d, name) for d, folders, names in os.walk(path, followlinks=False) for name in names]
    return True, sorted(f for f in found if os.path.isfile(f) and not os.path.islink(f))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, content, text) of all files below a folder; text is null for binary ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "content", decoded_text("content").alias("text"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or have another modification time, and known ones that ask for a retry."""
    done = known.where(~F.coalesce("retry", F.lit(False))).select("path", "modified")
    return files.join(done, ["path", "modified"], "left_anti")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated sources, blank lines and comments skipped; a malformed row or an unknown kind fails the read."""
    rows = spark.read.csv(path, sep="\t", schema=MANIFEST, comment="#", mode="FAILFAST", ignoreLeadingWhiteSpace=True)
    return rows.select(*[F.when(F.col("kind").isin("file", "git"), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("unknown source kind: "), F.coalesce("kind", F.lit("none"))))).alias(c) for c in rows.columns])


def receipt_actions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(name, action) of each current fetch (name, url, remote_sha, local_sha) against the last receipts (name, url, sha256)."""
    old = previous.select("name", F.col("url").alias("old_url"), F.col("sha256").alias("old_sha"))
    c = F.col
    action = (
        F.when(c("old_url").isNotNull() & (c("old_url") != c("url")), "SOURCE_URL_CHANGED")
        .when(c("local_sha").isNull(), "DOWNLOADED")
        .when(c("local_sha") != c("remote_sha"), F.when(c("old_sha").isNull(), "UPDATED").when(c("old_sha") == c("remote_sha"), "REPAIRED_LOCAL").otherwise("UPSTREAM_CHANGED"))
        .otherwise(F.when(c("old_sha").isNotNull() & (c("old_sha") != c("remote_sha")), "RECEIPT_REFRESHED").otherwise("VERIFIED"))
    )
    return current.join(old, "name", "left").select("name", action.alias("action"))


def routes(books: DataFrame) -> DataFrame:
    """(collection, module): what the collections of a book list (collection, xml) name."""
    return books.select("collection", F.explode(F.expr("xpath(xml, '//*[local-name()=\"module\"]/@document')")).alias("module")).distinct()


def missing_modules(wanted: DataFrame, present: DataFrame) -> DataFrame:
    return wanted.join(present.select("module"), "module", "left_anti")


def require_modules(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """``wanted`` if all its modules are present; else it fails and names some."""
    lost = [r["module"] for r in missing_modules(wanted, present).select("module").distinct().orderBy("module").limit(8).collect()]
    if lost:
        raise FileNotFoundError("modules without a file: " + ", ".join(lost))
    return wanted


def under(root: str, name: str) -> str:
    """The path of ``name`` below ``root``; one that leads out of it is refused."""
    at = (Path(root) / name).resolve()
    if not at.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{name} lies outside {root}")
    return str(at)


def harvested_name(path):
    """Where a cleaned file goes: markup loses its form, so it gets .txt behind its name."""
    markup = T.extension(path).isin(".html", ".htm", ".xhtml", ".xml", ".cnxml")
    return F.when(markup, F.concat(path, F.lit(".txt"))).otherwise(path)


def cleaned(path, original):
    """The text of a file by its extension, white space collapsed."""
    ext = T.extension(path)
    body = (
        F.when(ext.isin(*T.MARKDOWN_EXTENSIONS), T.clean_markdown(original))
        .when(ext.isin(*T.ASCIIDOC_EXTENSIONS), T.clean_asciidoc(original))
        .when(ext.isin(*T.TEX_EXTENSIONS), T.clean_tex(original))
        .when(ext.isin(".html", ".htm", ".xhtml"), visible_html(original))
        .when(ext.isin(".xml", ".cnxml"), xml_text(original))
        .otherwise(original)
    )
    return T.collapse(body)


def harvest(files: DataFrame) -> DataFrame:
    """One row per file (path, text): status, reason, cleaned text and sizes; the first failing rule gives the reason."""
    out = files.withColumn("cleaned", cleaned(F.col("path"), F.col("text")))
    reason = F.coalesce(T.path_reject(F.col("path")), F.when(F.col("text").isNull(), "not valid UTF-8"), T.content_reject(T.extension(F.col("path")), F.col("text"), F.col("cleaned")))
    out = out.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "KEEP").otherwise("REJECT"))
    words = F.when(F.col("status") == "KEEP", F.size(F.regexp_extract_all("cleaned", F.lit(T.WORD)))).otherwise(0)
    return out.select("status", "path", F.coalesce("reason", F.lit("admitted")).alias("reason"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes_in"), F.when(F.col("status") == "KEEP", F.octet_length("cleaned")).otherwise(0).cast("long").alias("bytes_out"), words.cast("long").alias("words"))


def harvest_totals(report: DataFrame) -> DataFrame:
    return report.groupBy("status", "reason").agg(F.count("*").alias("files"))
