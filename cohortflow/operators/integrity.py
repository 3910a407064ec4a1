"""Checksum manifests over file contents."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import file_blocks, list_files, placed

# What a checksum manifest leaves out.
EXCLUDED_NAMES = ("sha256.txt", ".git", "__pycache__", ".DS_Store", "Thumbs.db")
EXCLUDED_PREFIXES = ("verification_", "copy_log", "missing_", "duplicate_",
                     "destination_folder_validation")


def release_file_filter(files: DataFrame, path: str = "path") -> DataFrame:
    """Drop files with an excluded name or folder, or an excluded name prefix."""
    parts = F.split(F.col(path), "/")
    name = F.element_at(parts, -1)
    prefixed = name.rlike("^(" + "|".join(EXCLUDED_PREFIXES) + ")")
    named = F.arrays_overlap(parts, F.array(*[F.lit(n) for n in EXCLUDED_NAMES]))
    return files.where(~(named | prefixed))


def sha256_manifest(files: DataFrame) -> DataFrame:
    """Digest per included file from ``(path, content)``; contents are read and hashed once."""
    return release_file_filter(files).select(F.sha2("content", 256).alias("digest"), "path")


def relative_paths(files: DataFrame, root: str) -> DataFrame:
    """Files below ``root`` with their path relative to it as ``path`` and the full one as ``uri``.

    The root is matched behind scheme and host, so a host of the same name does not count.
    """
    host = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"
    name = re.sub(host, "", root).strip("/")
    name = f"/{name}/" if name else "/"
    path = F.regexp_replace("path", host, "")
    return files.where(path.startswith(name)).select(
        *[c for c in files.columns if c != "path"], F.col("path").alias("uri"),
        F.substring(path, F.lit(len(name) + 1), F.length("path")).alias("path"))


def _digests(batches):
    """Arrow kernel: SHA-256 of each file, read in blocks."""
    import pyarrow as pa

    for batch in batches:
        digests = []
        for source in zip(*(batch.column(c).to_pylist() for c in ("place", "at", "length")), strict=True):
            digest = hashlib.sha256()
            for block in file_blocks(*source):
                digest.update(block)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), batch.column("path")], names=["digest", "path"])


def _located(spark: SparkSession, root: str, archives: bool = False) -> DataFrame:
    """Files below a folder: path relative to it, and where their bytes are."""
    return relative_paths(placed(list_files(spark, root, archives)), root).select("path", "place", "at", "length")


def checksum_folder(spark: SparkSession, root: str, archives: bool = False) -> DataFrame:
    """``digest, path`` of all included files below an absolute path or URI.

    Paths are relative to the root, and only they decide what is left out. Files are
    streamed, whatever their size. ``archives``: files in ZIP archives count too, see ``list_files``.
    """
    return release_file_filter(_located(spark, root, archives)).mapInArrow(_digests, "digest string, path string")


def verify_checksums(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Recompute the stored digests of ``(path, content)``: OK, MISMATCH or MISSING."""
    return _compared(stored, files.select("path", F.sha2("content", 256).alias("_now")))


def verify_folder(spark: SparkSession, root: str, stored: DataFrame) -> DataFrame:
    """The same for files below a folder, by paths relative to it.

    Only files with a stored digest are read, as streams: a task holds a block of one file.
    """
    wanted = _located(spark, root).join(stored.select("path"), "path", "left_semi")
    return _compared(stored, wanted.mapInArrow(_digests, "digest string, path string").withColumnRenamed("digest", "_now"))


def _compared(stored: DataFrame, now: DataFrame) -> DataFrame:
    status = (F.when(F.col("_now").isNull(), "MISSING")
              .when(F.col("_now") == F.col("digest"), "OK").otherwise("MISMATCH"))
    return stored.join(now, "path", "left").select("path", "digest", status.alias("status"))
