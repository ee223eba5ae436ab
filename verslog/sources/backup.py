"""Verified backups: files copied with their size and SHA-256, and a manifest. Copies and hashes run on the executors, file by
file and in pieces. Folders are URIs of any file system that pyarrow opens (file, hdfs, s3, gs) or paths that all machines see.
Lists of files are tables; the driver holds none but that of the manifest it writes or reads."""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1
MANIFEST = "BACKUP_MANIFEST.json"
PIECE = 8 << 20


class BackupError(Exception):
    """A backup that can't be made or restored."""


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path within it of a URI, or of an absolute path."""
    if "://" not in uri:
        uri = f"file://{uri[5:] if uri.startswith('file:') else uri}"
    try:
        return pafs.FileSystem.from_uri(uri.rstrip("/"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        raise BackupError(f"no file system for {uri!r}: {e}") from e


def safe_join(folder: str, name: str) -> str:
    """A path below the folder; names that lead out of it are an error."""
    at = posixpath.normpath(posixpath.join(folder, name))
    if posixpath.isabs(name) or not at.startswith(posixpath.normpath(folder) + "/"):
        raise BackupError(f"{name!r} leads out of the folder")
    return at


def _absent(fs: pafs.FileSystem, at: str) -> bool:
    return not fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))


def _hash(fs: pafs.FileSystem, at: str, out=None) -> tuple[int, str]:
    """Size and SHA-256 of a file, read in pieces that go on to ``out``."""
    digest, size = hashlib.sha256(), 0
    with fs.open_input_stream(at, compression=None) as f:
        while piece := f.read(PIECE):
            digest.update(piece)
            size += len(piece)
            if out is not None:
                out.write(piece)
    return size, digest.hexdigest()


def _each_file(spark: SparkSession, names: list[str], source: str, target: str | None) -> DataFrame:
    """(name, size, sha256) of files, of their copies if there is a target; nulls for files that aren't there. A copy is
    written under another name, read again for its hash and then renamed, so a repeated task replaces what it left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from_fs, from_at = open_folder(source)
        to_fs, to_at = open_folder(target) if target is not None else (None, "")
        for b in batches:
            rows = []
            for name in b["name"]:
                at = safe_join(from_at, name)
                if from_fs.get_file_info(at).type != pafs.FileType.File:
                    rows.append((name, None, None))
                elif to_fs is None:
                    rows.append((name, *_hash(from_fs, at)))
                else:
                    to = safe_join(to_at, name)
                    to_fs.create_dir(posixpath.dirname(to), recursive=True)
                    with to_fs.open_output_stream(to + ".tmp", compression=None) as out:
                        _hash(from_fs, at, out)
                    got = _hash(to_fs, to + ".tmp")
                    to_fs.move(to + ".tmp", to)
                    rows.append((name, *got))
            yield pd.DataFrame(rows, columns=["name", "size", "sha256"]).astype({"size": "Int64"})

    n = min(len(names), 4 * spark.sparkContext.defaultParallelism) or 1
    return spark.createDataFrame([(x,) for x in names], "name string").repartition(n).mapInPandas(run, "name string, size long, sha256 string")


def backup(spark: SparkSession, source: str, names: list[str], target: str, snap_seq: int, created_at: str) -> dict:
    """Copies files into an absent or empty folder and writes the manifest last, by rename."""
    fs, at = open_folder(target)
    if not _absent(fs, at):
        raise BackupError("the target isn't empty")
    fs.create_dir(at, recursive=True)
    got = sorted(_each_file(spark, names, source, target).collect())
    if lost := [r.name for r in got if r.sha256 is None]:
        raise BackupError(f"files are gone: {lost[:5]}")
    manifest = {"version": FORMAT_VERSION, "created_at": created_at, "snap_seq": snap_seq, "files": [{"name": r.name, "size": r.size, "sha256": r.sha256} for r in got]}
    with fs.open_output_stream(f"{at}/{MANIFEST}.tmp", compression=None) as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{at}/{MANIFEST}.tmp", f"{at}/{MANIFEST}")
    return manifest


def read_manifest(folder: str) -> dict:
    fs, at = open_folder(folder)
    with fs.open_input_stream(f"{at}/{MANIFEST}", compression=None) as f:
        manifest = json.loads(f.read())
    if manifest.get("version") != FORMAT_VERSION:
        raise BackupError(f"version {manifest.get('version')} of a backup isn't known")
    return manifest


def verify(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(name, problem): MISSING, SIZE or SHA256 for listed files (name, size, sha256) that aren't as found. A null size or hash in
    the list is a problem unless it's null in what was found too; hashes are compared without regard to letter case."""
    have = found.select(F.col("name").alias("n"), F.col("size").alias("s"), F.lower("sha256").alias("h"), F.lit(True).alias("there"))
    both = listed.join(have, F.col("name") == F.col("n"), "left")
    problem = F.when(F.col("there").isNull(), "MISSING").when(~F.col("size").eqNullSafe(F.col("s")), "SIZE").when(~F.lower("sha256").eqNullSafe(F.col("h")), "SHA256")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def restore(spark: SparkSession, folder: str, target: str) -> dict:
    """Verifies every file of a backup first, then copies them into an absent or empty folder."""
    fs, at = open_folder(target)
    manifest = read_manifest(folder)
    if not _absent(fs, at):
        raise BackupError("the target isn't empty")
    names = [f["name"] for f in manifest["files"]]
    for name in names:
        safe_join(at, name)
    listed = spark.createDataFrame([(f["name"], f["size"], f["sha256"]) for f in manifest["files"]], "name string, size long, sha256 string")
    bad = verify(listed, _each_file(spark, names, folder, None)).orderBy("name").limit(5).collect()
    if bad:
        raise BackupError("; ".join(f"{r.name}: {r.problem}" for r in bad))
    fs.create_dir(at, recursive=True)
    copied = verify(listed, _each_file(spark, names, folder, target)).limit(5).collect()
    if copied:
        raise BackupError("; ".join(f"{r.name}: {r.problem} after the copy" for r in copied))
    return manifest
