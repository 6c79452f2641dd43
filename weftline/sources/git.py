"""Commit history as tables: one `git log` of a repository, read once on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "hash string, path string, author string, date string, ts timestamp, added string, removed string"


def _git(root: str, *args: str) -> str:
    r = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    if r.returncode:
        raise ValueError(f"not a git repository: {root}: {r.stderr.strip()[:200]}")
    return r.stdout


def history(spark: SparkSession, root: str, since_days: int | None = None) -> DataFrame:
    """(hash, path, author, date, ts, added, removed): a row per commit and file; '-' stands where a file is binary.

    Fields are apart by a control character, so that names may hold any other.
    """
    _git(root, "rev-parse", "--git-dir")
    if subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True).returncode:
        return spark.createDataFrame([], SCHEMA)
    log = _git(root, "log", "--no-renames", "--numstat", "--date=iso-strict", "--format=%x1e%H%x1f%an%x1f%ad", *([f"--since={since_days} days ago"] if since_days else []))
    rows = []
    for entry in log.split("\x1e")[1:]:
        head, _, body = entry.partition("\n")
        commit, author, date = head.split("\x1f")
        for line in body.splitlines():
            if line.count("\t") >= 2:
                added, removed, path = line.split("\t", 2)
                rows.append((commit, path, author, date, added, removed))
    df = spark.createDataFrame(rows, "hash string, path string, author string, date string, added string, removed string")
    return df.selectExpr("hash", "path", "author", "date", "to_timestamp(date) as ts", "added", "removed")
