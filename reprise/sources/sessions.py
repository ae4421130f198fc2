"""Session files: where they lie, which were found, and their lines as rows.

A harness has one root or more. Listing is a metadata pass of the driver (one row a file); contents are read by tasks.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import running_sum

# Harness, root under the home folder, whether transcripts lie in a subfolder of each project.
ROOTS = (
    ("claude_code", ".claude/projects", False),
    ("codex", ".codex/sessions", False),
    ("codex", ".codex/history", False),
    ("cursor", ".cursor/projects", True),
)
TRANSCRIPTS = "agent-transcripts"
UNREADABLE_DIR = "unreadable directory"
OUTSIDE = "symlink points outside the history directory"

FILES = "path string, harness string, mtime double, size_bytes long, project string"
SOURCES = "harness string, status string"
SKIPPED = "path string, reason string"


@dataclass
class Discovery:
    """files: FILES, the latest first; sources: SOURCES, one row a harness; skipped: SKIPPED."""

    files: DataFrame
    sources: DataFrame
    skipped: DataFrame


def cursor_project(folder: Column) -> Column:
    """The part after the last "-projects-" of a folder's name, else the name."""
    tail = F.substring_index(folder, "-projects-", -1)
    return F.when(tail == "", folder).otherwise(tail)


def unreadable_dir(reason: Column) -> Column:
    return (reason == UNREADABLE_DIR) | reason.startswith(UNREADABLE_DIR + ":")


def _reason(e: OSError) -> str:
    return e.strerror or type(e).__name__


class _Walk:
    """Rows of one harness root; nothing that the file system says raises."""

    def __init__(self, harness: str, oldest: float):
        self.harness, self.oldest, self.files, self.skipped = harness, oldest, [], []

    def refused(self, e: OSError) -> None:
        self.skipped.append((str(e.filename), f"{UNREADABLE_DIR}: {_reason(e)}"))

    def status(self, root: str) -> str:
        try:
            os.stat(root)
            os.listdir(root)
        except FileNotFoundError:
            return "absent"
        except NotADirectoryError:
            return f"unreadable: not a directory: {root}"
        except OSError as e:
            return f"unreadable: {e}"
        return "found"

    def tree(self, root: str, folder: str = "") -> str:
        """All session files below root that resolve to a place inside it and aren't too old."""
        state = self.status(root)
        if state != "found":
            return state
        inside = os.path.realpath(root) + os.sep
        for at, _, names in os.walk(root, onerror=self.refused):
            for path in (os.path.join(at, n) for n in names if n.endswith(".jsonl")):
                if not os.path.realpath(path).startswith(inside):
                    self.skipped.append((path, OUTSIDE))
                    continue
                try:
                    st = os.stat(path)
                except OSError:
                    continue
                if st.st_mtime >= self.oldest:
                    self.files.append((path, self.harness, st.st_mtime, st.st_size, folder))
        return state

    def projects(self, root: str) -> str:
        """Transcripts of each project folder below root; one that can't be read is skipped."""
        state = self.status(root)
        for name in sorted(os.listdir(root)) if state == "found" else ():
            try:
                if os.path.isdir(os.path.join(root, name)):
                    self.tree(os.path.join(root, name, TRANSCRIPTS), name)
            except OSError as e:
                self.refused(e)
        return state


def combine(statuses: DataFrame) -> DataFrame:
    """One status a harness of (harness, place, status): found if any root is, else the first that is unreadable, else absent."""
    worth = F.when(F.col("status") == "found", 2).when(F.col("status").startswith("unreadable:"), 1).otherwise(0)
    return statuses.groupBy("harness").agg(F.max_by("status", F.struct(worth, -F.col("place"))).alias("status"))


def discover(spark: SparkSession, home: str, days: int = 14, harnesses: tuple[str, ...] | None = None, now: float | None = None) -> Discovery:
    """Session files below home that changed within so many days; an unknown harness is absent."""
    oldest = (time.time() if now is None else now) - max(0, days) * 86400
    wanted = tuple(dict.fromkeys(h for h, _, _ in ROOTS)) if harnesses is None else harnesses
    files, skipped, statuses = [], [], [(h, len(ROOTS), "absent") for h in wanted]
    for place, (harness, root, nested) in enumerate(ROOTS):
        if harness in wanted:
            walk = _Walk(harness, oldest)
            at = os.path.join(home, root)
            statuses.append((harness, place, walk.projects(at) if nested else walk.tree(at)))
            files += walk.files
            skipped += walk.skipped
    found = spark.createDataFrame(files, FILES)
    found = found.withColumn("project", F.when(F.col("project") != "", cursor_project(F.col("project"))).otherwise(""))
    return Discovery(
        found.orderBy(F.desc("mtime"), "path"), combine(spark.createDataFrame(statuses, "harness string, place int, status string")), spark.createDataFrame(skipped, SKIPPED)
    )


def size_text(n: Column) -> Column:
    kb, mb = n / 1024, n / 1048576
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1048576, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))


def inventory(found: Discovery) -> DataFrame:
    """harness, status, files, bytes, size: what was found for each harness, none included."""
    n = found.files.groupBy("harness").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    both = found.sources.join(n, "harness", "left").select("harness", "status", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return both.withColumn("size", size_text(F.col("bytes")))


def within_budget(files: DataFrame, max_bytes: int | None) -> DataFrame:
    """files with truncated: true from the one on with which the smallest ones add up to more than max_bytes.

    One row a file, so that the running sum is over metadata only.
    """
    if max_bytes is None:
        return files.withColumn("truncated", F.lit(False))
    return running_sum(files, "size_bytes", "path", "upto").withColumn("truncated", F.col("upto") > max_bytes).drop("upto")


def _hidden(path: str) -> bool:
    return os.path.basename(path)[:1] in "._"


def _open_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of files that Spark's readers leave out because of their names."""
    for b in batches:
        for path in b["session_key"].to_pylist():
            with open(path, encoding="utf-8", errors="replace") as f:
                held, at = [], 0
                for line in f:
                    held.append(line.rstrip("\n"))
                    if len(held) == 1024:
                        yield pa.record_batch([[path] * len(held), range(at, at + len(held)), held], ["session_key", "ord", "line"])
                        at, held = at + len(held), []
                if held:
                    yield pa.record_batch([pa.array([path] * len(held)), pa.array(range(at, at + len(held)), pa.int64()), pa.array(held)], ["session_key", "ord", "line"])


def lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """session_key (the path), ord, line: ord grows along a file and has gaps.

    A file may be split between tasks: the place of a line is the start of its block, then its place in the task.
    """
    paths = [r.path for r in files.select("path").collect()]
    shown, hidden = [p for p in paths if not _hidden(p)], [p for p in paths if _hidden(p)]
    out = spark.createDataFrame([], "session_key string, ord long, line string")
    if shown:
        key = F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
        raw = spark.read.text(["file://" + p if p.startswith("/") else p for p in map(_escape, shown)])
        raw = raw.select(key.alias("session_key"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
        # a block has fewer lines than 64 times its bytes before the next one begins, so no line needs to know the others
        place = F.col("block") * 64 + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
        out = out.unionByName(raw.select("session_key", place.alias("ord"), "line"))
    if hidden:
        names = spark.createDataFrame([(p,) for p in hidden], "session_key string").repartition(min(len(hidden), 200))
        out = out.unionByName(names.mapInArrow(_open_lines, "session_key string, ord long, line string"))
    return out


def _escape(path: str) -> str:
    """A path as a pattern that fits it alone."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)
