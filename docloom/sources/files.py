"""Files of folders as rows, listed and read in tasks.

Spark's binaryFile reader holds the status of every file on the driver, a kilobyte each. Here tasks list the folders, a
level after the other, and what they find is a table; other tasks read the files. Of a glob the driver expands all but the
last name, so it holds folders at most. That is for local and mounted folders: paths of other file systems go to Spark's reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..shipping import ship

#: Folders that one task lists, and files and bytes that one task reads, where that makes more tasks than the session's shuffle partitions.
TASK_FOLDERS, TASK_FILES, TASK_BYTES = 100, 5_000, 256 << 20
#: Names, and files or their bytes, that go to Spark together.
BATCH_NAMES, BATCH_FILES, BATCH_BYTES = 10_000, 1_000, 16 << 20


def local_path(path: str) -> str | None:
    """The path that a local or mounted file has for Python, read as Hadoop reads it (no %20 stands for a space); None for other file systems."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def _lister(wanted: str, recursive: bool):
    """What is in folders (path, glob): all files with a wanted name, and the folders to list next. With a glob only entries that match it, folders among them."""

    def run(batches):
        import os
        import re

        import pyarrow as pa

        types = pa.schema([("path", pa.string()), ("ms", pa.int64()), ("length", pa.int64()), ("folder", pa.bool_())])
        file, rows = re.compile(wanted, re.DOTALL), []
        for batch in batches:
            for at, glob in zip(batch.column("path").to_pylist(), batch.column("glob").to_pylist(), strict=True):
                chosen = glob and re.compile(glob, re.DOTALL)
                with os.scandir(local_path(at)) as entries:
                    for e in entries:
                        if chosen and not chosen.fullmatch(e.name):
                            continue
                        try:
                            s, folder = e.stat(), e.is_dir()
                        except FileNotFoundError:  # gone meanwhile
                            continue
                        if folder and (chosen or ((recursive or "=" in e.name) and not _hidden(e.name))) or not folder and not _hidden(e.name) and file.fullmatch(e.name):
                            rows.append((f"{at.rstrip('/')}/{e.name}", s.st_mtime_ns // 1_000_000, s.st_size, folder))
                        if len(rows) >= BATCH_NAMES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)

    return run


def _roots(spark: SparkSession, path: str) -> list[tuple[str, str | None]]:
    """Where the listing begins: folders, each with a regular expression for the names in it, or None for all; no folder if nothing is there."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    at = hadoop.Path(path)
    system = at.getFileSystem(conf)
    if not any(c in path for c in "{}[]*?\\"):
        at = system.makeQualified(at)
        if at.isRoot() or (system.exists(at) and system.getFileStatus(at).isDirectory()):
            return [(at.toString(), None)]
    found = []
    for one in hadoop.GlobExpander.expand(path):
        at = system.makeQualified(hadoop.Path(one))
        glob = hadoop.GlobPattern(at.getName()).compiled().toString()
        found += [(s.getPath().toString(), glob) for s in system.globStatus(at.getParent()) or () if s.isDirectory()]
    return found


def listed(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, modificationTime, length of the files that Spark's binaryFile reader finds under path (a folder, file or glob) with names of a pattern; for contents().

    Like there, names that begin with . or _ don't count, and folders below are entered if recursive or named key=value. Empty files count
    here; Spark's reader leaves them out.
    """
    reader = ship(spark).read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    if hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return reader.load(path)
    lister = _lister(hadoop.GlobPattern(pattern).compiled().toString(), recursive)
    level, found, least = spark.createDataFrame(_roots(spark, path), "path string, glob string"), [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    while n := level.count():
        tasks = min(n, max(least, n // TASK_FOLDERS))
        found.append(store.keep(level.repartition(tasks, "path").mapInArrow(lister, "path string, ms long, length long, folder boolean"), "file-listing"))
        level = found[-1].where("folder").select("path", F.lit(None).cast("string").alias("glob"))
    if not found or found[0].isEmpty():
        return reader.load(path)  # no such path, or an empty one: Spark's reader says which
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    if "{" in path:  # its alternatives can overlap
        every = every.dropDuplicates(["path"])
    return every.where("not folder").select("path", F.timestamp_millis("ms").alias("modificationTime"), "length")


def _read(batches):
    import pyarrow as pa

    for files in batches:
        began, contents, size = 0, [], 0
        paths = files.column("path").to_pylist()
        for k, path in enumerate(paths):
            with open(local_path(path), "rb") as f:
                contents.append(f.read())
            size += len(contents[-1])
            if len(contents) >= BATCH_FILES or size >= BATCH_BYTES or k + 1 == len(paths):
                yield pa.RecordBatch.from_arrays([*files.slice(began, len(contents)).columns, pa.array(contents, pa.binary())], [*files.schema.names, "content"])
                began, contents, size = k + 1, [], 0


def contents(files: DataFrame) -> DataFrame:
    """path, modificationTime, length, content of listed() files, each task a share of them by hash of path."""
    if "content" in files.columns:
        return files
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(n, max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_FILES, size // TASK_BYTES)))
    return files.select("path", "modificationTime", "length").repartition(tasks, "path").mapInArrow(_read, "path string, modificationTime timestamp, length long, content binary")
