"""What the operators share: tables, the shared folder, ordered buckets, word caches.

Intermediate tables live in the folder that ``spark.checkpoint.dir`` names, which driver and
executors share; a folder of our own is set only where that setting is missing (tests).
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word pattern [^\x20\x09-\x0D]+, as a character class for Java and RE2.
SPACES = r"[\x20\x09-\x0D]"

_temporary: list[tuple[SparkSession, str]] = []
_results: list[str] = []


#: Bytes of an Arrow batch, in the JVM and in Python at once, unless the session sets its own bound.
BATCH = "8m"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; rows go to Python in batches of bounded bytes, as some texts are very long."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary folder only where a local session names none, else ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cuewright-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the session ends or by release()."""
    path = f"{shared_dir(spark)}/cuewright-{label}-{uuid.uuid4().hex}"
    _temporary.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it again."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """As written(), for results that release() leaves alone; removed when the process ends."""
    kept = list(_temporary)
    path = new_folder(df.sparkSession, label)
    _temporary[:] = kept
    _results.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes the tables written so far; for callers whose results have been stored elsewhere."""
    global _temporary
    jvm = spark.sparkContext._jvm
    for owner, path in _temporary:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - a session that has ended took its gateway with it
            if path.startswith("file://"):
                import shutil

                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    _temporary = []


@atexit.register
def _release_at_exit() -> None:
    import shutil

    for path in [*_results, *(p for _, p in _temporary)]:
        if path.startswith("file://"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def store(uri: str):
    """(filesystem, path) of a shared folder for writers and readers of plain files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def write_file(uri: str, payload: bytes) -> None:
    """Writes under a name of this attempt's own; only what a task that succeeds reports is read."""
    filesystem, path = store(uri)
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    with filesystem.open_output_stream(path) as out:
        out.write(payload)


def read_file(uri: str) -> bytes:
    filesystem, path = store(uri)
    with filesystem.open_input_stream(path) as source:
        return source.read()


def splits(df: DataFrame, column: str, buckets: int) -> list:
    """At most buckets - 1 values of the column that cut it into about equal runs (a bounded list)."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(column, F.array(*map(F.lit, shares)), F.lit(max(10000, 4 * buckets))).alias("s")).first()["s"]
    return sorted(set(found or []))


def bucket_of(column: Column, cuts: list) -> Column:
    """How many cuts are at or below the value: rises with it. Nulls are in bucket 0."""
    if not cuts:
        return F.lit(0)
    # binary search over the sorted cuts, as nested comparisons of depth log2
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column >= F.lit(cuts[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    return F.coalesce(F.when(column.isNotNull(), search(0, len(cuts))), F.lit(0))


def order_buckets(spark: SparkSession, least: int = 1, most: int = 2000) -> int:
    """How many ordered buckets to deal rows to: a few for each shuffle partition."""
    return max(least, min(most, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


class WordCache(dict):
    """word -> value, filled in batches by resolve(words) -> values; emptied when it is full."""

    def __init__(self, resolve: Callable[[list[str]], Iterable], most: int = 400_000):
        super().__init__()
        self.resolve, self.most = resolve, most

    def learn(self, words: set) -> None:
        missing = list(words.difference(self))
        if missing:
            if len(self) + len(missing) > self.most:
                self.clear()
                missing = list(words)
            for at in range(0, len(missing), 50_000):
                part = missing[at : at + 50_000]
                self.update(zip(part, self.resolve(part), strict=True))


def portions(texts: list[str], chars: int = 2_000_000) -> Iterator[list[int]]:
    """Positions of texts in runs of about so many characters, so that word sets stay small."""
    run, held = [], 0
    for i, text in enumerate(texts):
        run.append(i)
        held += len(text)
        if held >= chars:
            yield run
            run, held = [], 0
    if run:
        yield run
