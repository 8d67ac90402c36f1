"""Work that goes on in steps: cursors per credential, watching for changes, batches with checkpoints, samples by phase."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Shares of the whole at which a partial result is published.
MILESTONES = (0.10, 0.25, 0.50, 0.75)


def _path(spark: SparkSession, folder: str, name: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder, name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Write a small file by one renaming that overwrites."""
    jvm = spark.sparkContext._jvm
    path, fs = _path(spark, folder, name)
    fresh = jvm.org.apache.hadoop.fs.Path(folder, f".{name}.new")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, path, over)


def _read(spark: SparkSession, folder: str, name: str) -> str | None:
    path, fs = _path(spark, folder, name)
    return "\n".join(r["value"] for r in spark.read.text(path.toString()).collect()) if fs.exists(path) else None


def _cursor_name(credential: str) -> str:
    return f"cursor-{hashlib.sha256(credential.encode()).hexdigest()[:16]}.json"


def read_cursor(spark: SparkSession, folder: str, credential: str) -> str:
    """The key after which a credential's next push begins; '' for one that never pushed or whose file is spoilt."""
    try:
        return str(json.loads(_read(spark, folder, _cursor_name(credential)) or "{}").get("cursor", ""))
    except ValueError:
        return ""


def push(spark: SparkSession, folder: str, credential: str, events: DataFrame, send: Callable[[DataFrame], None], limit: int = 500) -> int:
    """Send a credential's next page of ``events(cursor, ...)`` in order and advance its cursor; it stays where sending fails."""
    page = events.where(F.col("cursor") > read_cursor(spark, folder, credential)).orderBy("cursor").limit(limit)
    row = page.agg(F.count(F.lit(1)).alias("n"), F.max("cursor").alias("last")).first()
    if row["n"]:
        send(page)
        _replace(spark, folder, _cursor_name(credential), json.dumps({"cursor": row["last"]}))
    return row["n"]


def digest(files: DataFrame) -> str:
    """A digest of the state of ``files(path, hash)``, whatever their order."""
    h = F.xxhash64("path", "hash")
    r = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x")).first()
    return f"{r['n']}-{r['x'] & (1 << 64) - 1:016x}"


class Watch:
    """Runs an action when the state of files has changed and then held still: once per state, again after a failure.

    ``step`` is called for each look, by a timer or by ``foreachBatch`` of a stream over changes. A new state
    has to be seen ``hold`` times in a row before the action runs, so a burst of changes costs one run; an
    action that fails leaves the old state in place, so the next look tries again.
    """

    def __init__(self, act: Callable[[], None], hold: int = 2):
        self.act, self.hold, self.done, self.seen, self.times, self.failures = act, hold, None, None, 0, 0

    def step(self, state: str) -> bool:
        self.times = self.times + 1 if state == self.seen else 1
        self.seen = state
        if state == self.done or self.times < self.hold:
            return False
        try:
            self.act()
        except Exception:  # noqa: BLE001 - whatever the action raises, it is tried again
            self.failures += 1
            self.times = 0
            return False
        self.done = state
        return True


def progressive(rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], folder: str, batches: int = 20, stop_after: int | None = None) -> list[float]:
    """Work on rows in batches by a hash of their key, each written under its number; milestones are published as they are met.

    A batch that is there already is not worked on again, so a run that was stopped goes on where it was.
    ``stop_after`` pauses after so many new batches. Returns the milestones of this run.
    """
    spark = rows.sparkSession
    tagged = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(batches)))
    met, fresh = [], 0
    for b in range(batches):
        mark, fs = _path(spark, f"{folder}/batch={b}", "_SUCCESS")
        if not fs.exists(mark):
            if stop_after is not None and fresh >= stop_after:
                break
            work(tagged.where(F.col("_b") == b).drop("_b")).write.mode("overwrite").parquet(f"{folder}/batch={b}")
            fresh += 1
        for m in MILESTONES:
            if (b + 1) / batches >= m > b / batches:
                met.append(m)
        _replace(spark, folder, "progress.json", json.dumps({"done": b + 1, "of": batches}))
    return met


def progress(spark: SparkSession, folder: str) -> dict:
    return json.loads(_read(spark, folder, "progress.json") or '{"done": 0, "of": 0}')


def phase_of_samples(samples: DataFrame, markers: DataFrame, by: str) -> DataFrame:
    """Samples ``(by, ts, value)`` with the ``phase`` of the last marker ``(by, ts, phase)`` at or before them.

    Both are put in one order of time per ``by`` and the phase is carried on: one shuffle, no join of ranges.
    Samples before the first marker have no phase.
    """
    both = samples.select(by, "ts", "value", F.lit(None).cast("string").alias("phase"), F.lit(1).alias("_k")).unionByName(
        markers.select(by, "ts", F.lit(None).cast("double").alias("value"), "phase", F.lit(0).alias("_k")))
    carried = F.last("phase", ignorenulls=True).over(W.partitionBy(by).orderBy("ts", "_k").rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn("phase", carried).where("_k = 1").drop("_k")
