"""Versioned snapshots: each generation in a folder of its own, published by one small manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """The published manifest, or None."""
    jvm, path, fs = _fs(spark, root)
    at = jvm.org.apache.hadoop.fs.Path(path, MANIFEST)
    if not fs.exists(at):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(at.toString()).collect()))


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], expected: str | None = None, keep: int = 2) -> str:
    """Write all tables of a new generation, then swap the manifest; readers see the old or the new one whole.

    ``expected`` is the generation that the tables were made from: if another one has been published since,
    nothing is published and ValueError is raised. The latest ``keep`` generations stay.
    """
    jvm, path, fs = _fs(spark, root)
    before = read_manifest(spark, root)
    gen = uuid.uuid4().hex
    counts, hashes = {}, {}
    for name, df in tables.items():
        target = f"{root}/gen={gen}/{name}"
        df.write.parquet(target)
        counts[name] = spark.read.parquet(target).count()
        hashes[name] = content_hash(spark.read.parquet(target))
    now = read_manifest(spark, root)
    if (now or {}).get("generation") != (before or {}).get("generation") or expected is not None and (now or {}).get("generation") != expected:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/gen={gen}"), True)
        raise ValueError("another generation was published meanwhile")
    history = [gen, *(now or {}).get("history", [])]
    sizes = {n: fs.getContentSummary(jvm.org.apache.hadoop.fs.Path(f"{root}/gen={gen}/{n}")).getLength() for n in tables}
    body = json.dumps({"schema_version": 2, "generation": gen, "counts": counts, "hashes": hashes, "bytes": sizes, "history": history[:keep]})
    fresh = jvm.org.apache.hadoop.fs.Path(path, f".{MANIFEST}.{gen}")
    out = fs.create(fresh, True)
    out.write(bytearray(body.encode()))
    out.close()
    # One renaming that overwrites: there is a manifest at every moment, the old one or the new one.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(path, MANIFEST), overwrite)
    for old in history[keep:]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/gen={old}"), True)
    return gen


def content_hash(rows: DataFrame) -> str:
    """A hash of all rows whatever their order: sum and exclusive or of the rows' hashes."""
    h = F.xxhash64(*[F.col(c) for c in rows.columns]) if rows.columns else F.lit(0)
    r = rows.agg(F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0)).alias("s")).first()
    return f"{r['x'] & (1 << 64) - 1:016x}{r['s']:x}"


#: Tables already found whole in this process, by generation: counted once, not at each load.
_WHOLE: set[tuple[str, str, str]] = set()


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the published generation; its rows must be as many as the manifest says.

    The rows are counted at the first load of a generation; a later load re-opens it without a count.
    """
    m = read_manifest(spark, root)
    if m is None:
        raise FileNotFoundError(f"{root} has no published generation")
    df = spark.read.parquet(f"{root}/gen={m['generation']}/{name}")
    key = (root, m["generation"], name)
    if key not in _WHOLE:
        if df.count() != m["counts"][name]:
            raise ValueError(f"{name} is not whole")
        _WHOLE.add(key)
    return df
