"""References to records that do not exist, by compressed bitmaps per key range and period."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .lineage import cut
from .skew import salted_join


@F.pandas_udf(ArrayType(IntegerType()))
def _surviving(ref: pd.Series, parent: pd.Series) -> pd.Series:
    """Positions of the bits of ``ref`` that ``parent`` lacks; no parent bitmap keeps all bits."""
    out = []
    for r, p in zip(ref, parent, strict=True):
        bits = np.frombuffer(r, dtype=np.uint8)
        if p is not None:
            bits = bits & ~np.frombuffer(p, dtype=np.uint8)
        out.append(np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype(np.int32))
    return pd.Series(out)


def encode_keys(refs: DataFrame) -> DataFrame:
    """Dictionary ``(key, kid)`` of the distinct keys; the integers run densely within each partition."""
    keys = refs.where("key is not null").select("key").distinct()
    return cut(keys.withColumn("kid", F.monotonically_increasing_id() + 1))


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``refs(ref, key, period, ...)`` whose ``key`` no row of ``parents(key)`` has.

    Keys become integers, each key range and period one bitmap of references, each key range one bitmap
    of parents; the bits of references AND NOT parents are decoded and lead back to the rows. Bits are set
    before the shuffle, so a key with very many rows moves as one bit per task; the joins back to the rows
    are salted for such keys. Null keys refer to nothing and are left out; repeated parents count once;
    repeated references come out as often as they went in. Empty parents make every key an orphan.
    """
    words = encode_keys(refs)
    coded = cut(salted_join(refs.where("key is not null"), words, "key", F.col("ref")))
    known = parents.where("key is not null").select("key").distinct().join(words, "key").select("kid")
    spot = [F.bitmap_bucket_number("kid").alias("range"), F.bitmap_bit_position("kid").alias("pos")]
    ref_bits = coded.select("period", *spot).groupBy("range", "period").agg(F.bitmap_construct_agg("pos").alias("bits"))
    parent_bits = known.select(*spot).groupBy("range").agg(F.bitmap_construct_agg("pos").alias("parent_bits"))
    left = (
        ref_bits.join(parent_bits, "range", "left")
        .select("range", "period", F.explode(_surviving("bits", "parent_bits")).alias("pos"))
        .select(((F.col("range") - 1) * 32768 + F.col("pos") + 1).alias("kid"), "period")
    )
    lone = left.select("kid").distinct()
    return salted_join(coded, lone, "kid", F.col("ref")).drop("kid")
