"""Seeded samples of a corpus that keep all judged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ordering import numbered

BUCKET_BITS, HASH_BITS = 16, 60


def sample_hash(id_: Column, seed: int) -> Column:
    """60 bits of the MD5 of id and seed as a number: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", id_.cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def judged_sample(corpus: DataFrame, judged: DataFrame, size: int, seed: int, id_col: str) -> DataFrame:
    """All rows with a judged id, and of the rest those of the smallest hashes of id and seed up to ``size`` rows in all.

    Counts of hash ranges tell which ranges go in whole; only the range where the sample ends is sorted.
    """
    ids = judged.select(id_col).distinct()
    required = corpus.join(ids, id_col, "left_semi")
    wanted = size - required.count()
    if wanted <= 0:
        return required
    hashed = corpus.join(ids, id_col, "left_anti").withColumn("__hash", sample_hash(F.col(id_col), seed)).withColumn("__range", F.shiftright("__hash", HASH_BITS - BUCKET_BITS))
    cut = None
    for row in hashed.groupBy("__range").count().orderBy("__range").collect():  # 2^16 rows at most
        if wanted <= row["count"]:
            cut = row["__range"]
            break
        wanted -= row["count"]
    if cut is None:
        return corpus
    last = hashed.where(F.col("__range") == cut).orderBy("__hash", id_col).limit(wanted)
    extra = hashed.where(F.col("__range") < cut).unionByName(last)
    return required.unionByName(extra.select(*corpus.columns))


def query_slice(queries: DataFrame, id_col: str, offset: int, size: int, exact: bool = False) -> DataFrame:
    """``size`` queries in id order from the ``offset``-th on, with their place; ``exact`` makes fewer an error."""
    placed = numbered(queries, id_col).where((F.col("at") >= offset) & (F.col("at") < offset + size))
    if exact:
        placed = written(placed, "slice")
        if (found := placed.count()) != size:
            raise ValueError(f"asked for {size} queries from {offset} on, found {found}")
    return placed
