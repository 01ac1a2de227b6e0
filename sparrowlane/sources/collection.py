"""Vector collections as tables: open, create, scroll, retrieve, upsert, ingest."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V
from ..operators.ordering import numbered


def open_collection(spark: SparkSession, location: str | None) -> DataFrame | None:
    """The table at a path; None for ``:memory:``; stores behind HTTP are not served by this engine."""
    if location is None:
        raise ValueError("a location is needed")
    if location == ":memory:":
        return None
    url = urlparse(location)
    if url.scheme in ("http", "https"):
        if not url.hostname:
            raise ValueError("the URL has no host name")
        raise ValueError("only tables can be opened")
    return spark.read.parquet(location)


def created(rows: DataFrame, dim: int, id_col: str, vec_col: str, quantile: float = 0.99, levels: int = 127) -> DataFrame:
    """``id, vector`` of unit length and ``code``: its levels under one scale for the whole table; wrong sizes are left out."""
    good = V.with_unit(rows.where(V.valid(F.col(vec_col), dim)), vec_col, "vector")
    scale = good.select(F.explode("vector").alias("x")).agg((F.percentile(F.abs("x"), F.lit(quantile)) / levels).alias("scale"))
    code = F.transform("vector", lambda x: F.least(F.greatest(F.rint(x / F.col("scale")), F.lit(-float(levels))), F.lit(float(levels))).cast("byte"))
    return good.crossJoin(F.broadcast(scale)).select(F.col(id_col).alias("id"), "vector", code.alias("code"), "scale")


def pages(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """Adds ``at``, ``page`` and ``next_offset`` of a full scan in id order; ids are dealt by range, so no task sees them all."""
    placed = numbered(rows, id_col)
    return placed.withColumn("page", F.floor(F.col("at") / size)).withColumn("next_offset", (F.col("page") + 1) * size)


def retrieved(rows: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """Rows of the wanted ``(place, id)``, with their places; unknown ids give none."""
    return wanted.join(rows, wanted["id"] == rows[id_col]).drop("id")


def upserted(base: DataFrame, updates: DataFrame, id_col: str, place: tuple[str, ...] = ()) -> DataFrame:
    """Updates replace rows of the same id; of several updates the last version wins (column ``version``).

    Of updates of one version the first by the columns ``place`` wins, which the result does not have; without them any may.
    """
    last = updates.withColumn("__r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.col("version").desc(), *place))).where("__r = 1").drop("__r", "version", *place)
    return base.join(last.select(id_col), id_col, "left_anti").unionByName(last)


def ingested(rows: DataFrame, dim: int, batch: int, order: str, vec_col: str) -> DataFrame:
    """Adds ``point_id, batch, accepted``: a batch with any bad vector is refused whole, and its ids are spent."""
    placed = pages(rows, order, batch).withColumn("good", V.valid(F.col(vec_col), dim))
    verdict = placed.groupBy("page").agg(F.bool_and("good").alias("accepted"))
    return placed.join(verdict, "page").withColumnsRenamed({"at": "point_id", "page": "batch"}).drop("next_offset", "good")


def streamed(rows: DataFrame, order: str, batch: int, start: int, payload: Column) -> DataFrame:
    """``point_id, batch, payload`` of an ingest in micro-batches: ids run on from ``start``, a missing payload is ``{}``.

    Nothing is checked, as vectors are made from the texts afterwards.
    """
    placed = numbered(rows, order)
    return placed.select(*rows.columns, (F.col("at") + start).alias("point_id"), F.floor(F.col("at") / batch).alias("batch"), F.coalesce(payload, F.lit("{}")).alias("payload"))


def refreshed(rows: DataFrame, text_col: str, id_col: str, vector: Column) -> DataFrame:
    """``id, vector`` of every row through ``vector``, a column made from its text; a row without text is an error."""
    text = F.when(F.col(text_col).isNull(), F.raise_error(F.concat(F.lit("no text for id "), F.col(id_col).cast("string")))).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(F.col(id_col).alias("id"), vector.alias("vector"))


def quantized(rows: DataFrame, levels: int = 127, quantile: float = 0.99) -> DataFrame:
    """Adds ``levels``: each component in steps of a symmetric scale, ``levels`` of them up to the quantile of all magnitudes."""
    scale = rows.select(F.explode("vector").alias("x")).agg((F.percentile(F.abs("x"), F.lit(quantile)) / levels).alias("scale"))
    step = lambda x: F.when(F.col("scale") > 0, F.least(F.greatest(F.rint(x / F.col("scale")), F.lit(-float(levels))), F.lit(float(levels)))).otherwise(0.0)
    return rows.crossJoin(F.broadcast(scale)).withColumn("levels", F.transform("vector", step))


def embedded(rows: DataFrame, text_col: str, lengths: tuple[int, ...], accepts: Callable[[Column], Column], embed: Callable[[Column], Column], dim: int) -> DataFrame:
    """Adds ``sent`` and ``vector``: the text at the first of the ``lengths`` that the server accepts, and what it makes of it.

    A text that is refused at every length, or is null, is sent as null and has a zero vector.
    """
    cut = [F.substring(text_col, 1, n) for n in lengths]
    sent = F.coalesce(*(F.when(accepts(c), c) for c in cut))
    zero = F.array(*(F.lit(0.0) for _ in range(dim)))
    return rows.withColumn("sent", sent).withColumn("vector", F.when(F.col("sent").isNull(), zero).otherwise(embed(F.col("sent"))))


def routed(rows: DataFrame, teachers: DataFrame, lang_col: str, default: tuple[str, int, float]) -> DataFrame:
    """Adds ``teacher, dim, shift`` by language; teachers of different dimensions in use are an error."""
    name, dim, shift = default
    out = rows.join(F.broadcast(teachers), lang_col, "left").select(*rows.columns, F.coalesce("teacher", F.lit(name)).alias("teacher"), F.coalesce("dim", F.lit(dim)).alias("dim"), F.coalesce("shift", F.lit(shift)).alias("shift"))
    dims = sorted(r["dim"] for r in out.select("dim").distinct().collect())  # one for each teacher at most
    if len(dims) > 1:
        raise ValueError(f"teachers of dimensions {dims} cannot be mixed")
    return out


def dataset(docs: DataFrame, queries: DataFrame, judgements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (text with title), queries, qrels: ids of any spelling to strings; a judgement without grade counts 1."""
    first = lambda df, *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in df.columns))
    title = F.coalesce(F.col("title"), F.lit("")) if "title" in docs.columns else F.lit("")
    corpus = docs.select(first(docs, "_id", "id", "doc_id").alias("doc_id"), F.concat(F.col("text"), F.lit(" "), title).alias("text"))
    asked = queries.select(first(queries, "_id", "id", "item_id", "query_id").alias("query_id"), "text")
    grade = F.coalesce(F.col("score").cast("double"), F.lit(1.0)) if "score" in judgements.columns else F.lit(1.0)
    return corpus, asked, judgements.select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), grade.alias("score"))
