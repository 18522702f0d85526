"""Bounded labelled samples for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def sample_order() -> list:
    return [F.xxhash64("__id"), F.col("__id")]



def held_out(id_col: str = "doc_id", parts: int = 5, rest: int = 0):
    """Whether crc32(id as text) mod ``parts`` is ``rest``; true for a null id, which is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == rest, F.lit(True))


def usable(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(__id, __y) of every labelled row that is not held out, one row per id."""
    return (labels.filter(F.col(label).isin(0, 1)).filter(~held_out(id_col))
            .select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y")).groupBy("__id").agg(F.max("__y").alias("__y")))


def sample_frame(docs: DataFrame, own: DataFrame, per_class: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> tuple:
    """(rows, ids): at most ``per_class`` (__id, __text, __y) rows of either class of ``own``, chosen by a hash of the id, of texts of at most
    ``max_bytes``, and their (__id, __y) alone; (None, None) if there is no such row.

    Ids are picked among those of short enough documents, so long or missing ones use up no place.  They are picked before texts are
    fetched, so only a table of at most 2 * per_class ids is broadcast and no text is moved to find them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    short = docs.select(F.col(id_col).alias("__id"), text.alias("__text")).filter(F.octet_length("__text") <= max_bytes)
    found = own.join(short.select("__id"), "__id", "left_semi")
    classes = [found.filter(F.col("__y") == y).orderBy(*sample_order()).limit(per_class) for y in (0, 1)]
    picked = classes[0].union(classes[1]).collect()
    if not picked:
        return None, None
    ids = docs.sparkSession.createDataFrame(picked, own.schema)
    return short.join(F.broadcast(ids), "__id").select("__id", "__text", "__y"), ids


def sample_texts(docs: DataFrame, own: DataFrame, per_class: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> list:
    """The rows of ``sample_frame`` in a fixed order."""
    rows, _ = sample_frame(docs, own, per_class, max_bytes, id_col, text_col)
    return [] if rows is None else [tuple(r) for r in rows.orderBy(*sample_order()).collect()]


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int, id_col: str = "doc_id",
                   text_col: str = "text") -> list:
    """``sample_texts`` of all usable labels, as (text, 0/1)."""
    return [r[1:] for r in sample_texts(docs, usable(labels, label, id_col), per_class, max_bytes, id_col, text_col)]
