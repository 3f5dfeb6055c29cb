"""How the operators split their input into tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscope.operators.joins import join_per_key
from varscope.session import materialize

# Text that a group of documents or windows holds, so that one task can keep it in memory.
GROUP_BYTES = 4 << 20


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def groups_for(total: int, group_bytes: int = GROUP_BYTES) -> int:
    return max(1, -(-total // group_bytes))


def group_count(docs: DataFrame, text: str = "text", group_bytes: int = GROUP_BYTES) -> int:
    """Groups needed for ``group_bytes`` of text each. Reads the text column once."""
    return groups_for(total_bytes(docs, text), group_bytes)


def group_of(groups: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(groups)).cast("int")


def text_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id bigint, text string) of the documents, whatever other columns they have."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))


def folded(rows: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``doc_id, text, copies``: rows whose copies hold more than ``group_bytes`` come once.

    Only keys travel to find them; there are at most as many as groups, so they are
    broadcast, if counted to be few, or joined. 64 bytes count for a row of its own, so
    that empty texts are folded as well.
    """
    keyed = rows.withColumn("_key", F.xxhash64("doc_id", "text"))
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)
    heavy = keyed.groupBy("_key").agg(F.count("*").alias("n"), size.alias("size"))
    heavy = materialize(heavy.where((F.col("n") > 1) & (F.col("size") > group_bytes)).select("_key", F.lit(True).alias("_often")))
    once = F.lit(1).cast("bigint").alias("copies")
    if heavy.isEmpty():
        return rows.select("*", once)
    told = join_per_key(keyed, heavy, ["_key"], ["doc_id", "text"]).drop("_key")
    often = told.where("_often").groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    return told.where("_often is null").select("doc_id", "text", once).unionByName(often)


def unfolded(rows: DataFrame) -> DataFrame:
    """Each row ``copies`` times, without that column."""
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))
    return rows.withColumn("_copy", again).drop("_copy", "copies")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, row``: all other columns travel as a struct, so that no name can clash."""
    others = [F.col(quoted(c)) for c in docs.columns if c != text]
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.struct(*others).alias("row"),
    )


def restored(
    rows: DataFrame, docs: DataFrame, changed: Column | None = None, text: str = "text", chars: str = "n_chars"
) -> DataFrame:
    """The columns of ``docs`` from ``text`` and ``row``; where ``changed``, ``chars`` counts the text again."""

    def column(name: str) -> Column:
        if name == text:
            return F.col("text").cast(docs.schema[name].dataType).alias(name)
        value = F.col("row").getField(name)
        if name == chars and changed is not None:
            value = F.when(changed, F.char_length("text")).otherwise(value).cast(docs.schema[name].dataType)
        return value.alias(name)

    return rows.select(*(column(name) for name in docs.columns))
