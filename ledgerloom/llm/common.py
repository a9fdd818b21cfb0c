"""Shared helpers: tables, stored intermediates, checked broadcasts, text columns."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# rows of two or three numbers that a side may have to be broadcast (about 50 MB)
BROADCAST_ROWS = 1_000_000

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

# fixed patterns of the contracts
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACE_GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that tasks hand to Python, unless the session has a bound."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(4 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, on one machine a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = spark.sparkContext._conf.get("spark.ledgerloom.tmp", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext._conf.set("spark.ledgerloom.tmp", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The copy cuts the lineage: executors lost later cost no recomputation of what led to it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``text_key``; rows equal in all three have equal results.

    ``doc_id`` alone need not be unique or present. Other columns are left behind, so their
    names cannot clash with those an operator makes.
    """
    return docs.select("doc_id", "text", text_hash().alias("text_key"))


def with_row(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``row``, a struct of all columns: their names cannot clash with others.

    ``select("row.*")`` gives the documents back.
    """
    return docs.select("doc_id", "text", F.struct(*[docs[f"`{name}`"] for name in docs.columns]).alias("row"))


def same_key(left: DataFrame, right: DataFrame, names: tuple[str, ...] = ("doc_id", "text_key")) -> Column:
    """Null-safe equality of the key columns."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def join_keyed(left: DataFrame, right: DataFrame, how: str = "left", small: bool = False) -> DataFrame:
    """Join on (``doc_id``, ``text_key``), nulls matching, keeping the left side's key columns."""
    renamed = right.withColumnsRenamed({"doc_id": "__doc_id", "text_key": "__text_key"})
    side = F.broadcast(renamed) if small else renamed
    condition = left["doc_id"].eqNullSafe(F.col("__doc_id")) & left["text_key"].eqNullSafe(F.col("__text_key"))
    return left.join(side, condition, how).drop("__doc_id", "__text_key")


def only(rows: DataFrame, keys: DataFrame, count: int | None = None, anti: bool = False) -> DataFrame:
    """The rows whose key is (or is not) in ``keys``.

    The keys are broadcast while they are few (``BROADCAST_ROWS``); beyond that both sides are
    shuffled.
    """
    wanted = keys.select("doc_id", "text_key").distinct()
    if count is None:
        count = keys.count()
    return join_keyed(rows, wanted, "left_anti" if anti else "left_semi", small=count <= BROADCAST_ROWS)


def lowered(text: Column) -> Column:
    """A-Z to a-z, nothing else. An ASCII text takes the quick way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def alnum_words(text: Column) -> Column:
    """Words of letters, digits and all non-ASCII characters, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), ALNUM_GAP), "")


def n_alnum_words(text: Column) -> Column:
    """How many there are, without lower-casing."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), ALNUM_GAP_ANY_CASE), ""))


def space_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_GAP))


def positions(n: Column) -> Column:
    """0 to n - 1; empty for n < 1."""
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))
    )


def is_held_out(modulus: int, remainder: int) -> Column:
    """By the contract's rule: crc32 of the id as text. A null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % modulus == remainder


def bounded_sample(rows: DataFrame, group: str, key: Column, most: int, classes: int) -> DataFrame:
    """At most ``most`` rows of each group, drawn by the hash of ``key``; repeatable.

    Each of ``classes`` hash classes gives an equal part at most, so a group of any size is
    ordered in as many tasks, and rows of one key fill no more than their class.
    """
    order = Window.partitionBy(group, "__class").orderBy("__order")
    drawn = rows.withColumn("__order", F.xxhash64(key, F.lit(1))).withColumn("__class", F.pmod("__order", F.lit(classes)))
    chosen = drawn.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= most // classes)
    return chosen.drop("__order", "__class", "__at")
