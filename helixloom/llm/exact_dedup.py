"""Exact deduplication through an extendible-hash index on shared files, in DataFrame functions alone.

1. *Entries*: each text is normalised and hashed; (id, length, hash, digest) go to Parquet files in the
   shared folder. Repeated rows are counted, not repeated.
2. *Directory*: it starts with one bucket and doubles, up to 2**max_depth slots: the slot of a hash is its
   leading bits, and a bucket's local depth is the least at which it holds bucket_keys distinct hashes at most.
3. *Comparison*: texts are grouped by bucket, hash and the whole normalised text, so rows are equal only
   when all bytes are. Each input task combines its own copies first; a group of copies of any size arrives
   as a row per task.
4. *Chains*: the task that owns a bucket (a range of hash values) numbers the different texts of one hash.
5. Entries meet the index by (hash, digest); large groups are on the streamed side, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, stored

BUCKET_KEYS = 50_000
MAX_DEPTH = 14
_HALF = "9223372036854775808"  # 2**63
_STEP = "36893488147419103232"  # 2**65


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def directory(hashes: DataFrame, bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(slot, bucket, local_depth): a row per used slot of the doubled directory, 2**max_depth at most.

    hashes has distinct values in column h. A bucket is named by its first slot.
    """
    slots = hashes.groupBy(F.shiftrightunsigned("h", 64 - max_depth).cast("int").alias("slot")).agg(F.count("*").alias("keys"))
    levels = slots.select("slot", "keys", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    levels = levels.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {max_depth} - depth), {max_depth} - depth)"))
    full = levels.groupBy("depth", "bucket").agg(F.sum("keys").alias("held"))
    fits = (F.col("held") <= bucket_keys) | (F.col("depth") == max_depth)
    local = levels.join(full.where(fits), ["depth", "bucket"]).groupBy("slot").agg(F.min("depth").alias("local_depth"))
    return local.select("slot", F.expr(f"shiftleft(shiftright(slot, {max_depth} - local_depth), {max_depth} - local_depth)").alias("bucket"), "local_depth")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, chain): one row per row of docs.

    Texts are equal when identical without ASCII white space; a null text is an empty one. Of equal texts the
    longest original (in code points) stays, then the smallest id; a null id loses to any other. Of repeated
    rows (same id and text) one is kept. chain counts from 0 the different texts under one 64-bit hash. An
    empty table gives no rows; other columns are not read.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).alias("cp"), normalised(text).alias("norm"))
    rows = rows.withColumns({"h": F.xxhash64("norm"), "sha": F.sha2("norm", 256)})
    entries = stored(rows.groupBy("doc_id", "cp", "h", "sha").agg(F.count("*").alias("copies")), "exact-entries")

    slots = directory(entries.select("h").distinct(), bucket_keys, max_depth)
    # Of decimals the greatest wins: length first, then 2**63 - id; a null id adds nothing.
    best = F.col("cp").cast("decimal(10,0)") * F.expr(f"cast({_STEP} as decimal(20,0))") + F.coalesce(F.expr(f"cast({_HALF} as decimal(20,0))") - F.col("doc_id").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    owned = rows.withColumn("slot", F.shiftrightunsigned("h", 64 - max_depth).cast("int")).join(F.broadcast(slots), "slot", "left")  # 2**max_depth rows at most
    index = owned.groupBy("bucket", "h", "norm").agg(F.count("*").alias("group_size"), F.max(best.cast("decimal(38,0)")).alias("best"), F.max("sha").alias("sha"))
    index = index.select("bucket", "h", "sha", "group_size", "best").repartition("bucket")
    index = index.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("sha")) - 1)
    rest = F.expr(f"best % cast({_STEP} as decimal(20,0))")
    index = index.select("h", "sha", "group_size", "chain", F.when(rest > 0, (F.expr(f"cast({_HALF} as decimal(20,0))") - rest).cast("long")).alias("keep_id"), F.expr(f"cast(best div cast({_STEP} as decimal(20,0)) as int)").alias("keep_cp"))

    found = entries.join(index, ["h", "sha"])
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("cp") == F.col("keep_cp")) & (F.col("copy") == 1)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), "chain")
