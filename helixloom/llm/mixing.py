"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions alone.

Targets share the whole corpus by weight; none passes max_repeat times its source's size, and the excess goes
to the rest by weight. The corpus is cut into blocks of block_words words, and blocks are seats: the highest
quotients target / (2k - 1) win them. A source's blocks are then apportioned in the same way to its shards
(documents dealt by a seeded hash, about shard_words words each; first to groups of FANOUT shards, so that no
window holds more than FANOUT shards or the groups of one source). In a shard, documents lie end to end in
seeded order; full rounds take every word once, and what is left of the quota takes the shard's blocks in
seeded order. No step depends on file or partition layout, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

BLOCK_WORDS = 64
SHARD_WORDS = 16_384
FANOUT = 1024


def _everything():
    return Window.partitionBy()



def targets(sources: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: float = 3) -> DataFrame:
    """sources (source, source_size) with weight and target added.

    Sources in order of code points, null last, take the weights in turn. With sources sorted by cap / weight,
    the level of the first m + 1 when m are capped is (total - caps) / rest of the weights; it rises while
    sources are capped and falls after, so its maximum is the level at which the resharing ends.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(_everything()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(_everything()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(_everything()))
    return ranked.select("source", "source_size", "rank", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def apportion(items: DataFrame, groups: Sequence[str], order: Sequence[str | Column], votes: str, seats: str, out: str) -> DataFrame:
    """items with integer column `out`: Sainte-Laguë seats by votes, `seats` of them for each group.

    The seats that an item has at the divisor for (seats - n / 2), n items, are safe; those beyond the divisor for
    (seats + n / 2) are out of reach. Only quotients between, about two for each item, are ranked; ties go by
    `order`, which must tell a group's items apart.
    """
    per = Window.partitionBy(*groups)
    total, n, wanted = F.sum(votes).over(per), F.count("*").over(per), F.col(seats)
    low = F.when((wanted * 2 > n) & (total > 0), F.floor(F.col(votes) * (wanted - n / 2) / total + 0.5 - 1e-9)).otherwise(0)
    high = F.when((F.col(votes) > 0) & (total > 0), F.ceil(F.col(votes) * (wanted + n / 2) / total + 0.5)).otherwise(0)
    ranged = items.withColumns({"_low": F.greatest(low, F.lit(0)).cast("long"), "_high": high.cast("long")})
    ranged = ranged.withColumn("_open", wanted - F.sum("_low").over(per))
    seat = F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high"))))
    ranged = ranged.select("*", seat.alias("_k")).withColumn("_quotient", F.col(votes) / (2 * F.col("_k") - 1))
    by = Window.partitionBy(*groups).orderBy(F.col("_quotient").desc_nulls_last(), *order)
    won = F.col("_k").isNotNull() & (F.row_number().over(by) <= F.col("_open"))
    kept = [c for c in items.columns]
    ranged = ranged.withColumn("_won", won.cast("long"))
    return ranged.groupBy(*kept, "_low").agg(F.sum("_won").alias("_more")).select(*kept, (F.col("_low") + F.col("_more")).alias(out))


def mix(units: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: int = 3, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for units (doc_id, source, size).

    taken is how many words of the document the mix takes, repeats counted, 0 to max_repeat * size. Repeated rows
    are rows of their own. A null size is 0, a null source is a source; an empty table gives no rows.
    """
    whole = units.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    whole = stored(whole.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "mix-units")
    sources = whole.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    planned = targets(sources, weights, max_repeat).withColumn("_all", F.greatest(F.round(F.sum("source_size").over(_everything()) / block_words), F.lit(1)).cast("long"))
    planned = apportion(planned, [], ["rank"], "target", "_all", "blocks")
    planned = stored(planned.select(F.col("source").alias("_source"), "rank", "source_size", "target", "blocks", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long").alias("shards")), "mix-sources")

    # Copies of one row go to shards in lots, so that a row repeated very often fills no single shard.
    lot = F.greatest(F.floor(F.lit(shard_words) / F.greatest("size", F.lit(1))), F.lit(1)).cast("long")
    lots = whole.withColumn("_lot", lot).withColumn("_n", F.explode(F.expr("sequence(0L, (copies - 1) div _lot)")))
    lots = lots.withColumn("copies", F.least(F.col("_lot"), F.col("copies") - F.col("_n") * F.col("_lot")))
    placed = lots.join(planned, F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "_n"), F.col("shards")))
    shards = placed.groupBy("rank", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.first("blocks").alias("blocks"))
    shards = shards.withColumn("group", F.expr(f"shard div {FANOUT}"))
    grouped = shards.groupBy("rank", "group").agg(F.sum("words").cast("double").alias("votes"), F.first("blocks").alias("blocks"))
    grouped = apportion(grouped, ["rank"], ["group"], "votes", "blocks", "quota").select("rank", "group", "quota")
    quotas = shards.drop("blocks").join(grouped, ["rank", "group"]).withColumn("votes", F.col("words").cast("double"))
    quotas = apportion(quotas, ["rank", "group"], ["shard"], "votes", "quota", "blocks")

    # In a shard: rounds takes of everything, then `left` words from its blocks in seeded order.
    quotas = quotas.withColumn("_wanted", F.least(F.col("blocks") * block_words, F.col("words") * max_repeat))
    quotas = quotas.withColumns({"rounds": F.expr("if(words > 0, _wanted div words, 0L)"), "left": F.expr("if(words > 0, _wanted % words, 0L)"), "_last": F.expr(f"cast(greatest(0L, (words - 1) div {block_words}) as int)")})
    seeded = f"array_sort(transform(sequence(0, _last), j -> named_struct('h', xxhash64({seed}, rank, shard, j), 'j', j)))"
    quotas = quotas.withColumn("_order", F.expr(f"transform({seeded}, x -> x.j)"))
    # The last block may be short; those after it in seeded order begin as much earlier.
    quotas = quotas.withColumns({"_short": F.expr(f"(_last + 1L) * {block_words} - words"), "_at": F.expr("array_position(_order, _last) - 1")})
    took = f"""transform(_order, (j, p) -> named_struct('j', j, 't', least(
        {block_words}L - if(j = _last, _short, 0L), greatest(0L, left - (p * {block_words}L - if(p > _at, _short, 0L))))))"""
    quotas = quotas.withColumn("takes", F.expr(f"transform(array_sort({took}), x -> x.t)"))
    quotas = quotas.select(F.col("rank").alias("_rank"), F.col("shard").alias("_shard"), "rounds", "takes")

    line = Window.partitionBy("rank", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "_n"), "doc_id", "size", "_n")
    laid = placed.withColumn("_end", F.sum(F.col("size") * F.col("copies")).over(line)).withColumn("_from", F.col("_end") - F.col("size") * F.col("copies"))
    laid = laid.join(quotas, (F.col("rank") == F.col("_rank")) & (F.col("shard") == F.col("_shard")))
    laid = laid.withColumn("_copy", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("_from", F.col("_from") + F.col("_copy") * F.col("size"))
    part = f"greatest(0L, least(_from + size, j * {block_words}L + takes[j]) - greatest(_from, j * {block_words}L))"
    taken = f"if(size = 0, 0L, rounds * size + aggregate(sequence(cast(_from div {block_words} as int), cast((_from + size - 1) div {block_words} as int)), 0L, (a, j) -> a + {part}))"
    return laid.select("doc_id", "source", "size", "source_size", "target", F.expr(taken).alias("taken"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Units of documents: the size is the number of words of the whole text."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes words of, with mix_taken (words) and mix_rounds (taken / size, up).

    Rows that share id, source and size share what the mix takes of them evenly, rounded down.
    """
    columns = docs.columns
    units = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("source").alias("_src"), word_count(F.col("text")).alias("_size"))
    chosen = mix(sized(docs), **options).groupBy("doc_id", "source", "size").agg(F.expr("cast(sum(taken) div count(*) as long)").alias("_taken")).where("_taken > 0")
    joined = units.join(chosen, F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_src").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size")))
    return joined.select(*[F.col("_row")[c].alias(c) for c in columns], F.col("_taken").alias("mix_taken"), F.ceil(F.col("_taken") / F.col("_size")).cast("int").alias("mix_rounds"))
