"""Mixing sources to target weights by Sainte-Lague apportionment (operator 2), with DataFrame functions only.

Sources, in code point order with null last, weigh `weights` in turn and share 100 % of all words; a target stops at
`most_repeats` times its source's words, and what is above is shared again by weight until none is above. The mix is dealt
in blocks of equally many words: Sainte-Lague (the highest quotients target / (2k - 1)) gives every source its number of
blocks, and again every shard of a source, by the shard's words. A shard is a line of documents in a seeded order; it
gives whole passes over the line and then the blocks that follow, around its end, from a seeded block on. A document's
taken words are what of it these cover, so no document gives more than `most_repeats` times its size.

Shards are fine hash buckets of about SHARD_DOCS documents of the whole table, merged by powers of two where a source is
small, so no key holds more than a bounded share even if one source holds most rows. Texts are read once.

A null or blank text has size 0 and takes 0; a very long one is counted whole. A null source is a source of its own. Equal
quotients go to the smaller key. Null and repeated doc_ids are rows of their own; exact repeats of a row are counted first
and stand one after the other on the line, so that a row that is there very often is one place of it. An empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphspark.operators.ranking import global_rank
from graphspark.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Words of a block at most; small corpora use smaller ones, so that a source has BLOCKS_PER_SOURCE of them on average.
BLOCK_WORDS = 16
BLOCKS_PER_SOURCE = 4_096
SHARD_DOCS = 512
#: A source gets another shard for so many blocks or documents.
SHARD_BLOCKS = 1_024
SEED = 42
#: Exact repeats of a row that one task deals out at most.
REPEATS = 4_096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """`sources` (weight, source_size) with target: the level that fills all of the words, found by the rounds of resharing.

    Each round is one aggregate over the sources; a source once at its cap stays there, as the level only rises.
    """
    cap = F.col("source_size") * most_repeats
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, last = 0.0, -1.0
    capped = F.lit(False)
    while level != last:
        last = level
        row = sources.agg(F.sum(F.when(capped, cap).otherwise(0)).alias("full"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        level = (total - row["full"]) / row["open"]
        capped = F.col("weight") * F.lit(level) >= cap
    return sources.withColumn("target", F.when(capped, cap.cast("double")).otherwise(F.col("weight") * F.lit(level)))


def sainte_lague(rows: DataFrame, group: list[str], key: list[str], share: str, seats: str, quota: str) -> DataFrame:
    """`rows` with the seats that each gets of its group's `seats`, in proportion to `share`; ties go to the smaller key.

    With n rows in a group, dividing by (group's share) / (seats - n/2) and rounding gives no more than all seats, and by
    / (seats + n/2) no fewer. So all but the quotients between the two are settled, and those are about two a row at most.
    They are ranked over all groups at once by ranges, never in one task.
    """
    whole = rows.groupBy(*group).agg(F.sum(share).alias("__all"), F.count("*").alias("__n"))
    part = rows.join(whole, group)

    def rounded(halves: int) -> Column:
        blocks = F.greatest(F.col(seats) + halves * F.col("__n") / 2, F.lit(0.0))
        return F.when(F.col("__all") > 0, F.floor(F.col(share) * blocks / F.col("__all") + 0.5)).otherwise(0).cast("long")

    part = cut(part.withColumn("__low", rounded(-1)).withColumn("__high", rounded(1)))
    step = F.explode(F.sequence(F.col("__low") + 1, F.col("__high"))).alias("__seat")
    open_seats = part.where(F.col("__high") > F.col("__low")).select(*group, *key, share, step).withColumn("__quotient", F.col(share) / (2 * F.col("__seat") - 1))
    ranked = global_rank(open_seats, [*(F.col(g) for g in group), F.desc("__quotient"), *(F.col(k) for k in key), F.col("__seat")], "__rank")
    first = ranked.groupBy(*group).agg(F.min("__rank").alias("__first"))
    given = part.groupBy(*group).agg((F.max(seats) - F.sum("__low")).alias("__left"))
    won = ranked.join(first, group).join(given, group).where(F.col("__rank") - F.col("__first") < F.col("__left")).groupBy(*group, *key).agg(F.count("*").alias("__won"))
    return part.join(won, [*group, *key], "left").withColumn(quota, F.col("__low") + F.coalesce("__won", F.lit(0))).drop("__all", "__n", "__low", "__high", "__won")


def _pow2_floor(c: Column) -> Column:
    return F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(c, F.lit(1.0))))).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, taken and row_hash (of doc_id, source and text) of every row of docs."""
    slim = cut(
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), "source", size_of(docs["text"]).alias("size"), F.xxhash64(F.lit(seed), docs["doc_id"].cast("long"), "source", "text").alias("row_hash"))
        .groupBy("doc_id", "source", "size", "row_hash")
        .agg(F.count("*").alias("copies"))
        .withColumn("words", F.col("size") * F.col("copies"))
        .withColumn("src", F.coalesce("source", F.lit("")))
        .withColumn("none", F.col("source").isNull())
    )
    everything = slim.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    fine = 1
    while fine * SHARD_DOCS < everything["rows"]:
        fine *= 2
    slim = slim.withColumn("fine", F.pmod(F.col("row_hash"), F.lit(fine)))
    by_fine = cut(slim.groupBy("none", "src", "fine").agg(F.sum("words").alias("words"), F.sum("copies").alias("rows")))
    by_source = by_fine.groupBy("none", "src").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("source_rows"))
    ranked = global_rank(by_source, [F.col("none"), F.col("src")], "place")
    turn = F.array(*map(F.lit, weights))
    sources = cut(targets(cut(ranked.withColumn("weight", turn[((F.col("place") - 1) % len(weights)).cast("int")])), most_repeats))
    count = sources.count()
    block = max(1, min(BLOCK_WORDS, everything["words"] // max(1, BLOCKS_PER_SOURCE * count)))
    sources = sainte_lague(sources.withColumn("all", F.lit(0)).withColumn("seats", F.lit(round(everything["words"] / block)).cast("long")), ["all"], ["place"], "target", "seats", "blocks")
    sources = cut(sources.withColumn("ways", F.least(F.lit(fine).cast("long"), _pow2_floor(F.greatest(F.col("source_size") / (SHARD_BLOCKS * block), F.col("source_rows") / (8.0 * SHARD_DOCS))))).drop("all", "seats"))
    fine_rows = by_fine.join(sources, ["none", "src"]).withColumn("shard", F.pmod("fine", "ways"))
    before = Window.partitionBy("none", "src", "shard").orderBy("fine")  # at most about 16 x SHARD_DOCS documents, or their share of SHARD_BLOCKS
    fine_rows = fine_rows.withColumn("fine_start", F.sum("words").over(before) - F.col("words"))
    shards = fine_rows.groupBy("place", "shard").agg(F.sum("words").alias("shard_words"), F.max("blocks").alias("blocks"))
    shards = sainte_lague(shards, ["place"], ["shard"], "shard_words", "blocks", "quota")
    words = F.least(F.col("quota") * block, F.col("shard_words") * most_repeats)
    start = F.pmod(F.xxhash64(F.lit(seed), "place", "shard"), F.ceil(F.greatest(F.col("shard_words"), F.lit(1)) / block)) * block
    drawn = shards.select("place", "shard", "shard_words", words.alias("due"), start.cast("long").alias("from"))
    plan = fine_rows.select("none", "src", "fine", "place", "shard", "fine_start", "source_size", "target").join(drawn, ["place", "shard"])
    line = Window.partitionBy("none", "src", "fine").orderBy("row_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = slim.join(plan, ["none", "src", "fine"]).withColumn("first", F.col("fine_start") + F.sum("words").over(line) - F.col("words"))
    row = _repeated(row).withColumn("a", F.col("first") + F.col("copy") * F.col("size")).withColumn("b", F.col("a") + F.col("size"))
    passes = F.when(F.col("shard_words") > 0, F.floor(F.col("due") / F.greatest("shard_words", F.lit(1)))).otherwise(0).cast("long")
    row = row.withColumn("passes", passes).withColumn("to", F.col("from") + F.col("due") - F.col("passes") * F.col("shard_words"))

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.least(F.col("b"), hi) - F.greatest(F.col("a"), lo), F.lit(0))

    rest = overlap(F.col("from"), F.least("to", "shard_words")) + overlap(F.lit(0), F.col("to") - F.col("shard_words"))
    taken = F.col("passes") * F.col("size") + rest
    return row.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), "row_hash")


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row `copies` times with `copy` from 0 on; rows that repeat often are dealt to several tasks."""
    rows = cut(rows)
    few = rows.where(F.col("copies") <= REPEATS).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    many = rows.where(F.col("copies") > REPEATS).withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(REPEATS).cast("long"))))
    many = many.repartition("row_hash", "__from").withColumn("copy", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + REPEATS, F.col("copies")) - 1)))
    return few.unionByName(many.drop("__from"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it, rounded to whole documents: a decision that takes effect.

    Rows are found again by (doc_id, row_hash); exact repeats of a row share its takings.
    """
    plan = mix(docs, **how).groupBy("doc_id", "row_hash").agg(F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("__n"))
    keyed = docs.withColumn("__h", F.xxhash64(F.lit(how.get("seed", SEED)), docs["doc_id"].cast("long"), "source", "text"))
    plan = plan.where(F.col("__n") > 0).select(F.col("doc_id").alias("__d"), F.col("row_hash").alias("__r"), "__n")
    joined = keyed.join(plan, (F.col("__h") == F.col("__r")) & keyed["doc_id"].cast("long").eqNullSafe(F.col("__d")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)
