"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are dealt in blocks of ``BLOCK`` words. All blocks of the mix go to sources by
highest quotients target / (2 k + 1), a source's blocks to its shards in the same
way, by their words. What whole blocks leave of a source's target, and what a shard that is
taken twice can't hold, goes to shards with room, by their room. Within a shard documents form one stream in a seeded order, cut
into blocks across document borders; a shard's quota takes whole passes over the
stream, then blocks in a seeded order, the last one in part. A shard holds a bounded
number of words and of rows, whatever its source holds. Sources and shards are apportioned
as tables: a divisor's bounds settle all seats but about one a row, a histogram of the
quotients left finds the last ones, and only those of its last bin are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BLOCK = 64
SHARD_WORDS = 1 << 18
SHARD_ROWS = 2000
SHARE = 1.5
MOST = 2
WEIGHTS = (5, 2, 1)
#: Sources up to which their table is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 50_000
#: Bins of the histogram of quotients, and shards whose sums are taken together.
BINS = 4096
PIECE = 1024


def ranked(df: DataFrame, *order) -> DataFrame:
    """Adds ``i``, the place of each row in an order, without a window over all rows."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("__m"))
    rows = common.materialise(rows, "ranked").withColumn("__part", F.shiftright("__m", 33))
    parts = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each task
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__m").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(parts), "__part").withColumn("i", F.col("__before") + inside).drop("__m", "__part", "__before")


def fill(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (words, weight) rows: they share ``share`` of all words by weight;
    those above ``most`` times their words stop there and the excess is shared again by
    weight, until none is above. A round is one sum over the rows."""
    total, weights = sources.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, capped = share * total, -1
    while True:
        over = F.lit(left) * F.col("weight") / F.lit(float(weights or 1)) > most * F.col("words")
        full, rest, n = sources.agg(F.sum(F.when(over, most * F.col("words")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.sum(F.when(over, 1).otherwise(0))).first()
        if n is None or n == capped or not rest:
            break
        left, weights, capped = share * total - full, rest, n
    return sources.withColumn("target", F.when(over, (most * F.col("words")).cast("double")).otherwise(F.lit(left) * F.col("weight") / F.lit(float(weights or 1))))


def apportion(rows: DataFrame, group: str, key: str, weight: str, seats: str) -> DataFrame:
    """Adds ``q``: the ``seats`` of each group, equal in all its rows, go one by one to the
    highest quotient weight / (2 q + 1); ties to the smallest key. Rows without weight get
    none; nor does a group without any weight."""
    w, s = F.col(weight).cast("double"), F.col(seats).cast("double")
    sums = rows.groupBy(group).agg(F.sum(F.when(w > 0, w).otherwise(0)).alias("__w"), F.sum(F.when(w > 0, 1).otherwise(0)).alias("__n"), F.max(w).alias("__top"))
    bound = rows.join(common.broadcast_if_small(sums, BROADCAST_SOURCES), group)
    # floor(w / d + 1/2) seats for a divisor d are all within n / 2 of W / d
    low = F.try_divide(F.col("__w"), s + F.col("__n") / 2)
    high = F.when(s > F.col("__n") / 2, F.try_divide(F.col("__w"), s - F.col("__n") / 2))
    real = (w > 0) & (s > 0)
    sure = F.when(real & high.isNotNull(), F.greatest(F.lit(0), F.floor(F.try_divide(w, high) + 0.5 - 1e-9))).otherwise(0).cast("long")
    until = F.when(real, F.floor(F.try_divide(w, low) + 0.5 + 1e-9)).otherwise(0).cast("long")
    bound = bound.withColumn("__low", low / 2).withColumn("__span", F.coalesce(high / 2, F.col("__top")) - F.col("__low")).withColumn("__sure", sure).withColumn("__until", F.greatest(sure, until))
    bound = common.materialise(bound, "bounds")
    need = bound.groupBy(group).agg((F.max(seats) - F.sum("__sure")).alias("__need"))
    some = bound.filter("__until > __sure").select(group, key, "__low", "__span", F.col(weight).cast("double").alias("__w1"), F.explode(F.sequence("__sure", F.col("__until") - 1)).alias("__k"))
    some = some.withColumn("__quotient", F.col("__w1") / (2 * F.col("__k") + 1))
    bin_ = F.when(F.col("__span") > 0, F.floor((F.col("__quotient") - F.col("__low")) / F.col("__span") * BINS)).otherwise(0)
    some = some.withColumn("__bin", F.greatest(F.lit(0), F.least(F.lit(BINS), bin_)).cast("int"))
    bins = some.groupBy(group, "__bin").agg(F.count("*").alias("__c"))
    above = Window.partitionBy(group).orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1)  # BINS + 1 rows at most
    bins = bins.withColumn("__above", F.coalesce(F.sum("__c").over(above), F.lit(0))).join(need, group)
    bins = bins.select(group, "__bin", F.least(F.col("__need") - F.col("__above"), F.col("__c")).alias("__take"), "__c").filter("__take > 0")
    taken = some.join(bins, [group, "__bin"])
    rank = F.row_number().over(Window.partitionBy(group, "__bin").orderBy(F.desc("__quotient"), key, "__k"))
    last = taken.filter("__take < __c").withColumn("__rank", rank).filter("__rank <= __take").select(group, key)
    extra = taken.filter("__take = __c").select(group, key).unionByName(last).groupBy(group, key).agg(F.count("*").alias("__extra"))
    return bound.join(extra, [group, key], "left").withColumn("q", F.col("__sure") + F.coalesce("__extra", F.lit(0))).drop(*[c for c in bound.columns if c.startswith("__")], "__extra")


def plan(sizes: DataFrame) -> DataFrame:
    """(sid, source, words, target, blocks, shards) of each source; sid is its place in code
    point order, null last."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    found = ranked(found, F.col("source").isNull(), F.col("source")).withColumnRenamed("i", "sid")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    found = common.materialise(fill(found.withColumn("weight", weight)), "targets")
    seats = round((found.agg(F.sum("target")).first()[0] or 0.0) / BLOCK)
    found = apportion(found.withColumn("all", F.lit(0)).withColumn("seats", F.lit(seats).cast("long")), "all", "sid", "target", "seats")
    shards = F.greatest(F.lit(1), F.ceil(F.col("words") / SHARD_WORDS), F.ceil(F.col("n") / SHARD_ROWS)).cast("int")
    return common.materialise(found.select("sid", "source", "words", "target", F.col("q").alias("blocks"), shards.alias("shards")), "sources")


def quotas(shards: DataFrame) -> DataFrame:
    """Adds ``quota`` to (sid, shard, words, target, blocks) rows: words to take of each shard,
    its blocks as apportioned and its part of the rest; twice its words at most. A source's
    quotas add up to its target, rounded."""
    rows = apportion(shards, "sid", "shard", "words", "blocks")
    rows = rows.withColumn("base", F.least(F.col("q") * BLOCK, MOST * F.col("words"))).withColumn("room", MOST * F.col("words") - F.col("base"))
    rows = common.materialise(rows.withColumn("piece", F.floor(F.col("shard") / PIECE).cast("int")), "shards")
    sums = rows.groupBy("sid").agg((F.round(F.max("target")) - F.sum("base")).cast("long").alias("rest"), F.sum("room").alias("rooms"), F.sum("base").alias("bases"))
    # the rest is dealt by room, or taken back by base, with running sums rounded
    part = lambda up, down: F.when(F.col("rest") >= 0, F.col(up)).otherwise(F.col(down))
    pieces = rows.groupBy("sid", "piece").agg(F.sum("room").alias("r"), F.sum("base").alias("b"))
    before = Window.partitionBy("sid").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for PIECE shards
    pieces = pieces.select("sid", "piece", F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    inside = Window.partitionBy("sid", "piece").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("r1", F.sum("room").over(inside)).withColumn("b1", F.sum("base").over(inside)).join(pieces, ["sid", "piece"]).join(sums, "sid")
    end = F.when(F.col("rest") >= 0, F.col("r0") + F.col("r1")).otherwise(F.col("b0") + F.col("b1"))
    own, whole = part("room", "base"), part("rooms", "bases")
    upto = lambda x: F.floor(F.abs("rest") * F.try_divide(x, whole))
    share = F.when((whole == 0) | (F.abs("rest") >= whole), own).otherwise(F.greatest(F.lit(0), F.least(own, upto(end) - upto(end - own))))
    return rows.select("sid", "shard", "words", (F.col("base") + F.when(F.col("rest") >= 0, share).otherwise(-share)).cast("long").alias("quota"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row.

    A null text or one without words has size 0 and is taken 0 times. A null source is a
    source, the last. Rows that repeat are separate rows of the stream. Equal seeds give
    equal results, whatever the partitions.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = common.materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    sources = common.broadcast_if_small(plan(rows), BROADCAST_SOURCES)
    named = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.doc_id", "r.size", "s.sid", F.col("s.words").alias("source_size"), "s.target", "s.blocks", "s.shards")
    named = named.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("shards")).cast("int"))

    each = quotas(named.groupBy("sid", "shard").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("blocks").alias("blocks")))
    each = each.select("sid", "shard", "words", F.when(F.col("words") > 0, F.expr("quota div words")).otherwise(0).alias("passes"), F.when(F.col("words") > 0, F.expr("quota % words")).otherwise(0).alias("part"))
    each = common.materialise(each, "quotas")

    # the blocks of each stream: how much of each the last pass takes, and of all before it
    cut = each.filter("words > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(words - 1) div {BLOCK}"))).alias("block"))
    cut = cut.withColumn("length", F.least(F.lit(BLOCK), F.col("words") - F.col("block") * BLOCK))
    of = Window.partitionBy("sid", "shard")
    drawn = of.orderBy(F.xxhash64(F.lit(seed), "sid", "shard", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("got", F.greatest(F.lit(0), F.least(F.col("length"), F.col("part") - F.coalesce(F.sum("length").over(drawn), F.lit(0)))))
    cut = cut.withColumn("before", F.coalesce(F.sum("got").over(of.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = cut.select("sid", "shard", "block", "got", "before", "passes")

    stream = of.orderBy(F.xxhash64(F.lit(seed), "doc_id"), F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = named.withColumn("end", F.sum("size").over(stream)).withColumn("begin", F.col("end") - F.col("size"))
    filled = placed.filter("size > 0").select("*", F.expr(f"begin div {BLOCK}").alias("b0"), F.expr(f"(end - 1) div {BLOCK}").alias("b1"))
    lo = cut.select("sid", "shard", F.col("block").alias("b0"), F.col("got").alias("got0"), F.col("before").alias("before0"), "passes")
    hi = cut.select("sid", "shard", F.col("block").alias("b1"), F.col("got").alias("got1"), F.col("before").alias("before1"))
    # the planner can't see how many blocks a shard has and would broadcast them all
    at = filled.join(lo.hint("merge"), ["sid", "shard", "b0"]).join(hi.hint("merge"), ["sid", "shard", "b1"])
    until = lambda x, b, got, before: F.col(before) + F.least(F.col(got), F.col(x) - F.col(b) * BLOCK)
    taken = F.col("passes") * F.col("size") + until("end", "b1", "got1", "before1") - until("begin", "b0", "got0", "before0")
    out = ["doc_id", "size", "source_size", "target"]
    return at.select(*out, taken.cast("long").alias("taken")).unionByName(placed.filter("size = 0").select(*out, F.lit(0).cast("long").alias("taken")))


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, columns kept.

    A row stays once for each whole time its words are taken, and once more with the
    chance of the share that is left over, drawn from a seeded hash of its doc_id. Rows
    without words weigh nothing and stay once. A doc_id that repeats is drawn by the mean
    of its rows; a null doc_id counts as one.
    """
    takes = mix(docs, seed).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + draw)).otherwise(1).cast("int")
    own_id, many, copy = (common.fresh(docs, c) for c in ("own_id", "many", "copy"))
    takes = takes.select(F.col("doc_id").alias(own_id), times.alias(many)).filter(F.col(many) > 0)
    own = docs.join(takes, docs["doc_id"].cast("long").eqNullSafe(takes[own_id]))
    return own.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many)))).select(docs.columns)
