"""Mixing sources to target weights. DataFrame operations only.

The words of each source are packed end to end into blocks of fixed length, and the source's target asks for so many slots.
Every slot draws the output shard that it falls to, so that the counts of a shard's sources are multinomial, given that a
source's counts add up to its slots. The drawn counts cut each source's slots into the shards' ranges; slots walk through
pseudorandom permutations of the source's block indices, one for each pass, and blocks are joined to slots by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscan.llm.common import WORD, running, sized, stage

WEIGHTS = (5, 2, 1)
#: Multiplier and modulus that scatter doc_ids over a source's stream.
SCATTER, MODULUS = 1103515245, 2**31


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame, row_id: Column, at: str = "") -> DataFrame:
    """rid (names the row), doc_id, skey, size (words), mark (a hash of the text) of every row, written out. at: the struct of the row's columns."""
    c = lambda name: F.col(f"{at}{name}")
    return stage(docs.select(row_id.alias("rid"), c("doc_id").cast("long").alias("doc_id"), _source_key(c("source")).alias("skey"), _word_count(c("text")).alias("size"), F.xxhash64(c("text")).alias("mark")), "sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """For each source: rank, source_size, base (words of the sources before it), target (words) by water filling.

    Sources by code point, null last, have the weights in turn. They share all words; a share above `most` times the
    source's size is cut to that, and the excess goes to the others by weight until none is above.
    """
    s = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("skey") == "n", "skey")
    s = s.withColumn("rank", F.row_number().over(order))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
    # by falling room: a source is cut where the level reached without it and all tighter ones exceeds its room
    room = Window.orderBy(most * F.col("source_size") / F.col("weight"), "rank")
    everyone, before = Window.partitionBy(), room.rowsBetween(Window.unboundedPreceding, -1)
    cap = most * F.col("source_size")
    s = s.withColumn("level", (F.sum("source_size").over(everyone) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("open", F.when(F.col("level") <= cap / F.col("weight"), F.col("level")))
    s = s.withColumn("final", F.max_by("open", F.when(F.col("open").isNotNull(), -cap / F.col("weight"))).over(everyone))
    s = s.withColumn("target", F.least(cap.cast("double"), F.coalesce(F.col("final") * F.col("weight"), cap.cast("double"))))
    base = F.sum("source_size").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return s.select("skey", "rank", "source_size", F.coalesce(base, F.lit(0)).alias("base"), "target")


def draw_blocks(sources: DataFrame, shard_slots: int, seed: int = 1) -> DataFrame:
    """(rank, slot, shard, pass, block) for every slot of the mix. sources: rank, blocks, slots. A shard has about shard_slots."""
    spark = sources.sparkSession
    row = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("m"), F.count("*").alias("n")).first()
    m, n = row["m"], row["n"]
    shards = max(1, -(-m // shard_slots))
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cut = sources.filter("slots > 0").withColumn("hi", F.sum("slots").over(upto)).withColumn("lo", F.col("hi") - F.col("slots"))
    # the source of each slot, found through bins of slot numbers
    width = max(1, -(-m // max(4096, n)))
    bins = cut.select("rank", "blocks", "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}L, (hi - 1) div {width}L)")).alias("bin"))
    every = spark.range(m).withColumn("bin", F.expr(f"id div {width}L")).join(sized(bins, rows=max(4096, n) + n), "bin").filter("id >= lo AND id < hi")
    every = every.select("rank", "blocks", "lo", (F.col("id") - F.col("lo")).alias("slot"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:draw"), F.col("rank").cast("string"), F.col("slot").cast("string"))), 1, 15), 16, 10).cast("long")
    drawn = every.groupBy("rank", "blocks", "lo", (number % shards).alias("shard")).agg(F.count("*").alias("drawn"))
    runs = running(drawn, [F.col("rank"), F.col("shard")], "drawn").withColumn("start", F.col("before") - F.col("lo"))
    # one row for each source and shard: dealt out, as each makes as many rows as it drew
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    j = runs.repartition(parts, "rank", "shard").select("rank", "blocks", "shard", F.explode(F.expr("sequence(start, start + drawn - 1)")).alias("slot"))
    return j.select("rank", "slot", "shard", F.expr("slot div blocks").alias("pass"), permuted(seed).alias("block"))


def permuted(seed: int) -> Column:
    """Block of a slot: slot mod blocks under a pseudorandom permutation of 0..blocks-1, keyed by seed, source and pass.

    Numbers are pairs (l, r) of a grid of a x b, a the root of blocks and b as large as it takes, and go through four Feistel
    rounds: l moves by a digest of r, then r by one of l. A number that falls outside is sent through again until it is inside. The
    grid has fewer than a numbers too many, so that up to 4096 blocks every way back in is walked to its end, and for more one
    of 16 steps has less than one chance in 2^90.
    """
    n = F.col("blocks")
    a = F.ceil(F.sqrt(n)).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")
    key = F.concat_ws(":", F.lit(str(seed)), F.col("rank").cast("string"), F.expr("slot div blocks").cast("string"))

    def turned(x: Column, i: Column) -> Column:
        low, high = x % a, F.floor(x / a).cast("long")
        fixed = F.when(i % 2 == 0, high).otherwise(low)
        mark = F.conv(F.substring(F.md5(F.concat_ws(":", key, i.cast("string"), fixed.cast("string"))), 1, 12), 16, 10).cast("long")
        return F.when(i % 2 == 0, (low + mark) % a + high * a).otherwise(low + (high + mark) % b * a)

    sent = lambda x: F.aggregate(F.array(*[F.lit(i) for i in range(4)]), x, turned)
    steps = F.sequence(F.lit(0), F.when(n < 4096, a * b - n).otherwise(15))
    return F.aggregate(steps, F.col("slot") % n, lambda x, i: F.when((i > 0) & (x < n), x).otherwise(sent(x)))


def mix(sizes: DataFrame, block_words: int = 64, shard_slots: int = 4096, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, pieces, slots) of the mix of measured() rows.

    placed: the rows with rank, source_size, target, first (the row's first word in its source's stream). pieces: the parts of
    rows in blocks, with rank, block, lo and hi (words of the row). slots: what shard takes which block, and how often; a block
    is taken `most` times at most. A source without words gets none. Reruns give the same: rows that agree in doc_id, source
    and text are alike.
    """
    shares = stage(targets(sizes, weights, most), "targets")
    # as many slots as give the target at the source's mean block length
    sources = shares.filter("source_size > 0").withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}L"))
    sources = sources.withColumn("slots", F.least(most * F.col("blocks"), F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).cast("long")).select("rank", "blocks", "slots")
    scattered = (F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(MODULUS)) * SCATTER) % MODULUS
    joined = sizes.join(sized(shares), "skey").withColumn("scattered", scattered)
    order = [F.col(c) for c in ("rank", "scattered", "doc_id", "size", "mark", "rid")]
    placed = running(joined, order, "size").withColumn("first", F.col("before") - F.col("base"))
    placed = stage(placed.select("rid", "doc_id", "skey", "rank", "size", "source_size", "target", "first"), "placed")
    slots = draw_blocks(stage(sources, "sources"), shard_slots, seed)
    slots = stage(slots.groupBy("rank", "block", "shard").agg(F.count("*").alias("takes")), "slots")
    full = placed.filter("size > 0").select("rid", "rank", "first", "size", F.explode(F.expr(f"sequence(first div {block_words}L, (first + size - 1) div {block_words}L)")).alias("block"))
    lo, hi = F.greatest(F.col("block") * block_words - F.col("first"), F.lit(0)), F.least((F.col("block") + 1) * block_words - F.col("first"), "size")
    return placed, full.select("rid", "rank", "block", lo.alias("lo"), hi.alias("hi")), slots


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards (how many output shards drew a part of it) and source for every row of
    docs; see mix(). Null texts have no words. An empty table gives no row; further columns are ignored."""
    placed, pieces, slots = mix(measured(docs, F.monotonically_increasing_id()), **options)
    words = F.sum(F.col("takes") * (F.col("hi") - F.col("lo"))).alias("words")
    by_shard = pieces.join(slots.hint("merge"), ["rank", "block"]).groupBy("rid", "shard").agg(words)
    sums = by_shard.groupBy("rid").agg(F.sum("words").alias("taken"), F.count("*").alias("shards"))
    out = placed.join(sums.hint("merge"), "rid", "left")
    source = F.when(F.col("skey") != "n", F.substring("skey", 2, 1 << 30))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "size", "source_size", "target", number("taken"), number("shards"), source.alias("source"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: copy k of a document (1 to `most`) holds, in order, its words that the mix takes k times at
    least, so that the copies together hold the words taken. Untaken documents go; a copy taken whole keeps its text as it is.
    Rows keep docs' columns, whatever their names; n_chars, where there is one, becomes the new length. Null and blank texts
    have nothing to take and go; rows that are alike are each a document; an empty table gives no row.

    Rows are written once with a number of their own, by which their plans find them; words are cut once for all copies.
    """
    rows = stage(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")), "rows")
    placed, pieces, slots = mix(measured(rows, F.col("rid"), "row."), **options)
    times = slots.groupBy("rank", "block").agg(F.sum("takes").alias("times"))
    parts = pieces.join(times.hint("merge"), ["rank", "block"]).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "times"))).alias("parts"))
    plan = parts.join(placed.select("rid", "size").hint("merge"), "rid").select("rid", "size", "parts")
    planned = rows.join(plan.hint("merge"), "rid")
    wanted = F.expr("transform(sequence(1L, array_max(transform(parts, p -> p.times))), k -> filter(parts, p -> p.times >= k))")
    length = lambda chosen: F.aggregate(chosen, F.lit(0).cast("long"), lambda n, p: n + p.hi - p.lo)
    planned = planned.withColumn("copies", wanted).withColumn("all_whole", F.forall("copies", lambda c: length(c) == F.col("size")))
    text = F.col("row.text")
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    planned = planned.withColumn("words", F.when(~F.col("all_whole"), words))
    cut = lambda c: F.array_join(F.flatten(F.transform(c, lambda p: F.slice(F.col("words"), (p.lo + 1).cast("int"), (p.hi - p.lo).cast("int")))), "")
    texts = F.transform("copies", lambda c: F.when(length(c) == F.col("size"), text).otherwise(cut(c)))
    out = planned.select("row", F.explode(texts).alias("new"))
    change = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return out.select(*[change.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
