"""Mixing sources to target weights: fixed-length blocks of words drawn by slots of output shards. DataFrame functions only.

* Targets: the mix takes ``SHARE`` times all words. Sources, by code point with null last, weigh 5, 2, 1 and so on;
  a source takes ``MOST`` times its words at most, and what it leaves goes to the others by weight: target =
  min(most, weight x level) with one level for all, found from running sums over the sources.
* Blocks: a source's documents are laid end to end (by hashed bucket, then id) and cut every ``block`` words. Running
  sums run within buckets of bounded size and then over buckets, so no source lies in one task.
* Slots: every shard of ``SHARD_SLOTS`` slots draws its multinomial counts, a hashed uniform number a slot, looked up
  among the sources' shares by cell. A source's slots are numbered over shards; those beyond its quota are handed on, in
  order, to sources below theirs, so every source ends within a block of its target.
* Slot j of a source reads block j modulo its number of blocks, through a permutation of its own for every
  pass (multiplication by a large prime, then an offset), so no block is read more than ``MOST`` times.
* Blocks are joined by index to the documents that lie in them.

A null text has no words. Rows are told apart by id and text; equal rows are taken alike. Equal input gives equal mixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import common

#: Weights by the sources' order, repeated. Fixed values.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: A source is cut into this many blocks or more, of ``LONGEST_BLOCK`` words at most.
BLOCKS = 1024
LONGEST_BLOCK = 2048
SHARD_SLOTS = 4096
#: Documents of one source whose running sum one task makes, in the mean.
BUCKET_ROWS = 20_000
CELLS = 4096
#: Primes above any number of blocks of one source (2**31 blocks of 2048 words). Fixed values.
PRIMES = (2147483647, 2147483629)

_WORDS = r"[^ \t-\r]+"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, place) from (source, size) rows of documents; ``place`` numbers the sources."""
    rows = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))  # one row a source from here on
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    rows = rows.withColumn("weight", weights[F.col("place") % len(WEIGHTS)]).withColumn("most", (MOST * F.col("source_size")).cast("double"))
    everything = Window.partitionBy()
    rows = rows.withColumn("left", SHARE * F.sum("source_size").over(everything)).withColumn("ratio", F.col("most") / F.col("weight"))
    ahead = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy("ratio", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # were this source the first that is not full, the level would be what is left over the weights from it on
    level = (F.col("left") - F.coalesce(F.sum("most").over(ahead), F.lit(0.0))) / F.sum("weight").over(behind)
    rows = rows.withColumn("level", level)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)["level"]
    return rows.select("source", "source_size", "place", F.least("most", F.coalesce(F.col("weight") * level, "most")).alias("target"))


def _uniform(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11) * F.lit(2.0**-53)


def lay_out(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents with words, as (place, block, key, lo, hi): the words [lo, hi) that they fill of their source."""
    rows = docs.where("size > 0").groupBy("source", "key").agg(F.first("size").alias("one"), F.sum("size").alias("size"), F.count("*").alias("copies"))
    plan = plan.where("source_size > 0")
    rows = rows.join(F.broadcast(plan) if plan.limit(100_000).count() < 100_000 else plan, rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    total = rows.agg(F.count("*")).first()[0]
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = rows.select("place", "block", "key", "size", "copies", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("place", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("place", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("off", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums.drop("n"), ["place", "bucket"])
    lo = F.col("base") + F.col("off")
    return rows.select("place", "block", "key", "copies", lo.alias("lo"), (lo + F.col("size")).alias("hi"))


def draw_blocks(spark: SparkSession, plan: DataFrame, seed: int) -> DataFrame:
    """(place, index, times): how often each block of each source is read; ``plan`` has (place, block, blocks, quota)."""
    plan = plan.where("quota > 0")
    total = plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    upto = F.sum("quota").over(Window.orderBy("place"))
    shares = plan.select("place", (upto / total).alias("hi"), ((upto - F.col("quota")) / total).alias("lo"), "quota")
    cells = shares.select("place", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    slots = spark.range(total).select("id", F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), _uniform(F.col("id"), F.lit(seed)).alias("u"))
    drawn = slots.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell").where("u >= lo AND u < hi").select("id", "shard", "place")
    drawn = common.stage(drawn, "slots")
    counts = drawn.groupBy("place", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("place", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("place", "shard").orderBy("id")) - 1
    slots = drawn.withColumn("number", number).join(base, ["place", "shard"]).select("place", (F.col("base") + F.col("number")).alias("j"))
    # what a source draws beyond its quota fills, in order, the places that others have left open
    held = plan.join(counts.groupBy("place").agg(F.sum("n").alias("got")), "place", "left").select("place", "quota", F.coalesce("got", F.lit(0)).alias("got"))
    over, under = F.greatest(F.col("got") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("got"), F.lit(0))
    held = common.stage(
        held.select("place", "quota", "got", (F.sum(over).over(Window.orderBy("place")) - over).alias("over"), under.alias("open"), (F.sum(under).over(Window.orderBy("place")) - under).alias("from")),
        "quotas",
    )
    slots = slots.join(held.select("place", "quota", "over"), "place")
    kept = slots.where("j < quota").select("place", "j")
    spare = slots.where("j >= quota").select((F.col("over") + F.col("j") - F.col("quota")).alias("x"))
    given = held.where("open > 0").select("place", F.posexplode(F.sequence(F.col("from"), F.col("from") + F.col("open") - 1)).alias("i", "x"), "got")
    given = given.join(spare, "x").select("place", (F.col("got") + F.col("i")).alias("j"))
    slots = kept.unionByName(given).join(plan.select("place", "blocks"), "place")
    turn, j = F.floor(F.col("j") / F.col("blocks")), F.col("j") % F.col("blocks")
    prime = F.when(F.lit(PRIMES[0]) % F.col("blocks") != 0, F.lit(PRIMES[0])).otherwise(F.lit(PRIMES[1])).cast("long")
    shift = F.pmod(F.xxhash64("place", turn, F.lit(seed)), F.col("blocks"))
    index = (F.when(turn % 2 == 0, j).otherwise(F.col("blocks") - 1 - j) * (prime % F.col("blocks")) + shift) % F.col("blocks")
    return slots.select("place", index.alias("index")).groupBy("place", "index").agg(F.count("*").alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """(row key, id, source, size, source_size, target, taken, pieces) of every row.

    ``pieces`` lists what is taken: (from, to, times) stretches of the row's words, blocks in order.
    """
    spark = common.ready(docs.sparkSession)
    rows = docs.select(
        common.row_key(id_col, text_col, source_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size")
    )
    rows = common.stage(rows, "sizes")
    block = F.greatest(F.lit(1), F.least(F.lit(LONGEST_BLOCK), F.floor(F.col("source_size") / BLOCKS)))
    plan = source_targets(rows).withColumn("block", block).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
    quota = F.least(F.round(F.col("target") / F.col("block")).cast("long"), MOST * F.col("blocks"))
    plan = common.stage(plan.withColumn("quota", quota), "targets")
    placed = lay_out(rows, plan)
    drawn = draw_blocks(spark, plan, seed)
    spans = placed.select("place", "block", "key", "copies", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / F.col("block")), F.floor((F.col("hi") - 1) / F.col("block")))).alias("index"))
    a, b = F.greatest("lo", F.col("index") * F.col("block")), F.least("hi", (F.col("index") + 1) * F.col("block"))
    taken = spans.join(drawn, ["place", "index"]).select("key", "copies", ((b - a) * F.col("times")).alias("n"), F.struct((a - F.col("lo")).alias("from"), (b - F.col("lo")).alias("to"), "times").alias("piece"))
    taken = taken.groupBy("key", "copies").agg(F.sum("n").alias("taken"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    taken = common.stage(taken, "taken")  # a few numbers a row; what follows uses them again and again, and its plan stays small
    # equal rows lie one after the other: each gets the part that falls into it
    number = F.row_number().over(Window.partitionBy("key").orderBy("size")) - 1
    several = taken.where("copies > 1").select("key").join(rows, "key").withColumn("number", number)
    own = F.transform(
        F.col("pieces"),
        lambda p: F.struct(
            F.greatest(p["from"] - F.col("number") * F.col("size"), F.lit(0)).alias("from"), F.least(p["to"] - F.col("number") * F.col("size"), F.col("size")).alias("to"), p["times"].alias("times")
        ),
    )
    own = F.filter(own, lambda p: p["from"] < p["to"])
    alone = rows.join(taken.where("copies = 1"), "key", "left").join(several.select("key").distinct(), "key", "left_anti").withColumn("number", F.lit(0))
    out = alone.unionByName(several.join(taken, "key")).withColumn("pieces", own)
    count = F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + (p["to"] - p["from"]) * p["times"])
    shown = plan.select(F.col("source").alias("of"), "source_size", "target")
    return out.join(shown, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("key").alias(common.ROW_KEY), "doc_id", "source", "size", "source_size", "target", F.coalesce(count, F.lit(0)).cast("long").alias("taken"), "number", "pieces"
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: for each pass over a row, its taken words in order, and whole texts unchanged.

    A row that is read twice somewhere gives two rows. Equal rows are taken alike, by what the first of them gives. ``n_chars`` is counted
    anew where there is one; other columns come back unchanged, whatever their names.
    """
    found = common.stage(mix(docs).where("taken > 0 AND number = 0").select(common.ROW_KEY, "size", "pieces"), "mix")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no column of the input meets one of ours
    rows = docs.select(common.row_key("doc_id", "text", "source").alias(common.ROW_KEY), row).join(found, common.ROW_KEY)
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(MOST))))
    rows = rows.withColumn("mine", F.filter("pieces", lambda p: p["times"] >= F.col("pass"))).where(F.size("mine") > 0)
    n = F.aggregate("mine", F.lit(0).cast("long"), lambda acc, p: acc + p["to"] - p["from"])
    words = F.regexp_extract_all("row.text", F.lit(f"({_WORDS})"), F.lit(1))
    cut = F.array_join(F.flatten(F.transform("mine", lambda p: F.slice(words, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")))), " ")
    rows = rows.withColumn("text", F.when(n == F.col("size"), F.col("row.text")).otherwise(cut))
    ours = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[ours.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
