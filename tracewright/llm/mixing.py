"""Mixing sources to target weights with a low-discrepancy slot schedule, in DataFrame functions only.

Slots 0..n-1 of the mixed stream get the points frac(i / golden ratio); a point picks the source whose
interval of cumulative target shares holds it, so every prefix of the schedule is close to the targets.
The slots of a source are ranked; its documents, shuffled by the MD5 of their ids, form a stream that is
read at most twice and cut into as many blocks of equal tokens (to one) as it has slots; slot rank k takes block k.

The number of slots follows the targets: one for TOKENS_PER_SLOT words, without a limit. Points have GOLDEN_BITS bits; beyond 2 ** GOLDEN_BITS slots the sequence of points begins anew, which
leaves every prefix as close to the targets as before.

mix_documents() gives out whole rows in the order of the schedule: a row stands at the slot that reads its first word, once for each pass, and its partitions hold ranges of
slots, so any run of partitions, and of rows in one, is near the targets. Two shuffles move texts, to meet their slots and to stand in order.

Nothing gathers a source in one task. Ranks and stream offsets are prefix sums on two levels: inside
(source, chunk of slots) or (source, hash bucket), and over the totals of the chunks or buckets. Slots
find their source by an equi-join on a grid cell of the unit interval.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share BUDGET times all sizes;
a target stops at CAP times its source's size and the excess goes to the others by weight. The level is
found in closed form: in the order of cap / weight, a source is capped if filling all to its level
takes no more than the budget.

Defined results: a null text has size 0 and takes 0; texts of any length are counted whole, and one longer than a block is read by several slots; null doc_ids are documents like others, shuffled by a hash of
their texts; repeated rows are documents of their own, interchangeable where id, source and size are equal (ties); a source of size 0 has target 0; empty tables give empty results; extra
columns of any name are not read by the query, and kept by mix_documents().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, all_columns, materialize, n_words, small_side_join, unused

WEIGHTS, BUDGET, CAP = (5, 2, 1), 1.5, 2
TOKENS_PER_SLOT = 512
CELLS, SLOT_CHUNK = 4096, 4096
ORDER_BUCKET_HEX = 4
#: 2**36 / golden ratio, made odd.
GOLDEN_BITS, GOLDEN = 36, 42470972311
_LOW = 1 << 24


def golden(slot):
    """frac(slot / golden ratio) in steps of 2**-GOLDEN_BITS, exact for every slot: two limbs keep the products below 2**61."""
    top = F.pmod(F.expr(f"{slot} div {_LOW}"), F.lit(1 << (GOLDEN_BITS - 24))) * F.lit(_LOW * GOLDEN % (1 << GOLDEN_BITS))
    return (top + F.pmod(F.col(slot), F.lit(_LOW)) * F.lit(GOLDEN)) % F.lit(1 << GOLDEN_BITS) / F.lit(float(1 << GOLDEN_BITS))


def shuffle_key(doc_id, text):
    """The hash that shuffles documents: of the id, or of the text where there is none."""
    return F.coalesce(F.md5(doc_id.cast("string").cast("binary")), F.md5(F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))).cast("binary")))


def row_key(order, source):
    """The shuffle's hash and the source in one."""
    return F.concat_ws("|", order, F.when(source.isNull(), "null").otherwise("is"), source)


def sized(docs: DataFrame) -> DataFrame:
    """Adds __size, and __order: the hash that shuffles documents."""
    return docs.withColumn("__size", n_words(F.col("text"))).withColumn("__order", shuffle_key(F.col("doc_id"), F.col("text")))


def source_targets(rows: DataFrame) -> DataFrame:
    """A row per source of (source, __size) rows: sid, source, source_size, target. Windows here see one row per source."""
    whole = W.partitionBy()
    s = rows.groupBy("source").agg(F.sum("__size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("int") - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("sid") % len(WEIGHTS) + 1))
    s = s.withColumn("cap", F.col("source_size") * CAP).withColumn("total", F.sum("source_size").over(whole) * F.lit(BUDGET))
    by = W.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = s.withColumn("below", F.sum("cap").over(by)).withColumn("above", F.sum("weight").over(whole) - F.sum("weight").over(by))
    s = s.withColumn("capped", F.col("below") + F.col("cap") / F.col("weight") * F.col("above") <= F.col("total"))
    spent = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole)
    free = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(whole)
    s = s.withColumn("spent", spent).withColumn("free", free)
    return s.select(
        "sid", "source", "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("total") - F.col("spent")) / F.col("free") * F.col("weight")).alias("target"),
    )


def slot_schedule(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """(slot, sid, rank): golden-ratio points mapped through the cumulative targets, ranked for each source."""
    n_sources, total = sources.agg(F.count("*"), F.sum("target")).first()
    n = int((total or 0) // TOKENS_PER_SLOT) + 1
    shares = sources.where("target >= 1").withColumn("hi", F.sum("target").over(W.orderBy("sid")) / F.lit(float(total or 1)))
    shares = shares.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("sid")), F.lit(0.0))).withColumn("hi", F.when(F.lead("sid").over(W.orderBy("sid")).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    cells = shares.select(
        "sid", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("cell"),
    )
    slots = spark.range(n).select(F.col("id").alias("slot"), golden("id").alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    met = small_side_join(slots, cells, ["cell"]).where("u >= lo AND u < hi").select("slot", "sid")
    # A source too small for any point gets one slot where its interval begins.
    missed = shares.join(met.select("sid").distinct(), "sid", "left_anti").select(F.floor(F.col("lo") * n).cast("long").alias("slot"), "sid")
    met = met.unionByName(missed).withColumn("chunk", F.floor(F.col("slot") / SLOT_CHUNK))
    local = met.withColumn("local", F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")).cast("long"))
    counts = met.groupBy("sid", "chunk").count()
    base = counts.withColumn("base", F.sum("count").over(W.partitionBy("sid").orderBy("chunk")) - F.col("count"))
    return local.join(base.select("sid", "chunk", "base"), ["sid", "chunk"]).select("slot", "sid", (F.col("base") + F.col("local") - 1).alias("rank"))


def in_stream(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the source's sid, source_size and target, and __local, the word offset in the source's hash bucket."""
    keyed = rows.withColumn("__null", F.col("source").isNull()).withColumn("__source", F.coalesce("source", F.lit("")))
    named = sources.select(
        F.col("source").isNull().alias("__null"), F.coalesce("source", F.lit("")).alias("__source"),
        F.col("sid").alias("__sid"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
    )
    keyed = small_side_join(keyed, named, ["__null", "__source"]).drop("__null", "__source")
    keyed = keyed.withColumn("__bucket", F.substring("__order", 1, ORDER_BUCKET_HEX))
    per = W.partitionBy("__sid", "__bucket")
    return keyed.withColumn("__local", F.sum("__size").over(per.orderBy("__order", "__size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__size"))


def bucket_bases(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Words before each (source, hash bucket) in the source's stream."""
    totals = rows.groupBy("source", F.substring("__order", 1, ORDER_BUCKET_HEX).alias("__bucket")).agg(F.sum("__size").alias("n"))
    totals = totals.join(sources.select("source", F.col("sid").alias("__sid")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return totals.select("__sid", "__bucket", (F.sum("n").over(W.partitionBy("__sid").orderBy("__bucket")) - F.col("n")).alias("__base"))


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of (source, __size, __order, ...) with __off, the word offset in the source's shuffled stream."""
    local = in_stream(rows, sources)
    return local.join(bucket_bases(rows, sources), ["__sid", "__bucket"]).withColumn("__off", F.col("__base") + F.col("__local")).drop("__base", "__local", "__bucket")


def mix_fragments(spark: SparkSession, rows: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mix, as (slot, sid, rank, pass, doc_id, off, size, length, first) fragments, and the placed rows; first: the fragment holds the document's first word.

    rows: (doc_id, source, __size, __order).
    """
    at = placed(rows, sources)
    schedule = slot_schedule(spark, sources)
    blocks = schedule.groupBy("sid").agg(F.count("*").alias("n_slots")).join(sources, "sid")
    blocks = blocks.select(F.col("sid").alias("__sid"), F.floor("target").alias("take"), "n_slots")
    passes = at.where("__size > 0").withColumn("__pass", F.explode(F.sequence(F.lit(0), F.lit(CAP - 1))))
    passes = small_side_join(passes, blocks, ["__sid"]).withColumn("lo", F.col("__off") + F.col("__pass") * F.col("__source_size"))
    passes = passes.withColumn("hi", F.least(F.col("lo") + F.col("__size"), F.col("take"))).where("lo < hi")
    # Block k of a source holds its words from k * take div n_slots on: equal to a word, and no slot is left without words at the end. Decimals, since the products pass 64 bits.
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    passes = passes.withColumn("take_", wide("take")).withColumn("slots_", wide("n_slots"))
    block_of = lambda c: F.expr(f"((cast({c} as decimal(18,0)) + 1) * slots_ - 1) div take_")
    start = lambda shift: F.expr(f"(cast(rank + {shift} as decimal(18,0)) * take_) div slots_")
    cut = passes.withColumn("head", block_of("lo")).withColumn("rank", F.explode(F.sequence("head", block_of("hi - 1"))))
    cut = cut.select(
        F.col("__sid").alias("sid"), "rank", F.col("__pass").alias("pass"), "doc_id", F.col("__off").alias("off"), F.col("__size").alias("size"), (F.col("rank") == F.col("head")).alias("first"),
        (F.least(F.col("hi"), start(1)) - F.greatest(F.col("lo"), start(0))).alias("length"),
    )
    return schedule.join(cut, ["sid", "rank"]), at


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each document."""
    rows = materialize(sized(docs.select("doc_id", "source", "text")).drop("text"), "mix-sizes")  # no texts: a few bytes a document
    sources = materialize(source_targets(rows), "mix-sources")
    parts, at = mix_fragments(spark, rows, sources)
    taken = parts.groupBy("sid", "off", "size", "doc_id").agg(F.sum("length").alias("taken"))
    at = at.select("doc_id", F.col("__sid").alias("sid"), F.col("__off").alias("off"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"))
    # A document with words is the only one of its source at its offset.
    found = at.join(taken.select("sid", "off", "size", "taken"), ["sid", "off", "size"], "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents of the mix as whole rows in the order of the schedule, with the columns of docs: never, once or twice, one for each pass that takes the row's first word."""
    rows, slot, off, _ = mix_slots(spark, docs)
    return rows.sortWithinPartitions(slot, off).select(*all_columns(docs))


def mix_slots(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str, str, int]:
    """The rows of the mix, dealt into partitions by ranges of slots; the names of further columns with their slot and their place in the source's stream; and the number of slots up to the last that begins a row."""
    size, order, kth, slot, off = unused(docs, "mix_size", "mix_order", "mix_kth", "mix_slot", "mix_off")
    with Workspace(spark, "mix") as tmp:
        rows = tmp.write(sized(docs.select("doc_id", "source", "text")).drop("text"), "sizes")
        sources = tmp.write(source_targets(rows), "sources")
        parts, at = mix_fragments(spark, rows, sources)
        at = at.withColumn("__order", row_key(F.col("__order"), F.col("source"))).withColumn("kth", F.row_number().over(W.partitionBy("__order", "__size").orderBy("__off")))
        first = parts.where("first").select("sid", "off", "size", "slot")
        # A document with words is the only one of its source at its offset.
        found = at.select(F.col("__sid").alias("sid"), F.col("__off").alias("off"), F.col("__size").alias("size"), "__order", "kth").join(first, ["sid", "off", "size"])
        copies = tmp.write(found.select(F.col("__order").alias(order), F.col("size").alias(size), "kth", F.col("slot").alias(slot), F.col("off").alias(off)), "copies", keep=True)
        ties = tmp.write(rows.where("__size > 0").withColumn("__order", row_key(F.col("__order"), F.col("source"))).groupBy("__order", "__size").count().where("count > 1").select(F.col("__order").alias(order), F.col("__size").alias(size)), "ties", keep=True)
    n = (copies.agg(F.max(slot)).first()[0] or 0) + 1
    keyed = docs.withColumn(size, n_words(F.col("text"))).where(F.col(size) > 0).withColumn(order, row_key(shuffle_key(F.col("doc_id"), F.col("text")), F.col("source")))
    copies = copies.withColumnRenamed("kth", kth)
    if ties.isEmpty():
        met = keyed.join(copies.drop(kth), [order, size])
    else:  # rows that share id, source and size are told apart by a number; no others have to be
        tied = keyed.join(ties, [order, size], "left_semi").withColumn(kth, F.row_number().over(W.partitionBy(order, size).orderBy(F.xxhash64("text"))))
        one = keyed.join(ties, [order, size], "left_anti").withColumn(kth, F.lit(1))
        met = one.unionByName(tied).join(copies, [order, size, kth])
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return met.repartitionById(parts, F.floor(F.col(slot) / F.lit(-(-n // parts))).cast("int")), slot, off, n
