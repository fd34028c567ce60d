"""Mixing sources to target weights, with DataFrame and SQL functions only.

The words of each source form one stream, cut into blocks of a fixed length. Output shards draw
multinomial source counts (every slot draws its source from the target shares); where the draws of
all shards together miss a source's quota, the surplus slots go to the sources that lack some. The
slots of a source are numbered through, mapped by a pseudorandom permutation of its block indexes
(a new one for each epoch), and joined to the blocks by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import SPACE_JAVA, Scratch, boxed, slots

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, MOST, BLOCK_WORDS, SHARD_SLOTS, ROUNDS = 1.5, 2, 64, 8192, 4
#: 2**53, the number of values of a uniform draw.
UNIT = float(1 << 53)
#: Rows of a table of sources that may be broadcast; cells of the grid that draws are looked up by.
BROADCAST_ROWS, CELLS = 50_000, 4096


def n_words(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): share * all sizes dealt by weight, none above most * size.

    Sources are ordered by code point, null last. The shares are min(most * size, level * weight) for
    the one level at which they sum to the total: what resharing the excess again and again ends at.
    """
    by_name = W.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    d = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_cap = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").cast("binary").asc_nulls_last())
    upto, all_rows = by_cap.rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    total = F.sum("source_size").over(all_rows) * F.lit(float(share))
    d = d.withColumn("_total", F.least(total, F.sum("_cap").over(all_rows))).withColumn("_rest_w", F.sum("_w").over(all_rows) - F.sum("_w").over(upto) + F.col("_w"))
    d = d.withColumn("_level", F.greatest(F.lit(0.0), F.col("_total") - F.sum("_cap").over(upto) + F.col("_cap")) / F.col("_rest_w"))
    # the first source, in order of cap over weight, that the level doesn't fill fixes the level for all after it
    d = d.withColumn("_at", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level")))
    d = d.withColumn("_at", F.first("_at", ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return d.withColumn("target", F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_at") * F.col("_w")))).select("source", "source_size", "target")


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 that the key picks: a Feistel network over [a] x [b].

    a * b is n or little above; an index that falls beyond n walks on to the next of its cycle.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def once(x: Column) -> Column:
        left, right = F.pmod(x, a), F.floor(x / a).cast("long")
        for r in range(ROUNDS):
            if r % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(r), *key), b), b)
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(r), *key), a), a)
        return right * a + left

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(48)), once(index), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return walk


def before(d: DataFrame, by: list[str], chunk: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same ``by`` that come earlier.

    ``chunk`` must rise with ``order`` or be all there is to the order of chunks. Sums of chunks come first, then sums within
    a chunk, so no task holds all rows of a ``by``.
    """
    d = d.withColumn("_chunk", chunk)
    part = d.groupBy(*by, "_chunk").agg(F.sum(value).alias("_n"))
    earlier = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    part = part.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inner = W.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_in", F.sum(value).over(inner) - F.col(value))
    return d.join(part, [*by, "_chunk"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_chunk", "_before", "_in")


def sized(docs: DataFrame, **more: Column) -> DataFrame:
    """What a mix needs of documents: doc_id, source, size (words) and ``_text``, a hash of the text; and further expressions."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"), *(x.alias(k) for k, x in more.items()))


def mix(sizes: DataFrame, *, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7, share: float = SHARE, most: int = MOST, weights=WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(documents, takes) of a mix of documents that ``sized`` describes.

    documents: a row for each document, with size, source_size, target, taken (words that the mix
    takes, repeats counted), ``_start`` (place in its source's stream), ``_block`` (its source's block
    length) and ``_source`` (the source, null made distinct from all names).
    takes: (_source, block, times): how often a block is taken, where it is.
    Null and empty texts have size 0 and are never taken; a null source is a source of its own; null or
    repeated doc_ids are documents like others. An empty table gives empty results.
    """
    d = sizes.withColumn("_source", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    d = d.withColumn("_source", F.xxhash64("_source.none", "_source.name")).withColumn("_order", F.xxhash64("doc_id", F.lit(seed), F.col("_text")))
    spark = sizes.sparkSession
    src = d.groupBy("source", "_source").agg(F.sum("size").alias("source_size"))
    src = targets(src.select("source", "source_size"), weights, share, most).withColumn("_source", F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    # short sources get shorter blocks, so that a quota of whole blocks meets their target
    src = src.withColumn("_block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / 512))).cast("long"))
    src = src.withColumn("_blocks", F.ceil(F.col("source_size") / F.col("_block")).cast("long"))
    src = src.withColumn("_quota", F.least(F.col("_blocks") * most, F.round(F.try_divide("target", "source_size") * F.col("_blocks"))).cast("long"))
    src = src.withColumn("_quota", F.coalesce("_quota", F.lit(0)))
    upto = W.orderBy("_source").rowsBetween(W.unboundedPreceding, 0)
    src = src.withColumn("_to", F.sum("_quota").over(upto)).withColumn("_from", F.col("_to") - F.col("_quota"))
    src = src.withColumn("_all", F.max("_to").over(W.partitionBy()))
    src = Scratch(spark).keep(src)
    small = fits(src)
    counts = shard_counts(src, shard_slots, seed, small)
    # slots of a source, numbered through over the shards, and the blocks that they stand for
    runs = before(counts, ["_source"], thousand(), ["shard"], "n", "_begin").withColumn("_end", F.col("_begin") + F.col("n"))
    runs = runs.join(small(src.select("_source", "_blocks")), "_source").where("n > 0").repartition(slots(spark), "shard", "_source")
    slot = runs.select("_source", "_blocks", F.explode(F.sequence("_begin", F.col("_end") - 1)).alias("_i"))
    epoch = F.floor(F.col("_i") / F.col("_blocks"))
    takes = slot.select("_source", permuted(F.pmod("_i", "_blocks"), F.col("_blocks"), F.col("_source"), epoch, F.lit(seed)).alias("block"), epoch.cast("int").alias("epoch"))
    takes = takes.groupBy("_source", "block").agg(F.count(F.lit(1)).cast("int").alias("times"))
    d = d.join(small(src.select("_source", "source_size", "target", "_block")), "_source")
    d = before(d, ["_source"], F.pmod(F.xxhash64("_order"), F.lit(slots(spark, 12) * 4)), ["_order", "size"], "size", "_start")
    return d, takes


def thousand() -> Column:
    """Chunks of shards."""
    return F.floor(F.col("shard") / 1024)


def fits(src: DataFrame):
    """F.broadcast for a table of at most BROADCAST_ROWS (short) rows, counted; for a longer one, no hint."""
    return F.broadcast if src.count() <= BROADCAST_ROWS else lambda d: d


def shard_counts(src: DataFrame, shard_slots: int, seed: int, small) -> DataFrame:
    """(shard, _source, n): multinomial counts for each output shard, the sums of which meet the quotas.

    Each slot draws its source by the quotas. Slots beyond a source's quota, counted in order of shards,
    are dealt to the sources whose draws fall short, in order of shards again.
    """
    spark = src.sparkSession
    total = src.agg(F.max("_to")).first()[0] or 0
    slot = spark.range(0, total, 1, max(1, min(slots(spark, 1), total // 50_000 + 1))).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.floor((F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / F.lit(UNIT)) * total).cast("long").alias("_u"))
    # the source whose range of quotas holds the draw: ranges are found by the cells of a grid that they lie in
    cell = lambda c: F.floor(c.cast("double") * CELLS / max(1, total)).cast("long")
    ranges = src.where("_quota > 0").select("_source", "_from", "_to", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("_to") - 1))).alias("_cell"))
    drawn = slot.withColumn("n", F.lit(1)).withColumn("_cell", cell(F.col("_u")))
    drawn = drawn.join(small(ranges), (drawn["_cell"] == ranges["_cell"]) & (F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to")))
    drawn = drawn.groupBy("shard", "_source").agg(F.sum("n").alias("n"))
    drawn = before(drawn.join(small(src.select("_source", "_quota")), "_source"), ["_source"], thousand(), ["shard"], "n", "_upto")
    drawn = drawn.withColumn("_kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("_quota") - F.col("_upto"))))
    drawn = Scratch(spark).keep(drawn.select("shard", "_source", "n", "_kept"))
    over = drawn.withColumn("_free", F.col("n") - F.col("_kept")).groupBy("shard").agg(F.sum("_free").alias("_free")).where("_free > 0")
    over = before(over.withColumn("_all", F.lit(0)), ["_all"], thousand(), ["shard"], "_free", "_a").withColumn("_b", F.col("_a") + F.col("_free"))
    got = drawn.groupBy("_source").agg(F.sum("_kept").alias("_got"))
    lack = src.select("_source", "_quota").join(got, "_source", "left").withColumn("_lack", F.col("_quota") - F.coalesce("_got", F.lit(0))).where("_lack > 0")
    lack = before(lack.withColumn("_all", F.lit(0)), ["_all"], F.shiftright("_source", 50), ["_source"], "_lack", "_c").withColumn("_d", F.col("_c") + F.col("_lack"))
    # what is free and what is lacking meet where they overlap: in the cells of a grid over both, of which their first common one counts
    n_free = drawn.agg(F.sum(F.col("n") - F.col("_kept"))).first()[0] or 0
    at = lambda c: F.floor(c.cast("double") * CELLS / max(1, n_free)).cast("long")
    over = over.withColumn("_first", at(F.col("_a"))).withColumn("_cell", F.explode(F.sequence("_first", at(F.col("_b") - 1))))
    lack = lack.withColumn("_from", at(F.col("_c"))).withColumn("_cell", F.explode(F.sequence("_from", at(F.col("_d") - 1))))
    fill = over.join(lack.select("_source", "_c", "_d", "_from", "_cell"), "_cell").where((F.col("_a") < F.col("_d")) & (F.col("_c") < F.col("_b")) & (F.col("_cell") == F.greatest("_first", "_from")))
    fill = fill.select("shard", "_source", (F.least("_b", "_d") - F.greatest("_a", "_c")).alias("n"))
    return drawn.select("shard", "_source", F.col("_kept").alias("n")).unionByName(fill).groupBy("shard", "_source").agg(F.sum("n").alias("n"))


def covered(docs: DataFrame, takes: DataFrame) -> DataFrame:
    """(_row, block, times, _words, _at): the blocks that each document reaches into, joined by index to takes."""
    first, last = F.floor(F.col("_start") / F.col("_block")), F.floor((F.col("_start") + F.col("size") - 1) / F.col("_block"))
    b = docs.where("size > 0").select("_source", "_row", "_start", "size", "_block", F.explode(F.sequence(first, last)).alias("block"))
    at = F.greatest(F.col("_start"), F.col("block") * F.col("_block")) - F.col("_start")
    to = F.least(F.col("_start") + F.col("size"), (F.col("block") + 1) * F.col("_block")) - F.col("_start")
    b = b.select("_source", "_row", "block", at.alias("_at"), (to - at).alias("_words"))
    return b.join(takes, ["_source", "block"])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken. See ``mix``."""
    # the texts are read once, for their sizes
    d, takes = mix(Scratch(docs.sparkSession).keep(sized(docs)), **options)
    d = d.withColumn("_row", F.struct("_source", "_start", "_order"))
    taken = covered(d, takes).groupBy("_row").agg(F.sum(F.col("_words") * F.col("times")).alias("taken"))
    # documents of size 0 share places; only those with words can have been taken
    d = d.withColumn("_key", F.when(F.col("size") > 0, F.col("_row")))
    out = d.join(taken.withColumnRenamed("_row", "_key"), "_key", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def resampled(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each text is the words taken from it, block after block, repeats after that.

    Documents of which nothing is taken go, and with them null and empty texts; n_chars, where there is one, is counted anew;
    other columns stay as they are, whatever their names. Rows that repeat id, text and source are mixed each on its own. A null id
    or source is one like others. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    # all but the last step works on sizes; copy numbers the rows that repeat id, text and source
    sizes = scratch.keep(sized(docs).where("size > 0"))
    key = ["doc_id", "_text", "source"]
    d, takes = mix(sizes, **options)
    d = scratch.keep(d.withColumn("_row", F.struct("_source", "_start", "_order")))
    parts = covered(d, takes).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_words", "times"))).alias("_parts"))
    parts = d.select("_row", *key).join(parts, "_row")
    base = boxed(docs, doc_id=F.col("doc_id"), _text=F.xxhash64("text"), source=F.col("source"), text=F.col("text"))
    repeats = bool(sizes.groupBy(*key).count().where("count > 1").limit(1).count())
    if repeats:
        copy = F.row_number().over(W.partitionBy(*key).orderBy(F.lit(1)))
        parts, base, key = parts.withColumn("_copy", copy), base.withColumn("_copy", copy), [*key, "_copy"]
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"d.{k}")) for k in key]
    on = same[0]
    for s in same[1:]:
        on = on & s
    d = base.alias("d").join(parts.alias("p"), on).select("d.row", "d.text", "p._parts")
    d = d.withColumn("_w", F.filter(F.split("text", SPACE_JAVA), lambda w: w != ""))
    piece = lambda t: F.transform(F.filter("_parts", lambda p: p["times"] >= t), lambda p: F.slice(F.col("_w"), (p["_at"] + 1).cast("int"), p["_words"].cast("int")))
    most = options.get("most", MOST)
    d = d.withColumn("text", F.array_join(F.flatten(F.concat(*[piece(t) for t in range(1, most + 1)])), " "))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(row.alias("row")).select("row.*")
