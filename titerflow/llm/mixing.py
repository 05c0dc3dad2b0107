"""Mixing sources to target weights with DataFrame functions only.

Words of each source, in document order, are packed into blocks of fixed length.  Every output shard draws
how many of its slots each source fills; the slots of a source run through pseudorandom permutations of its
blocks, and blocks are joined by index.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from titerflow.llm.common import written
from titerflow.operators.ordering import row_numbers, running_totals
from titerflow.session import shuffle_partitions

BLANKS = " \t\n\x0b\f\r"
GAP = "[\\x20\\x09-\\x0D]+"
#: Rounds of the swap-or-not permutation.
ROUNDS = 24
CHUNK = 4096


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, GAP))).otherwise(0).cast("bigint")


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """The place of ``index`` under a keyed pseudorandom permutation of 0 .. n-1, exact for any n.

    Swap-or-not: each round pairs x with (k - x) mod n, k drawn from the key, and a hash bit of the larger
    one, equal for both, says whether the pair changes places.
    """

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("k"), r, *key), n) - x, n)
        bit = F.xxhash64(F.lit("b"), r, F.greatest(x, other), *key).bitwiseAND(1)
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("bigint"), step)


def source_targets(sizes: DataFrame, weights: Sequence[float], limit: float) -> DataFrame:
    """``source, s, source_size, target``: the sources in code point order (null last) with their shares.

    ``weights`` repeat along the order.  A target above ``limit`` times its source's size stops there and the
    excess is shared by weight among the rest, until no target is above; each round is one aggregate over the
    table of sources, which never leaves the cluster.
    """
    order = [F.col("source").isNull(), F.col("source")]
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = row_numbers(by_source, None, order, "s")
    which = F.array(*[F.lit(float(w)) for w in weights])
    table = written(
        numbered.withColumn("s", F.col("s") - 1)
        .withColumn("w", F.get(which, F.pmod("s", F.lit(len(weights))).cast("int")))
        .select("source", F.col("s").cast("bigint"), "source_size", "w", (F.col("source_size") * float(limit)).alias("cap"))
    )
    level = 0.0
    while True:
        capped = F.col("cap") <= F.col("w") * level
        sums = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("w"))).alias("w"),
        ).first()
        if not sums["w"]:
            break
        new = (sums["all"] - sums["fixed"]) / sums["w"]
        if new <= level:
            break
        level = new
    return table.withColumn("target", F.least("cap", F.col("w") * level)).drop("w", "cap")


#: So many sources' ranges are broadcast at most: a few MB with the bins.
SMALL = 100_000


def shard_counts(sources: DataFrame, all_slots: int, shard_slots: int, bins: int = 4096) -> DataFrame:
    """``shard, s, n, shard_size``: how many slots of each output shard fall to each source, as drawn.

    Every slot of a shard draws a number below ``all_slots``; sources hold ranges of these as long as their
    numbers of slots, so a shard's counts are one multinomial draw by the target weights.  Slots find their range by
    a join on bins of equal width, which the draws fill evenly whatever the sources' sizes.
    """
    spark = sources.sparkSession
    n_shards = -(-all_slots // shard_slots)
    n_sources = sources.count()
    width = max(1, -(-all_slots // max(bins, n_sources)))
    size = F.least(F.lit(shard_slots), F.lit(all_slots) - F.col("id") * shard_slots)
    shards = spark.range(0, n_shards, 1, max(1, min(n_shards, shuffle_partitions(spark))))
    seats = shards.select(F.col("id").alias("shard"), size.alias("shard_size"), F.explode(F.sequence(F.lit(1), size)).alias("seat"))
    drawn = seats.withColumn("u", F.pmod(F.xxhash64(F.lit("draw"), "shard", "seat"), F.lit(max(all_slots, 1))))
    drawn = drawn.withColumn("bin", F.floor(F.col("u") / width))
    low, high = F.col("slot_base"), F.col("slot_base") + F.col("n_slots")
    ranges = sources.where("n_slots > 0").select(
        "s", low.alias("low"), high.alias("high"), F.explode(F.sequence(F.floor(low / width), F.floor((high - 1) / width))).alias("bin")
    )
    # Spark takes exploded slots for as few rows as there are shards and would send them everywhere
    ranges = written(ranges).hint("broadcast" if n_sources <= SMALL else "merge")
    met = drawn.join(ranges, "bin").where("low <= u and u < high")
    return met.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("n"), F.first("shard_size").alias("shard_size"))


def _slots(sources: DataFrame, shard_slots: int) -> DataFrame:
    """``shard, place, s, block`` of every slot of the output, numbered from the shards' drawn counts.

    All shards together draw a source some square root of its slots too often or too seldom.  The surplus slots,
    picked by a permutation, go to the sources that fell short, so that totals are the planned ones.
    """
    all_slots = int(sources.agg(F.sum("n_slots")).first()[0] or 0)
    counts = written(shard_counts(sources, all_slots, shard_slots))
    totals = counts.groupBy("s").agg(F.sum("n").alias("drawn"))
    told = sources.select("s", "n_blocks", "n_slots").join(totals, "s", "left").fillna(0, ["drawn"])
    told = told.withColumns({"over": F.greatest(F.col("drawn") - F.col("n_slots"), F.lit(0)), "short": F.greatest(F.col("n_slots") - F.col("drawn"), F.lit(0))})
    told = written(
        running_totals(told, None, ["s"], ["over", "short"])
        .withColumns({"over_base": F.col("cum_over") - F.col("over"), "short_base": F.col("cum_short") - F.col("short")})
        .select("s", "n_blocks", "n_slots", "drawn", "over_base", "short", "short_base")
    )
    numbered = running_totals(counts, "s", ["shard"], ["n"]).withColumn("before", F.col("cum_n") - F.col("n")).drop("cum_n", "tot_n")
    shard = Window.partitionBy("shard").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = numbered.withColumn("place_base", F.sum("n").over(shard) - F.col("n"))
    dealt = numbered.join(told.drop("short", "short_base"), "s").repartition(shuffle_partitions(sources.sparkSession), "shard", "s")
    each = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    number = F.col("before") + F.col("j")
    turn = F.when(F.col("drawn") > F.col("n_slots"), permuted(number, F.col("drawn"), F.lit("keep"), F.col("s"))).otherwise(number)
    place = permuted(F.col("place_base") + F.col("j"), F.col("shard_size"), F.lit("places"), F.col("shard"))
    each = written(each.select("shard", place.alias("place"), "s", "n_blocks", "n_slots", "over_base", turn.alias("slot")))
    parts = told.where("short > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("short") - 1) / CHUNK))))
    low = F.col("chunk") * CHUNK
    parts = parts.withColumn("k", F.explode(F.sequence(low, F.least(low + CHUNK, F.col("short")) - 1)))
    fills = parts.select((F.col("short_base") + F.col("k")).alias("moved"), "s", "n_blocks", (F.col("drawn") + F.col("k")).alias("slot"))
    moved = each.where("slot >= n_slots").select("shard", "place", (F.col("over_base") + F.col("slot") - F.col("n_slots")).alias("moved"))
    slots = each.where("slot < n_slots").select("shard", "place", "s", "n_blocks", "slot").unionByName(moved.join(fills.hint("merge"), "moved").drop("moved"))
    epoch = F.floor(F.col("slot") / F.col("n_blocks")).cast("bigint")
    return slots.select(
        "shard", "place", "s", permuted(F.pmod("slot", F.col("n_blocks")), F.col("n_blocks"), F.col("s"), epoch).alias("block")
    )


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, limit, block, shard_slots):
    """The rows with their place in their source, the source table, and the slots of all shards."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("tie"),
        F.col(source_col).alias("source"),
        word_count(text).alias("size"),
    )
    rows = written(rows)
    sources = source_targets(rows, weights, limit)
    n_blocks = F.ceil(F.col("source_size") / block)
    wanted = F.when(F.col("source_size") > 0, F.round(F.col("target") * n_blocks / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("n_blocks", n_blocks.cast("bigint")).withColumn(
        "n_slots", F.least(wanted, F.floor(n_blocks * float(limit))).cast("bigint")
    )
    sources = written(
        running_totals(sources, None, ["s"], ["n_slots"])
        .withColumn("slot_base", F.col("cum_n_slots") - F.col("n_slots"))
        .drop("cum_n_slots", "tot_n_slots")
    )
    keyed = rows.join(sources.select("s", F.col("source").alias("named")), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    placed = running_totals(keyed, "s", ["id", "tie"], ["size"]).withColumn("start", F.col("cum_size") - F.col("size")).drop("cum_size", "tot_size")
    return placed, sources, _slots(sources, shard_slots)


def _spans(placed: DataFrame, block: int) -> DataFrame:
    """Each document's share of each of its blocks: ``s, start, block, low, high`` (words of the document)."""
    stop = F.col("start") + F.col("size")
    cut = placed.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((stop - 1) / block)))
    )
    return cut.select(
        "s", "start", "block",
        (F.greatest(F.col("start"), F.col("block") * block) - F.col("start")).alias("low"),
        (F.least(stop, (F.col("block") + 1) * block) - F.col("start")).alias("high"),
    )


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), limit: float = 3, block: int = 64, shard_slots: int = 16_384,
) -> tuple[DataFrame, DataFrame]:
    """Documents with what the mix takes of them, and the mix itself.

    The first frame has, per row of ``docs``: ``doc_id, size, source, source_size, target, taken`` and ``uses``,
    word ranges with the number of times ``n`` each is taken and the ``seats`` (shard, place) it goes to.  The second
    has one row per slot of the output: ``shard, place, source, block``; a block is ``block`` words of its source in
    the order of ids.

    Every shard of ``shard_slots`` slots draws its source counts from a multinomial by the targets.  Free draws miss
    totals by about the square root of a source's slots, so the few surplus slots of all shards go to the sources
    that fell short: totals meet their targets to within half a block.  A source's slots are numbered shard by shard
    from these counts and run through its blocks by one permutation after another, so no block, and no document, is
    taken more than ``limit`` times (rounded up), and reruns agree.

    Null and blank texts have size 0 and nothing is taken of them.  A null source is a source of its own, the
    last.  Repeated rows are separate documents; null ids come first.  An empty table gives empty frames.
    """
    placed, sources, slots = _plan(docs, id_col, text_col, source_col, weights, limit, block, shard_slots)
    placed, slots = written(placed), written(slots)
    used = slots.groupBy("s", "block").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("shard", "place"))).alias("seats")
    )
    taken = (
        _spans(placed, block)
        .join(used.hint("merge"), ["s", "block"])  # its file is small for the lists that it becomes
        .groupBy("s", "start")
        .agg(
            F.sum((F.col("high") - F.col("low")) * F.col("n")).alias("taken"),
            F.array_sort(F.collect_list(F.struct("low", "high", "n", "seats"))).alias("uses"),
        )
        .withColumn("some", F.lit(True))
    )
    named = sources.select("s", "source_size", "target")
    shares = placed.withColumn("some", F.col("size") > 0).join(taken, ["s", "start", "some"], "left").join(named, "s")
    shares = shares.select(
        F.col("id").alias("doc_id"), "tie", "size", "source", F.col("source_size").cast("bigint").alias("source_size"),
        "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "uses",
    )
    return shares, slots.join(sources.select("s", "source"), "s").select("shard", "place", "source", "block")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row per document and pass over it, in shard order.

    A row lies where the mix first takes words of its pass: a partition holds whole shards, its rows follow shard
    and place.  Pass k holds the words taken at least k times, with the white space after them; a document taken whole
    once keeps its text but for leading blanks.  Documents of which nothing is taken go.  Rows equal in id
    and text are planned one by one and share the other columns of one of them.
    """
    placed = _mixed(docs, id_col, text_col, source_col, **options)
    placed = placed.repartition(shuffle_partitions(docs.sparkSession), "_mix_seat.shard")
    return placed.sortWithinPartitions("_mix_seat", id_col).select(*docs.columns)


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, **options) -> DataFrame:
    """``mixed_documents`` in no order, with each row's first seat as ``_mix_seat`` (shard, place)."""
    shares, _ = mixture(docs, id_col, text_col, source_col, **options)
    plan = shares.where("taken > 0").select(
        F.col("doc_id").alias("_mix_id"), F.col("tie").alias("_mix_tie"), F.col("uses").alias("_mix_uses")
    )
    plan = plan.groupBy("_mix_id", "_mix_tie").agg(F.collect_list("_mix_uses").alias("_mix_plans"))
    columns = docs.columns
    keyed = docs.where(F.col(text_col).isNotNull()).withColumns({"_mix_own": F.col(id_col).cast("bigint"), "_mix_key": F.xxhash64(F.col(text_col))})
    once = keyed.groupBy("_mix_own", "_mix_key").count().where("count > 1").limit(1).count() == 0
    if not once:
        keyed = keyed.dropDuplicates(["_mix_own", "_mix_key"])
    joined = keyed.join(plan, keyed["_mix_own"].eqNullSafe(plan["_mix_id"]) & (keyed["_mix_key"] == plan["_mix_tie"]))
    pieces = F.split(F.ltrim(F.col(text_col), F.lit(BLANKS)), "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    # split below the row generators: inside the lambda that cuts ranges out it would run once per range
    joined = joined.withColumn("_mix_words", pieces).withColumn("_mix_uses", F.explode("_mix_plans"))
    most = F.array_max(F.transform("_mix_uses", lambda u: u["n"]))
    passes = joined.withColumn("_mix_pass", F.explode(F.sequence(F.lit(1).cast("bigint"), most)))
    chosen = F.filter("_mix_uses", lambda u: u["n"] >= F.col("_mix_pass"))
    cut = F.transform(
        chosen, lambda u: F.array_join(F.slice("_mix_words", (u["low"] + 1).cast("int"), (u["high"] - u["low"]).cast("int")), "")
    )
    seat = F.array_min(F.transform(chosen, lambda u: F.get(u["seats"], (F.col("_mix_pass") - 1).cast("int"))))
    text = passes.withColumn("_mix_seat", seat).withColumn(text_col, F.array_join(cut, ""))
    if "n_chars" in columns:
        text = text.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return text.select(*columns, "_mix_seat")
