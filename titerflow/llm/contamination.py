"""Benchmark items inside documents: size-partitioned containment MinHash, verified by exact containment.

A short item in a long document has a tiny Jaccard similarity, so signatures of whole documents cannot
find it.  Containment MinHash sketches only the item, by some of its minima, and asks which of them the
document holds.  Items are partitioned by size; a partition's sketch is so large that a document holding the
asked share of an item must hold a known number of its minima.  Pairs that do are candidates, and only these
are compared as whole sets, so the search loses nothing.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from titerflow.llm.common import ID, SUB, arrow_lists, in_slices, map_arrow, same, views, with_key, written
from titerflow.llm.words import SEPARATOR, mix, run_hashes, word_hashes

#: Bits of the filter that documents' shingles pass first: 4 MB whatever the size of the benchmark.
FILTER_BITS = 1 << 25
ORDER_SALT = np.uint64(0xA24BAED4963EE407)


def _text_words(text: np.ndarray | None) -> np.ndarray:
    """Hashes of the lower-cased words, punctuation left out."""
    return np.zeros(0, np.uint64) if text is None else word_hashes(text, lower=True, gap=SEPARATOR)


def sketch_size(n: int, percent: int) -> int:
    """Minima kept of an item of ``n`` shingles: one more than twice what the largest item of its size partition may lack.

    Partitions are powers of two.
    """
    upper = 1 << (n - 1).bit_length()
    return min(n, 2 * may_lack(upper, percent) + 1)


def may_lack(n: int, percent: int) -> int:
    """Shingles of an item of ``n`` that a document holding ``percent`` per cent of them lacks at most."""
    return n * (100 - percent) // 100


def item_shingles(items: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """``item_id, item_sub, size, width, need, shingle, minimum``: the distinct shingles of every item.

    Width is the number of words of a shingle: ``words``, or all words of a shorter item.  An item's minima are its
    first shingles by the number of items that hold them, then by hash, so passages that many items share are not
    searched for where an item has others.  ``need`` of them stand in every document that holds the item.
    """

    def work(batches):
        for batch in in_slices(batches):
            row, size, width, shingle = [], [], [], []
            for k, text in enumerate(views(batch.column(2))):
                w = _text_words(text)
                if len(w) == 0:
                    continue
                s = np.unique(run_hashes(w, min(words, len(w))))
                row.append(np.full(len(s), k))
                size.append(np.full(len(s), len(s)))
                width.append(np.full(len(s), min(words, len(w))))
                shingle.append(s.view(np.int64))
            if not row:
                continue
            n = np.concatenate(size)
            kept = np.array([sketch_size(int(x), percent) for x in n])
            need = kept - np.array([may_lack(int(x), percent) for x in n])
            order = mix(np.concatenate(shingle).view(np.uint64) ^ ORDER_SALT).view(np.int64)
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at)] + [pa.array(x) for x in (n, np.concatenate(width), kept, need, np.concatenate(shingle), order)],
                names=["item_id", "item_sub", "size", "width", "kept", "need", "shingle", "order"],
            )

    source = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.xxhash64(text_col).alias("item_sub"), F.col(text_col).alias("text")).dropDuplicates(["item_id", "item_sub"])
    rows = written(map_arrow(source, work, "item_id bigint, item_sub bigint, size bigint, width bigint, kept bigint, need bigint, shingle bigint, order bigint"))
    holders = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"))
    first = Window.partitionBy("item_id", "item_sub").orderBy("holders", "order", "shingle")  # an item's own shingles
    ranked = rows.join(holders, "shingle").withColumn("minimum", F.row_number().over(first) <= F.col("kept"))
    return ranked.select("item_id", "item_sub", "size", "width", "need", "shingle", "minimum")


def _filters(index: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bit filters of all shingles and of the minima.  Tasks combine theirs by word; 2 x 4 MB reach the driver."""
    slot = F.pmod("shingle", F.lit(FILTER_BITS))
    words = (
        index.select(F.floor(slot / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(shingle, {FILTER_BITS}) % 64 as int))").alias("bit"), "minimum")
        .groupBy("w")
        .agg(F.bit_or("bit").alias("all"), F.coalesce(F.bit_or(F.when(F.col("minimum"), F.col("bit"))), F.lit(0)).alias("low"))
    )
    out = np.zeros((2, FILTER_BITS // 64), np.int64)
    for r in words.toLocalIterator():
        out[:, r["w"]] = r["all"], r["low"]
    bits = np.unpackbits(out.view(np.uint8).reshape(2, -1), axis=1, bitorder="little")
    return np.packbits(bits[0], bitorder="little"), np.packbits(bits[1], bitorder="little")


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", words: int = 5, percent: int = 80,
) -> DataFrame:
    """``doc_id, sub, item_id, item_sub, item_shingles, shared, minima_found, containment`` of every item that a document holds.

    A document holds an item when at least ``percent`` per cent of the item's distinct ``words``-word shingles
    occur in it (A-Z lower-cased, punctuation ignored); an item of fewer words is one shingle of them all.

    Documents' shingles pass bit filters of fixed size.  Those that are an item's minima are joined to these; a pair
    with as many as a holder must have is a candidate, and its whole sets are compared.  Null or empty texts hold
    nothing and are held by nothing.  Repeated rows give one pair per different (id, text); null ids are kept as
    null.  Item rows that repeat id and text count once; of an id with different texts each is an item of its own,
    told apart by ``item_sub``.
    """
    index = written(item_shingles(items, item_col, item_text, words, percent))
    widths = sorted({r["width"] for r in index.select("width").distinct().collect()})  # at most `words` values
    all_bits, low_bits = _filters(index)
    context = docs.sparkSession.sparkContext
    shared_bits = context.broadcast((all_bits, low_bits))  # fixed size
    keyed = with_key(docs, id_col, text_col).select(F.col(ID).alias("id"), F.col(SUB).alias("sub"), F.col(text_col).alias("text"))

    def work(batches):
        every, low = shared_bits.value

        def passes(bits, slot):
            return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in in_slices(batches):
            row, found, minima = [], [], []
            for k, text in enumerate(views(batch.column(2))):
                w = _text_words(text)
                held, lows = [], []
                for width in widths:
                    s = run_hashes(w, width)
                    slot = s & np.uint64(FILTER_BITS - 1)
                    least = passes(low, slot)
                    if least.any():
                        held.append(np.unique(s[passes(every, slot)]))
                        lows.append(np.unique(s[least]))
                if held:
                    row.append(k)
                    found.append(np.concatenate(held).view(np.int64))
                    minima.append(np.concatenate(lows).view(np.int64))
            if row:
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), arrow_lists(found, pa.int64()), arrow_lists(minima, pa.int64())],
                    names=["id", "sub", "found", "minima"],
                )

    held = written(map_arrow(keyed, work, "id bigint, sub bigint, found array<bigint>, minima array<bigint>").dropDuplicates(["id", "sub"]))
    sketches = index.where("minimum").select("shingle", "item_id", "item_sub", "size", "need")
    met = held.select("id", "sub", F.explode("minima").alias("shingle")).join(sketches, "shingle")
    met = met.groupBy("id", "sub", "item_id", "item_sub", "size", "need").agg(F.count(F.lit(1)).alias("minima_found")).where("minima_found >= need")
    sets = index.groupBy("item_id", "item_sub").agg(F.collect_list("shingle").alias("shingles"))  # an item's own
    pairs = met.join(sets, same(met, sets, "item_id", "item_sub")).drop(sets["item_id"]).drop(sets["item_sub"])
    pairs = pairs.join(held.drop("minima"), same(pairs, held, "id", "sub")).drop(held["id"]).drop(held["sub"])
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("shingles", "found")).cast("bigint")).where(F.col("shared") * 100 >= F.col("size") * percent)
    return pairs.select(
        F.col("id").alias("doc_id"), "sub", "item_id", "item_sub", F.col("size").alias("item_shingles"), "shared", "minima_found",
        (F.col("shared") / F.col("size")).alias("containment"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns."""
    bad = contaminated(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias(ID), F.col("sub").alias(SUB)).distinct()
    keyed = with_key(docs, id_col, text_col)
    return keyed.join(bad, same(keyed, bad, ID, SUB), "left_anti").select(*docs.columns)
