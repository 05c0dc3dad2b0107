"""Ranked lexical search: accumulators from short posting lists, then bounded skipping over the long ones.

Each task turns the documents it holds into a shard of posting lists.  A query first adds up its short lists term
at a time.  The sums then act as one more list, with bounds per block of documents, beside the long lists: blocks
are visited document order, and a block or a document whose bound cannot reach the k best is skipped.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titerflow.llm.common import arrow_lists, in_slices, map_arrow, views, written
from titerflow.llm.words import SEPARATOR, word_hashes

#: Bits of the filter that documents' terms pass first: 4 MB, however many queries there are.
FILTER_BITS = 1 << 25
#: Distinct terms that one pass over the index looks for, about; more queries take more passes.
PASS_TERMS = 1_000_000
#: Documents and postings of a shard at most (but for a longer document), and documents of a block.
SHARD_DOCS, SHARD_POSTINGS, BLOCK = 1 << 15, 1 << 22, 1024
#: A list is short when it holds at most this share of the shard's documents.
SHORT = 1 / 8


def _terms(text: np.ndarray | None) -> np.ndarray:
    """Hashes of the terms in order: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return np.zeros(0, np.uint64) if text is None else word_hashes(text, lower=True, gap=SEPARATOR)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item_id, item_sub, terms, times``: every different row of the queries with its distinct terms."""

    def work(batches):
        for batch in in_slices(batches):
            counted = [np.unique(_terms(t), return_counts=True) for t in views(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), arrow_lists([t.view(np.int64) for t, _ in counted], pa.int64()), arrow_lists([n for _, n in counted], pa.int64())],
                names=["item_id", "item_sub", "terms", "times"],
            )

    rows = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.xxhash64(text_col).alias("item_sub"), F.col(text_col).alias("text")).distinct()
    return map_arrow(rows, work, "item_id bigint, item_sub bigint, terms array<bigint>, times array<bigint>")


def _bit_filter(terms: DataFrame) -> np.ndarray:
    """A bit per slot that a term of the column ``term`` falls in: 4 MB reach the driver."""
    words = terms.groupBy(F.expr(f"cast(pmod(term, {FILTER_BITS}) div 64 as int)").alias("w")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(pmod(term, {FILTER_BITS}) % 64 as int)))").alias("bits")
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["bits"]
    return out.view(np.uint8)


def forward_index(docs: DataFrame, id_col: str, text_col: str, wanted: np.ndarray) -> DataFrame:
    """``id, n, terms, tfs`` of every document with a term; of its terms only those that pass the filter ``wanted``."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # fixed size

    def work(batches):
        bits = shared.value
        for batch in in_slices(batches):
            size, terms, tfs = [], [], []
            for text in views(batch.column(1)):
                every = _terms(text)
                slot = every & np.uint64(FILTER_BITS - 1)
                hit = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                t, n = np.unique(every[hit], return_counts=True)
                size.append(len(every))
                terms.append(t.view(np.int64))
                tfs.append(n)
            made = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), arrow_lists(terms, pa.int64()), arrow_lists(tfs, pa.int64())], names=["id", "n", "terms", "tfs"]
            )
            yield made.filter(pa.array(np.array(size) > 0))

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(source, work, "id bigint, n bigint, terms array<bigint>, tfs array<bigint>")


@dataclass
class Queries:
    """The queries of one pass: their terms as numbers in a sorted vocabulary, and each term's weight."""

    vocabulary: np.ndarray
    weights: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]


@dataclass
class Shard:
    """Posting lists over documents 0 .. size - 1, in ascending order of their ids, with integer contributions."""

    size: int
    first: np.ndarray  # term -> its first posting; one more entry for the end
    rows: np.ndarray
    gains: np.ndarray
    _blocks: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def build(cls, lengths: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, queries: Queries, n_docs: int, n_terms: int) -> Shard:
        at = np.searchsorted(queries.vocabulary, term)
        known = queries.vocabulary[np.minimum(at, len(queries.vocabulary) - 1)] == term
        row, at, tf = row[known], at[known], tf[known]
        order = np.lexsort((row, at))
        row, at, tf = row[order], at[order], tf[order]
        m = 25 + (75 * lengths * n_docs) // n_terms
        gains = queries.weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        return cls(len(lengths), np.searchsorted(at, np.arange(len(queries.vocabulary) + 1)), row, gains)

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each block of documents starts in the term's list, and the largest gain in the block."""
        if term not in self._blocks:
            a, b = self.first[term], self.first[term + 1]
            starts = a + np.searchsorted(self.rows[a:b], np.arange(-(-self.size // BLOCK) + 1) * BLOCK)
            top = np.zeros(len(starts) - 1, np.int64)
            some = np.flatnonzero(starts[1:] > starts[:-1])
            if len(some):
                top[some] = np.maximum.reduceat(self.gains, starts[some])[: len(some)] if b == len(self.gains) else np.maximum.reduceat(self.gains[:b], starts[some])
            self._blocks[term] = starts, top
        return self._blocks[term]

    def best(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` best documents with a score above 0, best first, ties to the smaller row."""
        length = self.first[terms + 1] - self.first[terms]
        short = length <= self.size * SHORT
        sums = np.zeros(-(-self.size // BLOCK) * BLOCK, np.int64)
        for t, q in zip(terms[short].tolist(), times[short].tolist()):  # term at a time
            a, b = self.first[t], self.first[t + 1]
            sums[self.rows[a:b]] += q * self.gains[a:b]
        lists = [(*self.blocks(t), q) for t, q in zip(terms[~short].tolist(), times[~short].tolist())]
        lists.sort(key=lambda x: -x[2] * int(x[1].max()))
        found, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # the k-th sum is a score that k documents have at least
        reached = sums[sums > 0]
        floor = max(1, int(np.partition(reached, -k)[-k])) if len(reached) >= k else 1
        # what the lists from the i-th on can add in each block; the sums are one bounded list like them
        rest = np.zeros((len(lists) + 1, len(sums) // BLOCK), np.int64)
        for i in range(len(lists) - 1, -1, -1):
            rest[i] = rest[i + 1] + lists[i][2] * lists[i][1]
        bound = rest[0] + sums.reshape(-1, BLOCK).max(axis=1)
        for block in np.flatnonzero(bound >= floor).tolist():  # document at a time, in blocks
            if bound[block] < floor:
                continue
            low = block * BLOCK
            total = sums[low : low + BLOCK].copy()
            alive = np.flatnonzero(total + rest[0, block] >= floor)
            for i, (starts, _, q) in enumerate(lists):
                a, b = starts[block], starts[block + 1]
                if a == b:
                    continue
                here = self.rows[a:b] - low
                if 8 * len(alive) < b - a:  # skip through the list to the few documents left
                    at = np.searchsorted(here, alive)
                    hit = here[np.minimum(at, len(here) - 1)] == alive
                    total[alive[hit]] += q * self.gains[a + at[hit]]
                else:
                    total[here] += q * self.gains[a:b]
                alive = alive[total[alive] + rest[i + 1, block] >= floor]
                if not len(alive):
                    break
            alive = alive[total[alive] >= floor]
            if len(alive):
                found, score = np.concatenate([found, alive + low]), np.concatenate([score, total[alive]])
                keep = np.lexsort((found, -score))[:k]
                found, score = found[keep], score[keep]
                if len(found) == k:
                    floor = max(floor, int(score[-1]) + 1)  # a later document with an equal score loses the tie
        return found, score


def _shards(batches):
    """Runs of index rows as they come, of bounded size, joined to one table each."""
    held, docs, postings = [], 0, 0
    for batch in in_slices(batches, 1024):
        held.append(batch)
        docs += batch.num_rows
        postings += len(batch.column(2).flatten())
        if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, docs, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _search(index: DataFrame, queries: Queries, items: pa.Table, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """The ``k`` best documents of every shard for each query of the pass."""
    shared = index.sparkSession.sparkContext.broadcast((queries, items))  # bounded by PASS_TERMS

    def work(batches):
        asked, names = shared.value
        for part in _shards(batches):
            ids = part["id"].combine_chunks()
            order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))  # null ids last
            part = part.take(pa.array(order)).combine_chunks()
            terms, tfs = part["terms"].combine_chunks(), part["tfs"].combine_chunks()
            sizes = np.asarray(terms.value_lengths())
            shard = Shard.build(
                part["n"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes), np.asarray(terms.flatten()).view(np.uint64), np.asarray(tfs.flatten()), asked, n_docs, n_terms
            )
            item, row, score = [], [], []
            for i, (t, n) in enumerate(zip(asked.terms, asked.times)):
                r, s = shard.best(t, n, k)
                item.append(np.full(len(r), i))
                row.append(r)
                score.append(s)
            if item:
                at = pa.array(np.concatenate(item))
                yield pa.RecordBatch.from_arrays(
                    [names["item_id"].combine_chunks().take(at), names["item_sub"].combine_chunks().take(at), part["id"].combine_chunks().take(pa.array(np.concatenate(row))), pa.array(np.concatenate(score))],
                    names=["item_id", "item_sub", "doc_id", "score"],
                )

    return map_arrow(index, work, "item_id bigint, item_sub bigint, doc_id bigint, score bigint")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    pass_terms: int = PASS_TERMS,
) -> DataFrame:
    """``item_id, item_sub, rank, doc_id, score``: the ``k`` best documents of each item, scores above 0 only.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  All counts cover all documents: N
    those with a term, L all their terms, df those that hold a term.  A term weighs ``floor(1000 ln((2 N + 2) / (2 df
    + 1)))`` and adds ``weight * ((10**9 tf) div (1000 tf + 8 m))`` for each time the item holds it, where ``m = 25 +
    (75 n N) div L`` for a document of n terms.  Equal scores rank by ascending id, null ids last.

    The result is exact: bounds only skip what cannot be among the best.  Documents are dealt to shards by hash and
    every shard returns its ``k`` best; Spark's window keeps ``k`` of them per task before it shuffles.  Items are
    searched in passes of about ``pass_terms`` distinct terms over the written index.

    Null, empty or punctuation-only texts match nothing; items without a match have no row.  Every row of the
    documents is a document, also where rows or ids repeat.  Item rows that repeat id and text count once; of an id
    with different texts each is an item of its own, told apart by ``item_sub``.
    """
    spark = docs.sparkSession
    asked = written(item_terms(items, item_col, item_text).where(F.size("terms") > 0))
    vocabulary = asked.select(F.explode("terms").alias("term"))
    index = written(forward_index(docs, id_col, text_col, _bit_filter(vocabulary)))
    totals = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("postings")).first()
    out = "item_id bigint, item_sub bigint, rank int, doc_id bigint, score bigint"
    sizes = asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"]
    if not sizes or not totals["docs"]:
        return spark.createDataFrame([], out)
    holding = index.select(F.explode("terms").alias("term")).groupBy("term").count()
    holding = written(holding.join(vocabulary.distinct(), "term"))
    shards = max(spark.sparkContext.defaultParallelism, math.ceil(totals["docs"] / SHARD_DOCS), math.ceil(totals["postings"] / SHARD_POSTINGS))
    index = index.repartition(shards, F.xxhash64("id", "n", "terms"))
    passes = math.ceil(sizes / pass_terms)
    found = None
    for p in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "item_sub"), F.lit(passes)) == p)
        if passes > 1 and not mine.limit(1).count():
            continue
        rows = mine.toArrow().combine_chunks()  # about pass_terms terms
        known = holding.join(mine.select(F.explode("terms").alias("term")).distinct(), "term").toArrow()
        term, df = known["term"].to_numpy().view(np.uint64), known["count"].to_numpy()
        order = np.argsort(term)
        if not len(order):
            continue
        n_docs = int(totals["docs"])
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df[order]], np.int64)
        terms, times = [], []
        for t, n in zip(rows["terms"].to_pylist(), rows["times"].to_pylist()):
            t, n = np.array(t, np.int64).view(np.uint64), np.array(n, np.int64)
            at = np.minimum(np.searchsorted(term[order], t), len(term) - 1)
            hit = term[order][at] == t
            terms.append(at[hit])
            times.append(n[hit])
        part = _search(index, Queries(term[order], weights, terms, times), rows.select(["item_id", "item_sub"]), k, n_docs, int(totals["terms"]))
        part = part if passes == 1 else written(part)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], out)
    order = Window.partitionBy("item_id", "item_sub").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "item_sub", "rank", "doc_id", "score")
