"""Near-duplicate documents: MinHash, banding, signature and exact verification, connected components."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerflow.llm.common import arrow_lists, in_slices, map_arrow, views, written
from titerflow.llm.components import connected_components
from titerflow.llm.words import shingle_set

#: With similarity 0.85 a pair shares no band with probability (1 - 0.85**5)**32 < 1e-8.
BANDS, ROWS = 32, 5
SIGNATURE_SLACK = 0.2
#: Members of a bucket that are still compared by a plain join, and shingles of one block of a larger one.
FEW, BLOCK = 24, 500_000
#: Columns that tell different shingle sets apart.
DIGESTS = ("n_shingles", "d1", "d2")


def _hash_parameters(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 31, k, dtype=np.uint64) * 2 + 1).astype(np.uint32), rng.integers(
        0, 1 << 32, k, dtype=np.uint64
    ).astype(np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 512) -> np.ndarray:
    """The minimum of each universal hash a*x + b over the shingles; long texts go through in steps."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), step):
        np.minimum(low, (np.multiply.outer(a, x[at : at + step]) + b[:, None]).min(axis=1), out=low)
    return low


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: id, set size, two digests of the whole shingle set, the MinHash signature (empty without words)."""

    def work(batches):
        a, b = _hash_parameters(bands * rows)
        for batch in in_slices(batches):
            sizes, d1, d2, sig = [], [], [], []
            for text in views(batch.column(1)):
                s = shingle_set(text, words)
                sizes.append(len(s))
                d1.append(int(np.bitwise_xor.reduce(s)) if len(s) else 0)
                d2.append(int(np.add.reduce(s * (s | np.uint64(1)))) if len(s) else 0)
                sig.append(minima(s, a, b).view(np.int32) if len(s) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(d1, np.uint64).view(np.int64)),
                    pa.array(np.array(d2, np.uint64).view(np.int64)),
                    arrow_lists(sig, pa.int32()),
                ],
                names=["id", "n_shingles", "d1", "d2", "sig"],
            )

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(source, work, "id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig array<int>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``id, shingles`` (sorted distinct 64-bit hashes) of documents ``id, text``."""

    def work(batches):
        for batch in in_slices(batches):
            sets = [shingle_set(t, words).view(np.int64) for t in views(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), arrow_lists(sets, pa.int64())], names=["id", "shingles"])

    return map_arrow(docs.select("id", "text"), work, "id bigint, shingles array<bigint>")


def _verified(pairs: DataFrame, marks: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough: signatures (``marks``) rule out, the full ``sets`` decide."""
    side = marks.select("id", "n_shingles", "sig")
    a = side.select(F.col("id").alias("u"), F.col("n_shingles").alias("nu"), F.col("sig").alias("su"))
    b = side.select(F.col("id").alias("v"), F.col("n_shingles").alias("nv"), F.col("sig").alias("sv"))
    equal = F.size(F.filter(F.zip_with("su", "sv", lambda x, y: x == y), lambda e: e))
    near = (
        pairs.join(a, "u")
        .join(b, "v")
        .where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
        .where(equal >= int(total * (percent / 100 - SIGNATURE_SLACK)))
        .select("u", "v")
    )
    near = written(near)
    shared = F.size(F.array_intersect("su", "sv"))
    return written(
        near.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("su")), "u")
        .join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv")), "v")
        .where(shared * 100 >= (F.size("su") + F.size("sv") - shared) * percent)
        .select("u", "v")
    )


def _few(rows: DataFrame) -> DataFrame:
    """All pairs across components of small buckets, those within the rest of a bucket once."""
    left = rows.select("bucket", F.col("id").alias("a"), F.col("c").alias("ca"), "main")
    right = rows.where("c != main").select("bucket", F.col("id").alias("b"), F.col("c").alias("cb"))
    return (
        left.join(right, "bucket")
        .where((F.col("ca") != F.col("cb")) & ((F.col("ca") == F.col("main")) | (F.col("a") < F.col("b"))))
        .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    )


def _many(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components of large buckets, the closest one per member and component it meets.

    A bucket is dealt out in blocks of bounded total set size: members outside the largest component against
    all.  Overlaps are counted inside a task, so unlinked pairs never become rows.
    """
    full = rows.join(sets, "id")
    lefts, rights = F.ceil(F.col("words") / BLOCK).cast("int"), F.ceil(F.col("other_words") / BLOCK).cast("int")
    deal = F.xxhash64("id")
    left = full.withColumn("p", F.pmod(deal, lefts)).withColumn("q", F.explode(F.sequence(F.lit(0), rights - 1)))
    right = full.where("c != main").withColumn("p", F.explode(F.sequence(F.lit(0), lefts - 1))).withColumn("q", F.pmod(deal, rights))
    columns = [F.col("bucket"), F.col("p").cast("long").alias("p"), F.col("q").cast("long").alias("q"), F.col("id"), F.col("c"), F.col("shingles")]
    left, right = left.select(*columns), right.select(*[c.alias("r_" + n) for c, n in zip(columns, ("bucket", "p", "q", "id", "c", "shingles"))])

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        u, v = [], []
        if a.num_rows and b.num_rows:
            flat_b, size_b = _flat(b["r_shingles"])
            order = np.argsort(flat_b, kind="stable")
            owner = np.repeat(np.arange(len(size_b)), size_b)[order]
            known, first = np.unique(flat_b[order], return_index=True)
            often = np.diff(np.append(first, len(flat_b)))
            id_b, c_b = b["r_id"].to_numpy(), b["r_c"].to_numpy()
            flat_a, size_a = _flat(a["shingles"])
            at = np.concatenate([[0], np.cumsum(size_a)])
            for i, (name, c) in enumerate(zip(a["id"].to_pylist(), a["c"].to_pylist())):
                own = flat_a[at[i] : at[i + 1]]
                where = np.searchsorted(known, own)
                where = where[known[np.minimum(where, len(known) - 1)] == own]
                n = often[where]
                hit = owner[np.repeat(first[where] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                shared = np.bincount(hit, minlength=len(id_b))
                union = len(own) + size_b - shared
                good = np.flatnonzero((100 * shared >= percent * union) & (c_b != c))
                good = good[np.argsort(-shared[good] / union[good], kind="stable")]
                good = good[np.unique(c_b[good], return_index=True)[1]]
                u += np.minimum(id_b[good], name).tolist()
                v += np.maximum(id_b[good], name).tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    found = left.groupBy("bucket", "p", "q").cogroup(right.groupBy("r_bucket", "r_p", "r_q")).applyInArrow(compare, "u bigint, v bigint")
    return written(found.distinct())


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the length of each list."""
    lists = column.combine_chunks()
    return np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles
    (A-Z lower-cased); ``component_id`` is the smallest id reachable over links and ``kept`` says that a
    document is that one.

    * Texts with equal sets collapse to one representative before anything is compared.
    * In each band bucket every member is compared with one leader, which differs from band to band.  Only in
      buckets that still hold several components are members then compared across components, those of
      the largest one only with the others; large buckets in blocks that give links, not pairs.
    * Signatures rule pairs out (six standard deviations below the bound), full sets confirm each link.

    Null or empty texts have an empty set: alone in their component.  Rows that share an id are one document:
    its links are those of all its texts.  A row without an id is never linked, gets a null component and
    stays.  Extra columns are ignored, so their names may clash.
    """
    sig = written(signatures(docs, id_col, text_col, words, bands, rows))
    full = sig.where("n_shingles > 0 and id is not null")
    reps = written(
        full.groupBy("n_shingles", "d1", "d2").agg(F.min("id").alias("id"), F.any_value("sig").alias("sig"))
    )
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    # An id with several sets, the empty one among them, stands for one set at a time: give each (id, text) its own node.
    ends = [f(c).alias(n + c) for c in DIGESTS for n, f in (("l", F.min), ("h", F.max))]
    sets_of = sig.where("id is not null").groupBy("id").agg(*ends)
    differ = " or ".join(f"l{c} != h{c}" for c in DIGESTS)
    if sets_of.where(differ).limit(1).count() > 0:
        return _repeated_ids(docs, id_col, text_col, words, percent, bands, rows)
    k = bands * rows
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, rows))))
    banded = reps.select("id", band.alias("bucket"))
    leaders = (
        banded.groupBy("bucket")
        .agg(F.min(F.struct(F.xxhash64("bucket", "id").alias("order"), F.col("id").alias("leader"))).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("bucket", "first.leader")
    )
    members = written(banded.join(leaders, "bucket"))
    first = members.where("id != leader").select(F.least("id", "leader").alias("u"), F.greatest("id", "leader").alias("v")).distinct()
    # Only texts that share a bucket are read again; the ids grow with the table, so this is a merge join at any size.
    ids = written(members.select("id").distinct())
    marks = written(reps.join(ids, "id", "left_semi").select("id", "n_shingles", "sig"))
    sets = written(shingle_sets(texts.join(ids.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), words))
    links = _verified(first, marks, sets, percent, k)
    found = written(connected_components(links))
    # Buckets in which several components meet: compare across components only.
    placed = written(
        members.join(found.withColumnRenamed("node", "id"), "id", "left")
        .join(marks.select("id", "n_shingles"), "id")
        .select("bucket", "id", F.coalesce("component", "id").alias("c"), F.col("n_shingles").alias("size"))
    )
    parts = placed.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    mixed = written(
        parts.groupBy("bucket")
        .agg(
            F.max(F.struct("n", "c", "words")).alias("top"), F.count(F.lit(1)).alias("parts"),
            F.sum("n").alias("n"), F.sum("words").alias("words"),
        )
        .where("parts > 1")
        .select("bucket", F.col("top.c").alias("main"), "n", "words", (F.col("words") - F.col("top.words")).alias("other_words"))
    )
    open_rows = written(placed.join(mixed, "bucket"))
    across = _few(open_rows.where(F.col("n") <= FEW)).unionByName(
        _many(open_rows.where(F.col("n") > FEW), sets, percent)
    )
    more = _verified(across.distinct(), marks, sets, percent, k)
    component = written(connected_components(links.unionByName(more)))
    classes = reps.select("n_shingles", "d1", "d2", F.col("id").alias("rep")).join(
        component.withColumnRenamed("node", "rep"), "rep", "left"
    ).select("n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    return _per_row(sig, classes)


def _per_row(sig: DataFrame, classes: DataFrame) -> DataFrame:
    """Every row of the signatures with the component of its set."""
    rows = sig.select("id", "n_shingles", "d1", "d2")
    keyed = rows.withColumn("n_set", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("n_shingles")))
    joined = keyed.join(classes.withColumnRenamed("n_shingles", "n_set"), ["n_set", "d1", "d2"], "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _repeated_ids(docs, id_col, text_col, words, percent, bands, rows) -> DataFrame:
    """Ids that stand for several different texts: number the different (id, text) pairs, solve, translate back."""
    from titerflow.operators.ordering import row_numbers

    named = docs.where(F.col(id_col).isNotNull())
    source = named.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = source.groupBy("id", "text").count()
    numbered = written(row_numbers(pairs, None, ["id", "text"], "node").select("id", "text", F.col("node").cast("bigint")))
    solved = near_duplicates(numbered, "node", "text", words, percent, bands, rows)
    solved = written(solved.join(numbered.select(F.col("node").alias("doc_id"), "id"), "doc_id"))
    # nodes of one id are one document: join their components
    links = solved.select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    anchor = solved.groupBy("id").agg(F.min("doc_id").alias("first"))
    links = links.unionByName(solved.join(anchor, "id").select(F.col("doc_id").alias("u"), F.col("first").alias("v")))
    comp = connected_components(links)
    named = solved.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    )
    lowest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    final = named.drop("component_id").join(lowest, "component").select(F.col("doc_id").alias("node"), "n_shingles", "component_id")
    joined = source.join(numbered, ["id", "text"], "left").join(final, "node", "left")
    done = joined.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return done.unionByName(near_duplicates(docs.where(F.col(id_col).isNull()), id_col, text_col, words, percent, bands, rows))
