"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue."""
from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from titerflow.llm.common import in_slices, map_arrow, written


#: Taking a query to one more leaf costs about as much as comparing it with so many rows.
VISIT = 1024
#: Vector components of a leaf at most when leaves are made larger.
LEAF_VALUES = 4_000_000


@dataclass
class Forest:
    """Trees in heap order.  All nodes of one depth of a tree share a random direction; each has its own cut."""

    directions: np.ndarray  # trees x depth x dimension
    cuts: np.ndarray  # trees x (2**depth - 1)

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def project(self, x: np.ndarray) -> np.ndarray:
        """rows x trees x depth"""
        t, d, k = self.directions.shape
        return (x @ self.directions.reshape(t * d, k).T).reshape(len(x), t, d)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        p = self.project(x)
        node = np.zeros((len(x), len(self.cuts)), np.int64)
        tree = np.arange(len(self.cuts))
        for level in range(self.depth):
            node = 2 * node + 1 + (p[:, :, level] > self.cuts[tree, node])
        return node - (2**self.depth - 1)

    def visits(self, projections: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """All leaves with rows for one query, best first over all trees: tree, leaf, rows in the leaves before.

        The queue's key is the smallest margin by which the query missed a cut on the way, as it is shared by
        all trees the most doubtful decision anywhere is revised next.
        """
        inner = 2**self.depth - 1
        queue = [(-math.inf, t, 0, 0) for t in range(len(self.cuts))]
        heapq.heapify(queue)
        seen = 0
        while queue:
            worst, t, node, level = heapq.heappop(queue)
            while node < inner:
                gap = projections[t, level] - self.cuts[t, node]
                near, far = (2 * node + 2, 2 * node + 1) if gap > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(worst, abs(gap)), t, far, level + 1))
                node, level = near, level + 1
            leaf = node - inner
            if sizes[t, leaf]:
                yield t, leaf, seen
                seen += int(sizes[t, leaf])

    def search(self, projections: np.ndarray, sizes: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) for one query, best first, until they hold ``enough`` rows."""
        return [(t, n) for t, n, _ in itertools.takewhile(lambda visit: visit[2] < enough, self.visits(projections, sizes))]

    def needed(self, projections: np.ndarray, sizes: np.ndarray, homes: np.ndarray) -> list[int]:
        """For each row of ``homes`` (its leaf in every tree) the least ``enough`` with which a search meets it."""
        lost = {}
        for i, row in enumerate(homes):
            for place in enumerate(row.tolist()):
                lost.setdefault(place, set()).add(i)
        out = [0] * len(homes)
        left = len(homes)
        for t, n, seen in self.visits(projections, sizes) if left else ():
            for i in lost.get((t, n), ()):
                if not out[i]:
                    out[i] = seen + 1
                    left -= 1
            if not left:
                break
        return out

    def cut_at(self, depth: int) -> Forest:
        """The same trees with fewer levels."""
        return Forest(self.directions[:, :depth], self.cuts[:, : 2**depth - 1])


def grow_forest(sample: np.ndarray, n_rows: int, dimension: int, trees: int, leaf: int, seed: int) -> Forest:
    """Cuts at the medians of the sample; as deep as ``n_rows`` rows need for leaves of about ``leaf`` rows."""
    depth = max(0, math.ceil(math.log2(max(n_rows, 1) / leaf)))
    depth = min(depth, max(0, int(math.log2(max(len(sample), 1) / 4))))
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, depth, dimension))
    directions /= np.maximum(np.linalg.norm(directions, axis=2, keepdims=True), 1e-12)
    cuts = np.zeros((trees, 2**depth - 1))
    for t in range(trees):
        p = sample @ directions[t].T if len(sample) else np.zeros((0, depth))
        members = {0: np.arange(len(sample))}
        for level in range(depth):
            lower = {}
            for node, rows in members.items():
                v = p[rows, level]
                cut = float(np.median(v)) if len(v) else 0.0
                cuts[t, node] = cut
                lower[2 * node + 1], lower[2 * node + 2] = rows[v <= cut], rows[v > cut]
            members = lower
    return Forest(directions, cuts)


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return np.asarray(values.flatten(), float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` (doubles) of the rows that take part: no null, zero or non-finite vector, and of the dimension
    that most of them have (the smaller one of equals)."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
    )
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    top = rows.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), "k").limit(1).collect()
    return rows.where(F.size("v") == (top[0]["k"] if top else 0))


def _fit_budget(
    forest: Forest, sizes: np.ndarray, indexed: DataFrame, classes: DataFrame, ids: DataFrame, asked: DataFrame,
    k: int, enough: int, aim: float, probes: int, dimension: int,
) -> dict:
    """Depth, rows to see and share met, by the true neighbours of a few queries.

    A probe's true neighbours come from one pass over all vectors; how many rows a search sees before it meets
    each is counted, for all depths at once, so the budget that meets the share ``aim`` is read off.
    """
    picked = asked.orderBy(F.xxhash64(F.lit("probe"), "id"), "id").limit(probes).toArrow().combine_chunks()
    if not picked.num_rows:
        return {}
    names = picked["id"].to_numpy()
    x = np.asarray(picked["v"].combine_chunks().flatten(), float).reshape(len(names), -1)
    known = np.arange(len(names))[:, None]

    def compare(batches):
        best, reps = np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)
        for batch in in_slices(batches, 4096):
            best = np.hstack([best, x @ _matrix(batch, 1).T])
            reps = np.hstack([reps, np.broadcast_to(batch.column(0).to_numpy(), (len(names), batch.num_rows))])
            if best.shape[1] > k + 1:
                top = np.argpartition(-best, k, axis=1)[:, : k + 1]
                best, reps = best[known, top], reps[known, top]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names, best.shape[1])), pa.array(reps.ravel()), pa.array(best.ravel())], names=["query_id", "rep", "rough"]
        )

    close = map_arrow(classes.select("rep", "v"), compare, "query_id bigint, rep bigint, rough double")
    first = Window.partitionBy("query_id")
    close = close.withColumn("r", F.row_number().over(first.orderBy(F.desc("rough"), "rep"))).where(F.col("r") <= k + 1)
    true = close.join(ids, "rep").where("query_id != id")
    true = true.withColumn("r", F.row_number().over(first.orderBy(F.desc("rough"), "id"))).where(F.col("r") <= k)
    true = written(true.select("query_id", "rep", "id"))
    homes = true.join(indexed.select("rep", "tree", "leaf"), "rep").select("query_id", "id", "tree", "leaf")
    trees, rows = len(sizes), int(sizes[0].sum())
    depths = [d for d in range(forest.depth, -1, -1) if d == forest.depth or rows / 2**d * dimension <= LEAF_VALUES]
    where = {int(n): i for i, n in enumerate(names)}

    def count(group: pa.Table) -> pa.Table:
        query = x[where[group["query_id"][0].as_py()]]
        p = forest.project(np.append(query, 0.0)[None, :])[0]
        _, at = np.unique(group["id"].to_numpy(), return_inverse=True)
        own = np.zeros((at.max() + 1, trees), np.int64)
        own[at, group["tree"].to_numpy()] = group["leaf"].to_numpy()
        out = [forest.cut_at(d).needed(p, sizes.reshape(trees, 2**d, -1).sum(axis=2), own >> (forest.depth - d)) for d in depths]
        return pa.table({"depth": np.repeat(depths, len(own)), "rows": np.concatenate(out)})

    met = homes.groupBy("query_id").applyInArrow(count, "depth bigint, rows bigint").toArrow().combine_chunks()
    if not met.num_rows:
        return {}
    level, seen = met["depth"].to_numpy(), met["rows"].to_numpy()
    choices = []
    for d in depths:
        found = np.sort(seen[level == d])
        budget = max(enough, int(found[math.ceil(aim * len(found)) - 1]))
        leaf = rows / 2**d  # the last one counts whole
        choices.append(((budget + leaf) * (1 + VISIT / leaf), -d, budget, float((found <= budget).mean())))
    _, d, budget, share = choices[0] if choices[0][2] == enough else min(choices)
    return {"depth": -d, "enough": budget, "met": share}


def nearest(
    vectors: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    trees: int = 16, leaf: int = 512, enough: int = 40_000, sample: int = 200_000, seed: int = 11, block: int = 2048,
    sample_bytes: int = 128 << 20,
    aim: float = 0.95, probes: int = 256, report: dict | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``is_query`` (over the column ``id``) its ``k`` rows of
    largest inner product found, best first, ties to the smaller id, itself left out.

    The forest's cuts are medians over about ``sample`` different vectors, or ``sample_bytes`` of them, at most, picked
    by hash; every row is indexed: an index row holds tree, leaf and id, vectors are kept once.  Inner products are searched as distances: a vector gets one more component that
    makes all lengths equal, a query gets 0 there.  A query's leaves are picked best first from one queue over
    all trees until they hold ``enough`` rows, counted in each tree (if there are no more, this is exact), and
    the rows in them are ranked exactly in double precision.

    ``enough`` is a least number.  Where it is less than all rows, ``probes`` queries picked by hash are compared
    with every row, and it grows until searches meet the share ``aim`` of these queries' true neighbours.  Then
    leaves may become larger too, whichever depth compares and ships least.  ``report`` takes what was chosen:
    rows (different vectors), depth, enough, and the share of the probes' true neighbours met (None if exact).

    Equal vectors are indexed once and stand for their ``k + 1`` smallest ids, which is all that any query
    can return of them; a leaf asked for by many queries is searched in blocks of about ``block`` queries.
    Null ids and vectors that are null, zero, of another dimension or hold null or non-finite components take
    no part.  Rows that repeat id and vector count once.  Fewer candidates give fewer rows.
    """
    rows = usable_vectors(vectors, id_col, vec_col).distinct()
    rows = written(rows.withColumn("h", F.xxhash64("v")))
    order = Window.partitionBy("h", "v").orderBy("id")
    few = written(rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1))
    classes = written(few.where("n = 1").select(F.col("id").alias("rep"), "v", "h"))
    ids = few.join(classes.select("rep", "h", F.col("v").alias("w")), "h").where(F.col("v") == F.col("w")).select("rep", "id")
    ids = written(ids)
    stats = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("k"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    longest = stats["m"] or 0.0
    share = min(1.0, min(sample, sample_bytes // (8 * max(stats["k"] or 1, 1))) / max(stats["n"], 1))
    picked = classes.where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40))).select("v").toArrow()
    base = np.zeros((0, 1))
    if picked.num_rows:
        base = np.asarray(picked["v"].combine_chunks().flatten(), float).reshape(picked.num_rows, -1)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))[:, None]])

    forest = grow_forest(lifted(base), stats["n"], base.shape[1] + 1, trees, leaf, seed)

    def place(batches):
        for batch in in_slices(batches, 4096):
            where = forest.leaves(lifted(_matrix(batch, 1)))
            for t in range(trees):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, t), pa.int32()), pa.array(where[:, t]), batch.column(0)],
                    names=["tree", "leaf", "rep"],
                )

    indexed = written(map_arrow(classes.select("rep", "v"), place, "tree int, leaf bigint, rep bigint"))
    sizes = np.zeros((trees, 2**forest.depth), np.int64)
    for r in indexed.groupBy("tree", "leaf").count().collect():  # as many as the forest has leaves
        sizes[r["tree"], r["leaf"]] = r["count"]

    asked = rows.where(is_query).select("id", "v")
    fitted = {"rows": stats["n"], "depth": forest.depth, "enough": enough, "met": None}
    if enough < trees * stats["n"]:
        fitted |= _fit_budget(forest, sizes, indexed, classes, ids, asked, k, enough, aim, probes, base.shape[1])
    enough, full_depth = fitted["enough"], forest.depth
    if report is not None:
        report.update(fitted)
    if fitted["depth"] < full_depth:
        forest = forest.cut_at(fitted["depth"])
        sizes = sizes.reshape(trees, 2**forest.depth, -1).sum(axis=2)
        indexed = indexed.withColumn("leaf", F.shiftright("leaf", full_depth - forest.depth))

    def visit(batches):
        for batch in in_slices(batches, 1024):
            x = _matrix(batch, 1)
            p = forest.project(np.hstack([x, np.zeros((len(x), 1))]))
            picks = [forest.search(p[i], sizes, enough) for i in range(len(x))]
            row = np.repeat(np.arange(len(x)), [len(q) for q in picks])
            flat = [pair for q in picks for pair in q]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in flat], pa.int32()), pa.array([n for _, n in flat], pa.int64()), batch.column(0).take(pa.array(row))],
                names=["tree", "leaf", "id"],
            )

    visits = written(map_arrow(asked, visit, "tree int, leaf bigint, id bigint"))
    blocks = written(visits.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    parts = blocks.select(F.col("tree").alias("t"), F.col("leaf").alias("l"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p"))
    # vectors are stored once and fetched for visited leaves only
    spread = indexed.join(parts, (indexed["tree"] == parts["t"]) & (indexed["leaf"] == parts["l"])).select("t", "l", "p", "rep")
    spread = spread.join(classes.select("rep", "v"), "rep")
    dealt = visits.join(asked, "id").join(blocks, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c = left.combine_chunks(), right.combine_chunks()
        out_q, out_c, out_s = [], [], []
        if q.num_rows and c.num_rows:
            a = np.asarray(q["v"].combine_chunks().flatten(), float).reshape(q.num_rows, -1)
            b = np.asarray(c["v"].combine_chunks().flatten(), float).reshape(c.num_rows, -1)
            reps, names = c["rep"].to_numpy(), q["id"].to_numpy()
            for at in range(0, len(a), 256):
                s = a[at : at + 256] @ b.T
                keep = min(k + 1, s.shape[1])
                best = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
                i, j = np.nonzero(s >= best[:, None] - 1e-9)  # ties stay until the exact ranking
                out_q.append(names[at + i])
                out_c.append(reps[j])
                out_s.append(s[i, j])
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"query_id": cat(out_q, np.int64), "rep": cat(out_c, np.int64), "rough": cat(out_s, float)})

    map_arrow(classes.limit(0).select("rep"), lambda batches: batches, "rep bigint")  # sends the code
    found = dealt.groupBy("tree", "leaf", "part").cogroup(spread.groupBy("t", "l", "p")).applyInArrow(
        rank, "query_id bigint, rep bigint, rough double"
    )
    # every query's best classes, with some to spare for rounding and for the query's own row
    best = Window.partitionBy("query_id").orderBy(F.desc("rough"), "rep")
    found = written(found.groupBy("query_id", "rep").agg(F.max("rough").alias("rough")))
    top = found.withColumn("r", F.rank().over(best.orderBy(F.desc(F.round("rough", 9))))).where(F.col("r") <= k + 3)
    pairs = top.select("query_id", "rep").join(ids, "rep").where("query_id != id")
    exact = (
        pairs.join(rows.select(F.col("id").alias("query_id"), F.col("v").alias("x")), "query_id")
        .join(classes.select("rep", F.col("v").alias("y")), "rep")
        .withColumn("score", F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p))
    )
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        exact.withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
    )

