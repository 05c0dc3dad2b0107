"""Random forests of all targets, grown together.

Vectors are cut into bins once and packed into blocks.  While a node of a tree holds many rows, tasks add up histograms of
its rows and a small grouped step chooses the split; a node of at most ``LIMIT`` rows is grown to its leaves by one
task.  A forest is a table: the tops of its trees, and a row per piece grown below them.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerflow.functions.columns import clip_probability
from titerflow.models.native import MIN_ROWS, trainable_targets
from titerflow.models.partials import SALTS, array_column, fewer, matrix
from titerflow.operators.joins import attach
from titerflow.operators.scaling import imbalance
from titerflow.session import materialize, ship, shuffle_partitions, spread

BINS = 32
#: Rows of a block, and rows of a node from which on one task grows it.
BLOCK = 1 << 13
LIMIT = 1 << 13
#: What a top node is: still to be split by histograms, split, a leaf, or the root of a piece.
OPEN, SPLIT, LEAF, PIECE = range(4)
#: Poisson(1): the chance of at most 0, 1, 2, ... draws of a row by a tree.
_DRAWS = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880], float))
_TREE = "tree: int, feature: array<int>, cut: array<int>, left: array<int>, depth: array<int>, kind: array<int>, p: array<double>"
_COLUMNS = [c.split(":")[0] for c in _TREE.split(", ")]
_TYPES = dict(zip(_COLUMNS, [c.split(": ")[1] for c in _TREE.split(", ")]))


@dataclass
class Forest:
    """``edges`` (``_k, edges``) cuts vectors into bins, ``tops`` has a row per tree, ``pieces`` one per node grown in a task."""

    edges: DataFrame
    tops: DataFrame
    pieces: DataFrame


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def drawn(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's bootstrap draws each row: Poisson(1) by the hash of the row's id, whatever the partitioning."""
    salt = _mixed(np.array([seed * 1_000_003 + tree]))
    u = (_mixed(ids.view(np.uint64) ^ salt) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_DRAWS, u, side="right")


def _features(seed: int, k: int, tree: int, node: int, count: int, width: int, per: int) -> np.ndarray:
    """The features that ``count`` nodes may split on, ``per`` different ones each; of equal splits the first is taken."""
    rng = np.random.default_rng([seed, k & (2**63 - 1), tree, node])
    return np.sort(rng.random((count, width)).argpartition(per - 1, axis=1)[:, :per], axis=1)


def _best(pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot, bin and gain of the best split of each node by Gini impurity; ``pos, neg`` are (node, slot, bin) weights."""
    lp, ln = pos.cumsum(axis=2), neg.cumsum(axis=2)
    p, n = lp[:, :1, -1:], ln[:, :1, -1:]
    rp, rn = p - lp, n - ln
    least = 1e-9 * (p + n)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * n / (p + n) - lp * ln / (lp + ln) - rp * rn / (rp + rn)
    gain = np.where((lp + ln > least) & (rp + rn > least), gain, -np.inf).reshape(len(pos), -1)
    at = gain.argmax(axis=1)
    found = gain[np.arange(len(at)), at]
    return at // pos.shape[2], at % pos.shape[2], np.where(found > least[:, 0, 0], found, 0.0)


def _cells(x: np.ndarray, node: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The histogram cell of each row and slot of its node."""
    per = features.shape[1]
    return (node[:, None] * per + np.arange(per)) * BINS + np.take_along_axis(x, features[node], axis=1)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, max_depth: int, per: int, draw) -> tuple[np.ndarray, ...]:
    """A whole tree, level by level: ``feature, cut, left, p``; ``left`` -1 is a leaf, the right child follows the left one.

    ``draw(node, count)`` gives the features of ``count`` nodes from ``node`` on.
    """
    feature, cut, left, p = [], [], [], []
    rows, node, size, made = np.arange(len(x)), np.zeros(len(x), np.int64), 1, 1
    while size:
        wy = w[rows] * y[rows]
        pos, neg = np.bincount(node, wy, size), np.bincount(node, w[rows] - wy, size)
        first = made - size
        f, c, l = np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        least = 1e-9 * (pos + neg)
        open_ = np.flatnonzero((pos > least) & (neg > least)) if depth < max_depth else np.zeros(0, int)
        p.append(pos / (pos + neg))
        split = open_[:0]
        if len(open_):
            seat = np.full(size, -1)
            seat[open_] = np.arange(len(open_))
            inside = seat[node] >= 0
            rows, node = rows[inside], seat[node[inside]]
            features = draw(first, len(open_))
            cells = _cells(x[rows], node, features).ravel()
            shape, many = (len(open_), per, BINS), features.shape[1]
            wy = w[rows] * y[rows]
            slot, at, gain = _best(*(np.bincount(cells, np.repeat(v, many), len(open_) * per * BINS).reshape(shape) for v in (wy, w[rows] - wy)))
            good = gain > 0
            split = open_[good]
            f[split], c[split] = features[good, slot[good]], at[good]
            l[split] = made + 2 * np.arange(len(split))
            rank = np.full(len(open_), -1)
            rank[good] = np.arange(len(split))
            inside = good[node]
            rows, node = rows[inside], open_[node[inside]]
            right = x[rows, f[node]] > c[node]
            node = l[node] - made + right
        feature.append(f), cut.append(c), left.append(l)
        size = 2 * len(split)
        made += size
        depth += 1
    return tuple(np.concatenate(a) for a in (feature, cut, left, p))


def _routed(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node without children that each row reaches."""
    at = np.zeros(len(x), np.int64)
    moving = np.arange(len(x)) if left[0] >= 0 else np.zeros(0, np.int64)
    while len(moving):
        here = at[moving]
        at[moving] = left[here] + (x[moving, feature[here]] > cut[here])
        moving = moving[left[at[moving]] >= 0]
    return at


def bin_edges(rows: DataFrame, vector: str = "v") -> DataFrame:
    """``_k, edges``: per feature the least value and the quantiles that cut the rows of ``_k`` into ``BINS`` bins."""
    cells = rows.select("_k", F.posexplode(vector).alias("f", "x"))
    cuts = cells.groupBy("_k", "f").agg(F.percentile_approx("x", [i / (BINS - 1) for i in range(BINS - 1)], 10_000).alias("q"))
    return cuts.groupBy("_k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("f", "q"))), lambda s: s["q"])).alias("edges"))


def _blocks(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``_k, ids, x, y, w``: rows ``_k, id, v, y, w`` with binned vectors, as bytes of at most ``BLOCK`` rows."""

    def pack(batches):
        held: dict[int, list] = {}

        def block(k):
            parts = [np.concatenate(p) for p in zip(*held.pop(k))]
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=["_k", "ids", "raw", "y", "w"])

        for batch in batches:
            ks, x = batch["_k"].to_numpy(), matrix(batch, "v")
            columns = [batch[c].to_numpy() for c in ("id", "y", "w")]
            for k in np.unique(ks).tolist():
                mine = np.flatnonzero(ks == k)
                for some in np.array_split(mine, -(-len(mine) // BLOCK)):
                    if sum(len(p[0]) for p in held.get(k, [])) + len(some) > BLOCK:
                        yield block(k)
                    held.setdefault(k, []).append((columns[0][some], x[some], columns[1][some], columns[2][some]))
        for k in list(held):
            yield block(k)

    def cut(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                at = matrix(one, "edges").reshape(-1, BINS - 1)
                raw = np.frombuffer(one["raw"][0].as_py()).reshape(-1, len(at))
                x = np.stack([np.searchsorted(at[f], raw[:, f]) for f in range(len(at))], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([one["_k"], one["ids"], pa.array([x.tobytes()], pa.binary()), one["y"], one["w"]], names=["_k", "ids", "x", "y", "w"])

    packed = spread(rows.select("_k", "id", "v", "y", "w"), "id").mapInArrow(pack, "_k bigint, ids binary, raw binary, y binary, w binary")
    return materialize(packed.join(edges, "_k").mapInArrow(cut, "_k bigint, ids binary, x binary, y binary, w binary"))


def _with_trees(blocks: DataFrame, tops: DataFrame) -> DataFrame:
    """Every block beside the tops of its target's trees."""
    return blocks.join(tops.groupBy("_k").agg(F.collect_list(F.struct(*_COLUMNS)).alias("trees")), "_k").repartition(max(blocks.rdd.getNumPartitions(), shuffle_partitions(blocks.sparkSession)))


def _each(batch: pa.RecordBatch):
    """``k, ids, x, y, w, trees`` of each block of a batch."""
    for r in range(batch.num_rows):
        one = batch.slice(r, 1)
        ids, y, w = (np.frombuffer(one[c][0].as_py(), t) for c, t in (("ids", np.int64), ("y", np.float64), ("w", np.float64)))
        x = np.frombuffer(one["x"][0].as_py(), np.uint8).reshape(len(ids), -1)
        yield one["_k"][0].as_py(), ids, x, y, w, one["trees"].flatten()


def _top(trees: pa.StructArray, i: int) -> dict:
    one = trees.slice(i, 1)
    return {c: one.field(j)[0].as_py() if c == "tree" else np.asarray(one.field(j).flatten()) for j, c in enumerate(_COLUMNS)}


def _top_row(k: int, top: dict) -> pa.Table:
    kinds = {"array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return pa.table({"_k": pa.array([k], pa.int64()), **{c: pa.array([top[c]], pa.int32()) if c == "tree" else pa.array([np.asarray(top[c]).tolist()], kinds[_TYPES[c]]) for c in _COLUMNS}})


_TOP_SCHEMA = "_k bigint, " + _TREE.replace(":", "")


def _split_tops(blocks: DataFrame, tops: DataFrame, per: int, max_depth: int, limit: int, seed: int) -> DataFrame:
    """One more level of every top: histograms of its open nodes are added up over all blocks, then nodes are split."""

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for k, ids, x, y, w, trees in _each(batch):
                for i in range(len(trees)):
                    top = _top(trees, i)
                    open_ = np.flatnonzero(top["kind"] == OPEN)
                    if not len(open_):
                        continue
                    bag = drawn(ids, top["tree"], seed)
                    seat = np.full(len(top["kind"]), -1)
                    seat[open_] = np.arange(len(open_))
                    rows = np.flatnonzero(bag)
                    node = seat[_routed(x[rows], top["feature"], top["cut"], top["left"])]
                    rows, node = rows[node >= 0], node[node >= 0]
                    share = min(per, x.shape[1])
                    features = np.concatenate([_features(seed, k, top["tree"], int(a), 1, x.shape[1], share) for a in open_])
                    cells = _cells(x[rows], node, features).ravel()
                    weight = w[rows] * bag[rows]
                    one = np.concatenate([np.bincount(cells, np.repeat(v, share), len(open_) * share * BINS) for v in (weight * y[rows], weight * (1 - y[rows]), np.ones(len(rows)))])
                    key = (k, top["tree"])
                    sums[key] = sums[key] + one if key in sums else one
        if sums:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in sums], pa.int64()), pa.array([t for _, t in sums], pa.int32()), pa.array([task] * len(sums), pa.int64()), array_column([*sums.values()])],
                names=["_k", "tree", "_task", "sums"],
            )

    def split(partial: pa.Table, own: pa.Table) -> pa.Table:
        own = own.rename_columns([c[2:] for c in own.column_names])
        k = own["_k"][0].as_py()
        top = {c: own[c][0].as_py() if c == "tree" else np.asarray(own[c][0].as_py()) for c in _COLUMNS}
        open_ = np.flatnonzero(top["kind"] == OPEN)
        if not partial.num_rows or not len(open_):  # no row was drawn
            top["kind"] = np.where(top["kind"] == OPEN, LEAF, top["kind"])
            return _top_row(k, top)
        sums = matrix(partial, "sums").sum(axis=0).reshape(3, len(open_), -1, BINS)
        slot, at, gain = _best(sums[0], sums[1])
        nodes = {c: top[c].tolist() for c in _COLUMNS if c != "tree"}
        width = own["width"][0].as_py()
        for i, a in enumerate(open_.tolist()):
            pos, neg, n = (s[i, 0].sum() for s in sums)
            nodes["p"][a] = pos / (pos + neg) if n else nodes["p"][a]
            pure = min(pos, neg) <= 1e-9 * (pos + neg)
            if pure or nodes["depth"][a] >= max_depth:
                nodes["kind"][a] = LEAF
            elif n <= limit:
                nodes["kind"][a] = PIECE
            elif gain[i] <= 0:
                nodes["kind"][a] = LEAF
            else:
                nodes["kind"][a] = SPLIT
                nodes["feature"][a] = int(_features(seed, k, top["tree"], a, 1, width, sums.shape[2])[0, slot[i]])
                nodes["cut"][a], nodes["left"][a] = int(at[i]), len(nodes["p"])
                for side in (slice(0, at[i] + 1), slice(at[i] + 1, BINS)):
                    pos, neg, n = (s[i, slot[i], side].sum() for s in sums)
                    pure = min(pos, neg) <= 1e-9 * (pos + neg) or nodes["depth"][a] + 1 >= max_depth
                    new = {"feature": -1, "cut": -1, "left": -1, "depth": nodes["depth"][a] + 1, "p": pos / (pos + neg), "kind": LEAF if pure else PIECE if n <= limit else OPEN}
                    for c, v in new.items():
                        nodes[c].append(v)
        return _top_row(k, {"tree": top["tree"], **nodes})

    still = tops.where(F.array_contains("kind", OPEN))
    joined = _with_trees(blocks, still.drop("width"))
    partial = joined.mapInArrow(add, "_k bigint, tree int, _task bigint, sums array<double>")
    partial = fewer(partial, ["_k", "tree"]) if joined.rdd.getNumPartitions() > SALTS else partial.drop("_task")
    own = still.select(*[F.col(c).alias(f"s_{c}") for c in still.columns])
    moved = partial.groupBy("_k", "tree").cogroup(own.groupBy("s__k", "s_tree")).applyInArrow(split, _TOP_SCHEMA)
    moved = moved.join(tops.select("_k", "width").distinct(), "_k")
    return materialize(moved.unionByName(tops.where(~F.array_contains("kind", OPEN))))


def _dealt(blocks: DataFrame, tops: DataFrame, bagged: bool, seed: int) -> DataFrame:
    """Rows of every tree by the piece they fall into: ``_k, tree, node, depth, ids, x, y, w``, and ``p`` where the top has a leaf."""

    def deal(batches):
        for batch in batches:
            for k, ids, x, y, w, trees in _each(batch):
                for i in range(len(trees)):
                    top = _top(trees, i)
                    rows, weight = np.arange(len(ids)), w
                    if bagged:
                        bag = drawn(ids, top["tree"], seed)
                        rows, weight = np.flatnonzero(bag), w * bag
                    at = _routed(x[rows], top["feature"], top["cut"], top["left"])
                    if bagged:
                        rows, at = rows[top["kind"][at] == PIECE], at[top["kind"][at] == PIECE]
                    order = np.argsort(at, kind="stable")
                    rows, at = rows[order], at[order]
                    nodes, starts = np.unique(at, return_index=True)
                    if not len(nodes):
                        continue
                    parts = np.split(rows, starts[1:])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k] * len(nodes), pa.int64()), pa.array([top["tree"]] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()), pa.array(top["depth"][nodes], pa.int32()),
                            *[pa.array([v[r].tobytes() for r in parts], pa.binary()) for v in (ids, x, y, weight)],
                            pa.array([None if top["kind"][a] == PIECE else top["p"][a] for a in nodes], pa.float64()),
                        ],
                        names=["_k", "tree", "node", "depth", "ids", "x", "y", "w", "p"],
                    )

    return _with_trees(blocks, tops.drop("width")).mapInArrow(deal, "_k bigint, tree int, node int, depth int, ids binary, x binary, y binary, w binary, p double")


def fit_forest(
    train: DataFrame, num_trees: int = 100, max_depth: int = 30, seed: int = 42, limit: int = LIMIT, target: str = "target", entity: str = "entity",
    label: str = "label", vector: str = "v", weight: str = "weight",
) -> Forest:
    """Forests of all targets of ``train``: bootstraps by Poisson draws, ``BINS`` bins, the square root of the features per node.

    Rows whose label is not 0 or 1 or whose vector is null take no part; vectors must have one length per target.  No
    task holds more than ``limit`` rows of a node; larger nodes are split by histograms.
    """
    ship(train.sparkSession)
    known = train.where(F.col(label).isin(0, 1) & F.col(vector).isNotNull()).select(
        F.xxhash64(target).alias("_k"), F.xxhash64(target, entity).alias("id"), F.col(vector).cast("array<double>").alias("v"),
        F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"),
    )
    known = materialize(spread(known, "id"))
    edges = materialize(bin_edges(known))
    blocks = _blocks(known, edges)
    sizes = known.groupBy("_k").agg(F.max(F.size("v")).alias("width"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n") > limit, OPEN).otherwise(PIECE)
    tops = materialize(sizes.select(
        "_k", "width", F.explode(F.sequence(F.lit(0), F.lit(num_trees - 1))).alias("tree"), *[F.array(F.lit(-1)).alias(c) for c in ("feature", "cut", "left")],
        F.array(F.lit(0)).alias("depth"), F.array(kind).alias("kind"), F.array(F.lit(0.0)).alias("p"),
    ))
    widest = sizes.agg(F.max("width").alias("d")).first()["d"] or 1
    per = int(np.ceil(np.sqrt(widest)))
    while tops.where(F.array_contains("kind", OPEN)).limit(1).count():
        tops = _split_tops(blocks, tops, per, max_depth, limit, seed)

    def piece(group: pa.Table) -> pa.Table:
        k, tree, node, depth = (group[c][0].as_py() for c in ("_k", "tree", "node", "depth"))
        ids, y, w = (np.concatenate([np.frombuffer(b.as_py(), t) for b in group[c]]) for c, t in (("ids", np.int64), ("y", np.float64), ("w", np.float64)))
        x = np.frombuffer(b"".join(b.as_py() for b in group["x"]), np.uint8).reshape(len(ids), -1)
        order = np.lexsort((w, y, ids))
        share = min(per, x.shape[1])
        # nodes of a piece are counted from far above those of a top, so that no two draw alike
        made = grow(x[order], y[order], w[order], depth, max_depth, share, lambda a, n: _features(seed, k, tree, (node + 1 << 32) + a, n, x.shape[1], share))
        arrays = [pa.array([a.astype(t).tobytes()], pa.binary()) for a, t in zip(made, (np.int32, np.int32, np.int32, np.float64))]
        return pa.table([pa.array([k], pa.int64()), pa.array([tree], pa.int32()), pa.array([node], pa.int32()), *arrays], names=["_k", "tree", "node", "feature", "cut", "left", "leaf"])

    dealt = _dealt(blocks, tops, True, seed)
    pieces = dealt.groupBy("_k", "tree", "node").applyInArrow(piece, "_k bigint, tree int, node int, feature binary, cut binary, left binary, leaf binary")
    return Forest(edges, tops, materialize(pieces))


def score_forest(forest: Forest, rows: DataFrame, target: str = "target", vector: str = "v") -> DataFrame:
    """``rows`` with ``p``, the mean positive share of the leaves they reach; rows without a model or a vector go."""
    ship(rows.sparkSession)
    rows = materialize(rows.withColumns({"_row": F.monotonically_increasing_id(), "_k": F.xxhash64(target)}))
    asked = rows.where(F.col(vector).isNotNull()).select(
        "_k", F.col("_row").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w")
    )
    dealt = _dealt(_blocks(asked, forest.edges), forest.tops, False, 0).drop("depth", "y", "w")

    def leaves(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch[c][r].as_py() for c in ("ids", "x", "p", "feature", "cut", "left", "leaf")}
                ids = np.frombuffer(one["ids"], np.int64)
                p = np.full(len(ids), np.nan if one["p"] is None else one["p"])
                if one["leaf"] is not None:
                    x = np.frombuffer(one["x"], np.uint8).reshape(len(ids), -1)
                    p = np.frombuffer(one["leaf"])[_routed(x, *(np.frombuffer(one[c], np.int32) for c in ("feature", "cut", "left")))]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(p)], names=["_row", "p"])

    votes = dealt.join(forest.pieces, ["_k", "tree", "node"], "left").mapInArrow(leaves, "_row bigint, p double")
    mean = votes.where(~F.isnan("p")).groupBy("_row").agg(clip_probability(F.avg("p")).alias("p"))
    return rows.join(mean, "_row").drop("_row", "_k")


def forest_predictions(
    rows: DataFrame, strategy: str = "none", min_rows: int = MIN_ROWS, target: str = "target", entity: str = "entity", label: str = "label", vector: str = "v", **params,
) -> DataFrame:
    """``rows`` with ``p`` by the forest of their target, fitted to the rows of ``side`` train; the others have no rows."""
    known = rows.where(F.col(label).isin(0, 1) & (F.col("side") == "train") & F.col(vector).isNotNull())
    usable = trainable_targets(known, target, label, min_rows).select(target)
    train = attach(known, usable, target, "inner", null_safe=True)
    fitted = fit_forest(imbalance(train, strategy, "rf", target, label, entity), target=target, entity=entity, label=label, vector=vector, **params)
    return score_forest(fitted, rows, target, vector)
