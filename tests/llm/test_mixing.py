import re

from pyspark.sql import functions as F

from tests.llm.conftest import prose
from titerflow.llm.mixing import _mixed, mixed_documents, mixture, permuted


def targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        out = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if out[s] > limit * sizes[s]]
        if not over:
            return {**fixed, **out}
        fixed.update({s: limit * sizes[s] for s in over})


def test_shares_and_limits(documents):
    rows = [(i, prose(20 + i * 13 % 300, i), "en", ["a", "b", "c", "d", None][i % 5 if i < 150 else 0]) for i in range(300)]
    rows += [(900, "tiny one", "en", "e"), (901, None, "en", "f")]
    docs = documents(rows)
    shares, slots = mixture(docs)
    got = shares.collect()
    size = {}
    for r in got:
        text = next(t for i, t, _, _ in rows if i == r.doc_id)
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) and r.taken <= 3 * r.size
        size[r.source] = size.get(r.source, 0) + r.size
    want = targets(size)
    for s, n in size.items():
        own = [r for r in got if r.source == s]
        assert all(r.source_size == n and abs(r.target - want[s]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 64
    again, _ = mixture(docs.repartition(5))
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, again.collect())) == sorted(map(key, got))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()
    assert {r.source: r.n for r in words} == {s: t for s in size if (t := sum(r.taken for r in got if r.source == s))}


def test_tricky_rows(tricky):
    shares, _ = mixture(tricky)
    assert shares.count() == tricky.count()
    assert all(r.taken <= 3 * r.size for r in shares.collect())
    assert mixed_documents(tricky).where("text is null").count() == 0


def test_empty_table(documents):
    shares, slots = mixture(documents([]))
    assert shares.collect() == [] and slots.collect() == [] and mixed_documents(documents([])).collect() == []


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit("k")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def spread(documents, n=300):
    return documents([(i, prose(20 + i * 13 % 300, i), "en", ["a", "b", "c", "d", None][i % 5 if i < 150 else 0]) for i in range(n)])


def test_taken_is_what_the_slots_hold(documents):
    shares, slots = mixture(spread(documents), block=16, shard_slots=64)
    got, seats = sorted(shares.collect(), key=lambda r: r.doc_id), slots.collect()
    taken, uses = {}, {}
    for source in {r.source for r in got}:
        words = [(r.doc_id, k) for r in got if r.source == source for k in range(r.size)]
        for slot in (x for x in seats if x.source == source):
            for doc, k in words[slot.block * 16 : slot.block * 16 + 16]:
                taken[doc] = taken.get(doc, 0) + 1
                uses.setdefault((doc, k), []).append((slot.shard, slot.place))
    assert {r.doc_id: r.taken for r in got if r.taken} == taken
    for r in got:
        for u in r.uses or ():
            assert u.n == len(u.seats)
            assert all(sorted(uses[r.doc_id, k]) == [tuple(x) for x in u.seats] for k in range(u.low, u.high))


def test_shards_are_full_and_drawn(documents):
    docs = spread(documents)
    shares, slots = mixture(docs, block=4, shard_slots=256)
    size, by_shard, total = 256, {}, {}
    for r in slots.collect():
        by_shard.setdefault(r.shard, []).append(r)
        total[r.source] = total.get(r.source, 0) + 1
    n, chi, free = sum(total.values()), 0.0, 0
    for shard, rows in by_shard.items():
        assert sorted(r.place for r in rows) == list(range(min(size, n - shard * size)))
        for source, all_of in total.items():
            want = len(rows) * all_of / n
            chi += (sum(r.source == source for r in rows) - want) ** 2 / want
        free += len(total) - 1
    # counts scatter as draws do: neither equal shares nor far from them
    assert sorted(by_shard) == list(range(-(-n // size))) and 0.6 * free < chi < 1.4 * free
    for r in {(r.source, r.source_size, r.target) for r in shares.collect()}:
        blocks = -(-r[1] // 4)  # the last one may be shorter
        assert total[r[0]] <= 3 * blocks and abs(total[r[0]] - r[2] * blocks / r[1]) <= 0.5


def test_documents_come_in_shard_order(documents):
    docs = spread(documents)
    mixed = mixed_documents(docs, block=16, shard_slots=64)
    seats = _mixed(docs, "doc_id", "text", "source", block=16, shard_slots=64)
    keys = {}
    for r in seats.collect():
        keys.setdefault((r.doc_id, r.text), []).append(tuple(r._mix_seat))
    rows = mixed.withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == seats.count()
    at, shards = {}, {}
    for r in rows:
        seat = keys[r.doc_id, r.text]
        if len(seat) == 1:  # passes that take the same words of a document look alike
            assert at.get(r.part, (0, -1)) <= seat[0] and shards.setdefault(seat[0][0], r.part) == r.part
            at[r.part] = seat[0]
    assert len(shards) > 3
