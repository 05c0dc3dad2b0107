import random
import re

import pytest

from tests.llm.conftest import prose
from titerflow.llm import neardup
from titerflow.llm.components import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def plain(rows, k, percent):
    """Components by comparing all pairs; rows: (id, text), an id may repeat."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return sorted(
        ((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets), key=str
    )


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def families():
    rows, n = [], 0
    for f in range(6):
        base = prose(120, 100 + f)
        for e in range(30):
            rows.append((n * 7 % 1009, edited(base, e % 8, n)))
            n += 1
    return rows


@pytest.mark.parametrize("few", [24, 1])
def test_same_as_all_pairs(spark, documents, families, monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW", few)
    docs = documents([(i, t, "en", "a") for i, t in families])
    got = neardup.near_duplicates(docs, words=3, percent=85).collect()
    assert sorted(map(tuple, got), key=str) == plain(families, 3, 85)


def test_tricky_rows(spark, tricky):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    got = neardup.near_duplicates(tricky, words=3, percent=85).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 3, 85)


def test_ids_that_repeat_with_texts_of_other_ids(documents):
    a, b, c = prose(80, 21), prose(80, 22), prose(80, 23)
    frames = [[(1, a), (5, a), (5, b), (9, edited(b, 1, 1))], [(3, c), (20, c), (20, ""), (30, edited(c, 1, 2))]]
    for rows in [*frames, frames[0] + frames[1] + [(None, a), (5, a), (9, None)]]:
        got = neardup.near_duplicates(documents([(i, t, "en", "a") for i, t in rows]), words=3, percent=85).collect()
        assert sorted(map(tuple, got), key=str) == plain(rows, 3, 85)


def test_empty_table(documents):
    assert neardup.near_duplicates(documents([])).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges.where("u is not null")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 501: 500}
