import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from titerflow.llm import licences, neighbours
from titerflow.llm.contamination import contaminated, decontaminated
from titerflow.llm.licences import licence_scan
from titerflow.llm.neighbours import nearest

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def grams(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_contamination_is_exact(spark, documents):
    items = [(i, prose(4 + i * 3, 50 + i)) for i in range(12)] + [(50, prose(30, 1)), (51, None), (52, "..."), (53, prose(3, 77)), (None, prose(12, 4))]
    rows = []
    for i in range(60):
        item = items[i % 13][1].split()
        for e in range(i % 4):
            item[(i * 7 + e * 5) % len(item)] = f"other{e}"
        rows.append((i, f"{prose(200, i)}, {' '.join(item).upper() if i % 2 else ' '.join(item)}! {prose(50, i + 900)}", "en", "a"))
    rows += [(70, None, "en", "a"), (71, "", "en", "a"), (72, prose(3, 77), "en", "a"), (72, prose(3, 77), "en", "a"), (None, prose(12, 4) + " x", "en", "a")]
    docs = documents(rows)
    frame = spark.createDataFrame([(i, t, "z", "z") for i, t in items], "item_id long, text string, size string, shingle string")
    got = {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in contaminated(docs, frame).collect()}
    want = set()
    for d, text, _, _ in rows:
        for i, t in items:
            n = len(words(t))
            if n:
                own = grams(t, min(5, n))
                shared = len(own & grams(text, min(5, n)))
                if shared * 100 >= 80 * len(own):
                    want.add((d, i, len(own), shared))
    assert got == want and len(want) > 20
    # one id with two texts is two items; a passage that all items share is nobody's minimum as long as there are others
    head = prose(8, 999)
    two = [(1, prose(40, 1) + " " + head), (1, prose(30, 2) + " " + head), (1, prose(30, 2) + " " + head), (2, prose(30, 3) + " " + head)]
    texts = [(i, f"{head} {prose(40, 700 + i)}", "en", "a") for i in range(30)] + [(90, prose(10, 5) + " " + two[1][1], "en", "a"), (91, two[0][1], "en", "a")]
    repeated = contaminated(documents(texts), spark.createDataFrame(two, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.item_shingles) for r in repeated.collect()) == [(90, 1, 34), (91, 1, 44)]
    clean = decontaminated(docs, frame)
    assert clean.columns == docs.columns
    bad = {d for d, *_ in want}
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, *_ in rows if d not in bad)
    assert contaminated(docs.limit(0), frame).collect() == [] and decontaminated(docs, frame.limit(0)).count() == docs.count()


def test_licences_find_every_base_place(documents, tricky):
    texts = [
        "Released under the MIT License.", "GNU General Public License, version 3. gnu general public license", "mit mit license license",
        "CC BY-NC 4.0 and cc by, CC-BY", "the Apache  License, Version 2.0\napache license", "general public license", "license mit", "cc by" * 3,
        "éMIT license", None, "", "--", prose(5000, 1) + " mit license " + prose(10, 2),
    ]
    docs = documents([(i, t, "en", "a") for i, t in enumerate(texts)])
    phrases = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
    rows = {r.doc_id: r for r in licence_scan(docs).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        hits = sorted((s, label) for p, label in phrases.items() for s in range(len(w)) if tuple(w[s : s + len(p)]) == p)
        r = rows[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "gpl-3.0" in rows[1].labels and "cc-by-nc" in rows[3].labels and "apache-2.0" in rows[4].labels
    assert licence_scan(tricky).count() == tricky.count() and licence_scan(documents([])).collect() == []


def brute(rows, k):
    """Over (id, vector) rows, exact ids and scores of the nearest."""
    x = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in x:
        if q % 20 == 0:
            s = sorted(((-float(x[q] @ x[c]), c) for c in x if c != q))[:k]
            out[q] = [(c, -d) for d, c in s]
    return out


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    same = [0.5, 0.25, -1.0]
    good = [(i, rng.integers(-8, 8, 3).astype(float).tolist()) for i in range(200)] + [(1000 + i, same) for i in range(300)]
    good = [(i, v if any(v) else [1.0, 0.0, 0.0]) for i, v in good]
    odd = [(5000, None), (5020, [0.0, 0.0, 0.0]), (5040, [1.0, None, 2.0]), (5060, [float("nan"), 1.0, 1.0]), (5080, [float("inf"), 1.0, 1.0]), (5100, [1.0]), (None, same), (20, good[20][1])]
    frame = spark.createDataFrame([(i, v, "z", "z") for i, v in good + odd], "vec_id long, embedding array<double>, rank string, score string")
    got = {}
    for r in nearest(frame, F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(good, 20)
    assert nearest(frame.limit(0), F.col("id") % 20 == 0).collect() == []
    few = nearest(frame.where("vec_id < 3"), F.col("id") % 20 == 0, k=20).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2)]


def test_neighbour_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 16)) + 3 * rng.standard_normal((10, 16)).repeat(600, axis=0)
    x = x * rng.uniform(0.5, 2, (6000, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {}
    for q in range(0, 6000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        want[q] = set(np.argsort(-s)[:20].tolist())
    hits = Counter()
    for r in nearest(frame, F.col("id") % 100 == 0, k=20, trees=8, leaf=64, enough=4000).collect():
        hits[r.query_id] += r.vec_id in want[r.query_id]
    assert sum(hits.values()) >= 0.9 * 20 * len(want)


def test_neighbour_budget_grows_with_the_table(spark, monkeypatch):
    """A least number of rows that is far too small for either table; what is chosen is well under all rows."""
    monkeypatch.setattr(neighbours, "VISIT", 8)  # else tables this small are cheapest in one leaf
    for n in (3000, 12000):
        rng = np.random.default_rng(7)
        x = rng.standard_normal((n, 24)) + 1.5 * rng.standard_normal((20, 24))[rng.integers(0, 20, n)]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        step, hits, report = n // 60, 0, {}
        want = {q: set(np.argsort(-np.where(np.arange(n) == q, -np.inf, x @ x[q]))[:20].tolist()) for q in range(0, n, step)}
        for r in nearest(frame, F.col("id") % step == 0, k=20, leaf=32, enough=200, report=report).collect():
            hits += r.vec_id in want[r.query_id]
        assert hits >= 0.9 * 20 * len(want)
        assert report["rows"] == n and 200 < report["enough"] < 0.6 * n and n / 2 ** report["depth"] < 0.2 * n and 0.95 <= report["met"] < 1


def test_licence_key_phrase_alone_is_found():
    """With words outside the key phrases rarer than those inside."""
    vocabulary = np.unique(np.concatenate([licences._hashes(t.text) for t in licences.NOTICES]))
    for own, template in enumerate(licences.NOTICES):
        key = np.searchsorted(vocabulary, licences._hashes(template.key))
        frequency = np.zeros(len(vocabulary), np.int64)
        frequency[key] = 9
        index = licences.build_index(licences.NOTICES, vocabulary, frequency, 4)
        assert own in licences._found(key, np.arange(len(key)), index)


def test_sample_is_bounded_by_bytes(spark):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(600)], "vec_id bigint, embedding array<double>")
    ask = F.col("id") % 20 == 0
    few, report = {}, {}
    small = nearest(frame, ask, leaf=32, sample_bytes=8 * 16 * 40, report=few).collect()
    whole = nearest(frame, ask, leaf=32, report=report).collect()
    assert few["depth"] < report["depth"] and sorted(small) == sorted(whole)  # every row is compared either way
