"""Ranked search against a plain scorer, also where many documents are skipped and in several passes."""
import math
import random
import re
from collections import Counter

import pytest

from titerflow.llm import ranked
from titerflow.llm.ranked import ranked_search


def terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            n = sum(c.values())
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def found(spark, documents, docs, items, k=10, **options):
    asked = spark.createDataFrame([(i, t, "z", "z") for i, t in items], "item_id long, text string, terms string, rank string")
    got = ranked_search(documents([(i, t, "en", "a") for i, t in docs]), asked, k, **options)
    return [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.orderBy("item_id", "rank").collect()]


@pytest.mark.parametrize("options", [{}, {"pass_terms": 7}])
def test_many_documents_against_plain_scores(spark, documents, monkeypatch, options):
    # shards of many blocks, so that bounds have blocks and documents to skip
    monkeypatch.setattr(ranked, "BLOCK", 16)
    r = random.Random(5)
    rare = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(1200):
        words = r.choices(["the", "of", "and", "Über", "to"], [9, 7, 5, 2, 4], k=r.randrange(3, 60)) + r.choices(rare, k=r.randrange(0, 6))
        r.shuffle(words)
        docs.append((i, " ".join(words)))
    docs += [(2000 + i, "the of w7 w7") for i in range(40)]  # ties: smaller ids win
    items = [(1, "the of w7"), (2, "The the THE and w3, w9; w11 unseen"), (3, "of"), (4, "w1 w2 w5 über to"), (5, "unseen words only"), (6, "to " * 30 + "w399")]
    assert found(spark, documents, docs, items, **options) == plain(docs, items, 10)


def test_edges(spark, documents, tricky):
    docs = [(r["doc_id"], r["text"]) for r in tricky.collect()]
    items = [(1, docs[0][1]), (2, None), (3, ""), (4, "ONE"), (5, "…!?"), (7, docs[7][1]), (8, "12")]
    assert found(spark, documents, docs, items) == plain(docs, items, 10)
    assert found(spark, documents, [], items) == [] and found(spark, documents, docs, []) == []


def test_an_item_with_two_texts_is_two_items(spark, documents):
    docs = [(1, "red green"), (2, "blue")]
    asked = spark.createDataFrame([(1, "red"), (1, "blue"), (1, "blue")], "item_id long, text string")
    got = ranked_search(documents([(i, t, "en", "a") for i, t in docs]), asked).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got) == [(1, 1), (1, 2)] and len({r["item_sub"] for r in got}) == 2
