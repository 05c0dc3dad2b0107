"""Spelling variants against plain edit distances."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from titerflow.llm import variants
from titerflow.llm.variants import Trie, spelling_variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least=7, ratio=10):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    top = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in top.items() if n[x] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def found(frame, **options):
    names = ("word", "form", "root", "n", "n_near", "form_n")
    return sorted(tuple(r[c] for c in names) for r in spelling_variants(frame, **options).collect())


@pytest.mark.parametrize("per_group", [variants.WORDS, 8])
def test_variants_of_frequent_words(spark, documents, per_group):
    r = random.Random(7)
    base = ["".join(r.choice("abcdeéñß") for _ in range(r.randrange(7, 12))) for _ in range(25)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = list(base[min(24, int(r.expovariate(0.25)))])
            while r.random() < 0.25:
                at = r.randrange(len(w))
                w[at : at + r.randrange(2)] = r.choice([[], [r.choice("abcÀ")], ["x"]])
            words.append("".join(w))
        rows.append((i, " ".join(words).title() if i % 3 else "1".join(words)))
    want = plain(rows)
    assert any(f for _, f, *_ in want) and any(root not in (w, f) for w, f, root, *_ in want)
    assert found(documents([(i, t, "en", "a") for i, t in rows]), per_group=per_group) == want


def test_edges(documents, tricky):
    rows = [(r["doc_id"], r["text"]) for r in tricky.collect() if r["text"] is None or len(r["text"]) < 10_000]
    long = "ab" * 40_000
    rows += [(i, f"{long} {long}c Straße÷eins×zwei ÀÁÂÃÄÅÆ") for i in range(20, 24)] + [(None, "twentyone twentyone"), (None, None)]
    assert found(documents([(i, t, "en", "a") for i, t in rows])) == plain(rows)
    assert found(documents([])) == [] and found(documents([(1, "no", "en", "a")])) == []


def test_deep_trie_finds_every_pair():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcdef") for _ in range(8)) for _ in range(4000)})
    other = sorted({"".join(r.choice("abcdef") for _ in range(n)) for n in (8, 9) for _ in range(300)})
    level_of = np.zeros(256, np.int64)
    level_of[97:103] = range(6)
    as_rows = lambda ws: np.array([list(w.encode()) for w in ws], np.uint8)
    trie = Trie(as_rows(words), level_of, 6)
    for size, budget in ((8, (1, 1)), (9, (0, 1))):
        mine = [w for w in other if len(w) == size]
        a, b = trie.search(as_rows(mine), level_of, *budget)
        assert sorted((mine[x], words[y]) for x, y in zip(a, b)) == sorted((x, y) for x in mine for y in words if one_edit(x, y))
