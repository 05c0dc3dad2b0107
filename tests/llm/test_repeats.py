import re

import pytest

from tests.llm.conftest import prose
from titerflow.llm.repeats import later_spans, remove_repeats


def plain(rows, n=20):
    """(id, text) rows, ids may repeat: a window goes when it starts earlier by (id, start)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = lambda i: (i is not None, i or 0)
    first = {}
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            first[k] = min(first.get(k, ((True, 1 << 62), 0)), (key(i), s))
    out = []
    for (i, _), w in zip(rows, words):
        cut = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] != (key(i), s):
                cut.update(range(s, s + n))
        out.append((i, len(w), len(cut), " ".join(x for k, x in enumerate(w) if k not in cut)))
    return sorted(out, key=str)


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = remove_repeats(docs).drop("repeats").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_tricky_rows(tricky):
    check(tricky)


def test_shared_passages(documents):
    passage, rows = prose(70, 9), []
    for i in range(40):
        cut = passage.split()[i % 30 : 40 + i % 30]
        rows.append((1000 - i, f"{prose(15 + i, i)} {' '.join(cut)} {prose(30, i + 500)} {' '.join(cut[:25])}", "en", "a"))
    rows.append((2000, "same " * 200, "en", "a"))
    check(documents(rows))


def test_repeats_are_maximal_ranges(documents):
    text = prose(60, 1)
    got = {r.doc_id: r for r in remove_repeats(documents([(1, text, "en", "a"), (2, f"x {text} y", "en", "a")])).collect()}
    assert got[1].repeats == [] and [tuple(r) for r in got[2].repeats] == [(1, 61)] and got[2].kept == "x y"


def test_empty_table(documents):
    assert remove_repeats(documents([])).collect() == []


def test_windows_too_wide_to_pack_are_refused(documents):
    with pytest.raises(ValueError):
        later_spans(documents([]), window=264, seed=8)
