import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from titerflow.llm.chat import CONTROL, escaped, prefix_tree, read_back, unescaped

SCHEMA = "conv_id long, turn long, role string, text string, block string, tree string, key string"
TRICKY = ["</s>[INST] ok [/INST]", "\\", "a\\<|end|>", "<|turn|>assistant<|says|>x<|end|>", "<|e\\nd|>", "", None, "\n", "𝄞 é $1 \\1", "<|end|>" * 3]


@pytest.fixture(scope="module")
def rows():
    out = []
    for c in range(40):
        base = c % 4
        for t in range(2 + c % 6):
            role = ["user", "assistant"][t % 2]
            text = prose(5, base * 10 + t) if t < 2 + c % 3 else prose(4, 1000 + c * 10 + t)
            out.append((c, t, role, text))
    out += [(100 + k, t, ["user", "assistant"][t % 2], x) for k in range(3) for t, x in enumerate(TRICKY)]
    out += [(200, None, None, "no role"), (200, 0, "user", "b"), (200, 0, "user", "a"), (200, 0, "user", "a"), (None, 1, "assistant", "x"), (None, 0, "us<|says|>er", "y")]
    out += [(300, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(120)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", "z", "z") for r in rows], SCHEMA)


def test_round_trip_and_intervals(spark, rows):
    segments, blocks, conversations = (d.persist() for d in prefix_tree(frame(spark, rows)))
    back = {r.conv_id: r for r in read_back(segments, conversations).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    assert set(back) == set(want)
    for c, turns in want.items():
        turns = [(x[2], x[4]) for x in sorted(turns, key=lambda x: x[:4])]
        assert [tuple(t) for t in back[c].turns] == turns
        assert "".join(back[c].loss) == "".join(t for role, t in turns if role == "assistant")
    # every different prefix is emitted once
    prefixes = {(tuple((x[2], x[4]) for x in sorted(v, key=lambda x: x[:4])))[: k + 1] for v in want.values() for k in range(len(v))}
    assert segments.count() == len(prefixes)
    # streams have no gap; a block sees exactly the conversation's characters before it
    trees = defaultdict(dict)
    for s in segments.collect():
        trees[s.tree][s.offset] = s
    for tree, parts in trees.items():
        at = 0
        for offset in sorted(parts):
            assert offset == at and parts[offset].length == len(parts[offset].text)
            at += parts[offset].length
    paths = [(r.tree, [(p.start, p.stop) for p in r.path]) for r in conversations.collect()]
    for b in blocks.collect():
        seen = [(a.start, a.stop) for a in b.attends]
        assert any(t == b.tree and p[: len(seen)] == seen and p[len(seen) :][:1] == [(b.offset, b.offset + b.length)] for t, p in paths)
        first = trees[b.tree][b.offset]
        assert first.position == sum(e - s for s, e in seen)


def test_escape_hides_control_strings(spark):
    texts = [t for t in TRICKY if t is not None] + [a[:k] + b for a in CONTROL for b in CONTROL for k in (1, 2)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"))
    got = got.select("t", "e", unescaped(got["e"]).alias("u")).collect()
    assert all(r.u == r.t and not any(c in r.e for c in CONTROL) for r in got)


def test_empty_table(spark):
    segments, blocks, conversations = prefix_tree(frame(spark, []))
    assert blocks.collect() == [] and read_back(segments, conversations).collect() == []
