import json

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from titerflow.llm.dac import Image, build
from titerflow.llm.tokens import TextEncoder, WordEncoder, encoder, is_wordwise, tokenized

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_image_round_trip(n):
    ids = np.random.default_rng(n).choice([0, 1, 255, 256, 49407, 70_000, 2**32 - 1], n).astype(np.uint32)
    image = Image(build(ids, [3, None], [n // 2, n - n // 2]))
    assert image.doc_ids == [3, None] and image.counts.tolist() == [n // 2, n - n // 2]
    assert np.array_equal(image.read(0, n), ids) and np.array_equal(image.read(n // 3, n), ids[n // 3 :])
    order = np.random.default_rng(1).permutation(n)
    assert np.array_equal(image.access(order), ids[order])


def test_words_give_the_ids_of_whole_texts():
    texts = [
        "It's WE'LL 'twas, they've. e.g., a.b.c ... ,x. .", "<|endoftext|> a<|endoftext|>b <|STARTOFTEXT|>.", "J̌ T̈ Å İx É é",
        "一二三 ﬁne ½  x y", "Straße,GROSS. ΣΑΣ σας", "", " \n", "x" * 3000, prose(500, 1), "Ünïcode. naïve, é. á.", "12,5. 3.", "a‍b.",
    ]
    whole = Tokenizer.from_file(PATH)
    encoder = WordEncoder(PATH)
    for group in (texts, texts[:1], texts[2:], [t for t in texts if "<|" not in t]):
        ids, sizes = encoder.encode([t.encode() for t in group])
        want = [whole.encode(t, add_special_tokens=False).ids for t in group]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_files(tricky):
    got = tokenized(tricky, PATH, segment_ids=500).orderBy("start").collect()
    whole, rows = Tokenizer.from_file(PATH), [(r.doc_id, r.text or "") for r in tricky.collect()]
    want = {(i, np.array(whole.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in rows}
    assert {(r.doc_id, bytes(r.ids)) for r in got} == want and len(got) == len(rows)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens


def test_empty_table(documents):
    assert tokenized(documents([]), PATH).collect() == []


OTHER = public_tokenizers.path("byte_bpe_50k.json")


def changed(tmp_path, change):
    told = json.load(open(PATH, encoding="utf-8"))
    change(told)
    path = tmp_path / "changed.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "change",
    [
        lambda t: t["normalizer"]["normalizers"].pop(),  # keeps case
        lambda t: t["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"),  # keeps white space
        lambda t: t["added_tokens"][0].update(content="two words"),
        lambda t: t["model"].update(end_of_word_suffix=None),
    ],
)
def test_files_that_are_not_wordwise_are_told(tmp_path, change):
    assert is_wordwise(PATH) and not is_wordwise(changed(tmp_path, change))


def test_other_tokenizers_encode_whole_texts(tmp_path, documents):
    assert isinstance(encoder(PATH), WordEncoder) and isinstance(encoder(OTHER), TextEncoder)
    texts = ["Two  words\n\n and\tMORE  ", "", "x" * 3000, prose(300, 2), None, "<|endoftext|> É é 一二", " "]
    docs = documents([(i, t, "en", "a") for i, t in enumerate(texts)])
    cased = changed(tmp_path, lambda t: t["normalizer"]["normalizers"].pop())
    for path in (OTHER, cased):
        whole = Tokenizer.from_file(path)
        want = {i: whole.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
        got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in tokenized(docs, path).collect()}
        assert got == want


def test_whole_texts_in_small_groups(monkeypatch):
    monkeypatch.setattr(TextEncoder, "GROUP", 10)
    texts = [b"", b"one", b"a longer text than a group", b"", b"x"]
    whole = Tokenizer.from_file(OTHER)
    ids, sizes = TextEncoder(OTHER).encode(texts)
    want = [whole.encode(t.decode()).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
