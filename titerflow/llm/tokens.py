"""Token ids of documents in directly addressable code files, and reading them back."""
from __future__ import annotations

import json
import pathlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerflow.llm.common import in_slices, map_arrow, views
from titerflow.llm.dac import Image, build
from titerflow.llm.words import SPACE, hash_spans
from titerflow.session import shuffle_partitions, temp_table_path

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
POINT = np.zeros(256, bool)
POINT[[0x2C, 0x2E]] = True


#: What a tokenizer file must say for words to be encoded one by one; fixed values of the format.
WORDWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def is_wordwise(path: str) -> bool:
    """Whether ids of a text are surely those of its words: the file folds and splits as ``WORDWISE`` says, its model
    is a plain BPE that marks word ends, and its control strings are ``<|...`` without white space."""
    told = json.loads(pathlib.Path(path).read_text(encoding="utf-8"))
    model, added = told["model"], told.get("added_tokens") or []
    return (
        all(told.get(k) == v for k, v in WORDWISE.items())
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        and not any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and all(a["content"].startswith("<|") and not any(c.isspace() for c in a["content"]) for a in added)
        and not any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )


class TextEncoder:
    """Encodes whole texts with any tokenizer of the library, in groups of bounded size."""

    GROUP = 1 << 22

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of each text."""
        parts, group, held = [np.zeros(0, np.uint32)], [], 0
        sizes: list[int] = []
        for k, text in enumerate(texts):
            group.append(text.decode("utf-8"))
            held += len(text)
            if held >= self.GROUP or k == len(texts) - 1:
                for done in self.tokenizer.encode_batch_fast(group, add_special_tokens=False):
                    parts.append(np.array(done.ids, np.uint32))
                    sizes.append(len(done.ids))
                group, held = [], 0
        return np.concatenate(parts), np.array(sizes, np.int64)


class WordEncoder:
    """Encodes texts word by word with a tokenizer that never joins across white space.

    The tokenizer must drop white space, fold case and split letters from punctuation; ids of a text are then
    those of its words in order, so each different word is encoded once per worker.  The store of known words
    is emptied when it is full, which only costs time.
    """

    FULL = 1_500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Known words by their sorted hashes: where their ids begin in ``flat`` and how many they are."""
        self.known = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _append(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        at = self.used
        self.flat[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Encode new words; pure letters go in long strings, cut again after each word's last id."""
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        texts = [w.decode("utf-8") for w in words]
        plain, other = [], []
        for k, s in enumerate(texts):
            (plain if s.isalpha() else other).append(k)
        for at in range(0, len(plain), 64_000):
            groups = [plain[k : k + 500] for k in range(at, min(at + 64_000, len(plain)), 500)]
            for group, done in zip(groups, self._encode([" ".join([texts[k] for k in g]) for g in groups])):
                ids = np.array(done.ids, np.uint32)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(group) and ends[-1] == len(ids):
                    size[group] = np.diff(ends, prepend=0)
                    begin[group] = self._append(ids) + ends - size[group]
                else:  # some word gives several pieces
                    other += group
        for at in range(0, len(other), 16_000):
            part = other[at : at + 16_000]
            lists = [e.ids for e in self._encode([texts[k] for k in part])]
            size[part] = [len(x) for x in lists]
            begin[part] = self._append(np.array([i for x in lists for i in x], np.uint32)) + np.cumsum(size[part]) - size[part]
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.begin, self.size = np.insert(self.begin, place, begin), np.insert(self.size, place, size)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of each text."""
        joined = b"\n".join(texts)
        if len(self.known) > self.FULL:
            self.clear()
        b = np.frombuffer(joined, np.uint8)
        if b"<|" not in joined:  # control strings are matched before case folding
            low = np.append(b[1:] < 128, True) & (b >= 65) & (b <= 90)  # a capital before a combining mark may compose
            b = b + (low.astype(np.uint8) << 5)
        inside = ~SPACE[b]
        before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
        # a final point or comma after an ASCII letter is always a piece of its own
        point = POINT[b] & ~after & np.append(False, LETTER[b[:-1]])[: len(b)]
        starts = np.flatnonzero(inside & (~before | point))
        ends = np.flatnonzero(inside & (~after | np.append(point[1:], False)[: len(b)])) + 1
        hashes = hash_spans(b, starts, ends)
        at = self._find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            unknown, first = np.unique(hashes[new], return_index=True)
            data, first = b.tobytes(), new[first]
            self.learn(unknown, [data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())])
            old = at >= 0
            at[old] += np.searchsorted(unknown, hashes[old])  # the new ones went in between
            at[new] = np.searchsorted(self.known, hashes[new])
        sizes, begin = self.size[at], self.begin[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], sizes)]
        edges = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        return ids, np.diff(total[np.searchsorted(starts, edges)], prepend=0)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes among the known ones, -1 where there is none."""
        if len(self.known) == 0:
            return np.full(len(hashes), -1)
        order = np.argsort(hashes)  # looked up in order, the known ones pass through the cache once
        ascending = hashes[order]
        at = np.minimum(np.searchsorted(self.known, ascending), len(self.known) - 1)
        out = np.empty_like(at)
        out[order] = np.where(self.known[at] == ascending, at, -1)
        return out


_encoders: dict[str, WordEncoder | TextEncoder] = {}


def encoder(path: str) -> WordEncoder | TextEncoder:
    """One encoder per worker process and tokenizer file: by words where the file allows it, else of whole texts."""
    if path not in _encoders:
        _encoders[path] = (WordEncoder if is_wordwise(path) else TextEncoder)(path)
    return _encoders[path]


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
    segment_ids: int = 1 << 20, partitions: int | None = None,
) -> None:
    """Encode every row of ``docs`` and write directly addressable code segments in ascending id order.

    Each row of the written table is one segment: a whole image with its place in the order.  Spark's writer
    commits them, so any store that Spark reaches will do and a lost executor only repeats its part.  Null
    ids come first, rows that repeat an id follow each other in the order of a hash of their text; a null
    text is empty and gives the end id alone.  A text is never cut: a segment ends after the document that
    fills it.  Words are encoded one by one only if the tokenizer file says that this gives the same ids
    (``is_wordwise``), else whole texts are.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = partitions or shuffle_partitions(docs.sparkSession)
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), tie).sortWithinPartitions(
        F.col("id").asc_nulls_first(), tie
    ).withColumn("part", F.spark_partition_id())

    def work(batches):
        words = encoder(tokenizer)
        held, names, counts, seq, start, part, filled = [], [], [], 0, 0, 0, 0

        def flush():
            nonlocal held, names, counts, seq, start
            ids = np.concatenate(held)
            image = build(ids, names, counts)
            row = [part, seq, start, len(ids), len(names), image]
            start, seq, held, names, counts = start + len(ids), seq + 1, [], [], []
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "seq", "start", "n_ids", "n_docs", "image"]
            )

        for batch in in_slices(batches):
            part = batch.column(2)[0].as_py()
            ids, sizes = words.encode([t.tobytes() for t in views(batch.column(1))])
            at = 0
            for name, size in zip(batch.column(0).to_pylist(), sizes.tolist()):
                held.append(np.append(ids[at : at + size], np.uint32(end_id)))
                names.append(name)
                counts.append(size + 1)
                at += size
                filled += size + 1
                if filled >= segment_ids:
                    yield flush()
                    filled = 0
        if names:
            yield flush()

    map_arrow(ordered, work, "part int, seq bigint, start bigint, n_ids bigint, n_docs bigint, image binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files: ``start`` counts the ids of all documents
    before it, ``ids`` holds its ids as little-endian unsigned 32-bit integers."""
    files = spark.read.parquet(path)
    # one total per partition of the writer: a bounded list
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, at = [], 0
    for part, n in totals:
        base.append((part, at))
        at += n
    bases = F.broadcast(spark.createDataFrame(base, "part int, base bigint"))  # a row per partition of the writer
    placed = files.join(bases, "part").select(
        (F.col("base") + F.col("start")).alias("start"), "image"
    )

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                image = Image(batch.column(1)[row].as_buffer().to_pybytes())
                ends = np.cumsum(image.counts)
                first = batch.column(0)[row].as_py()
                for at in range(0, len(ends), 512):
                    stops = ends[at : at + 512]
                    begins = stops - image.counts[at : at + 512]
                    ids = image.read(int(begins[0]), int(stops[-1]))
                    cuts = zip((begins - begins[0]).tolist(), (stops - begins[0]).tolist())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(image.doc_ids[at : at + 512], pa.int64()),
                            pa.array(first + begins),
                            pa.array(stops - begins),
                            pa.array([ids[a:b].tobytes() for a, b in cuts], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return map_arrow(placed, work, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def tokenized(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the documents' tokens to ``path`` (by default a new folder in the shared one) and read them back."""
    path = path or temp_table_path(docs.sparkSession, f"tokens-{uuid.uuid4().hex}")
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(docs.sparkSession, path)
