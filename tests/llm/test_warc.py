"""Archives come back as they were written, whatever stands inside payloads and wherever files are split."""
import hashlib
import random
import uuid

import pytest

from titerflow.llm.warc import MARK, read_archives, write_archives
from titerflow.session import temp_table_path

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n"
PAYLOADS = [
    "plain", "", None, "ends with line ends\r\n\r\n", "\r\n\r\n" + FAKE, FAKE * 3, "text " * 50 + MARK, "WARC/1.1", "x\nWARC/1.1", "x\nWARC/1.1\r\n\r\n",
    MARK * 40, "é" * 70_000 + "\r\n" + FAKE + "ü", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\nbeyond", "a\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + FAKE,
    "\r\n\r\nWARC/1.1\r\nContent-Length: 10\r\n\r\n" + "y" * 200, "long " * 100, "long " * 100, "s" * 99, "s" * 99, "t" * 100, "t" * 100,
]


def pages(spark, rows):
    schema = "page_id long, url string, html string, id long, digest string, payload string, value string"
    return spark.createDataFrame([(i, u, h, 5, "z", "z", "z") for i, u, h in rows], schema)


def expected(rows):
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    for i, url, html in order:
        first.setdefault(html or "", (i, url))
    for i, url, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and first[html or ""] != (i, url)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html or ""][0] if again else None))
    return sorted(out, key=repr)


def result(frame):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    rows = frame.collect()
    assert all(r["intact"] for r in rows)
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


@pytest.mark.parametrize("split", [None, 5000])
def test_round_trip(spark, split):
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate(PAYLOADS)]
    rows += [(None, None, "long " * 100), (None, "http://n", "t" * 100), (40, "http://a\r\nWARC/1.1\r\nb", "u"), (15, "http://x/15", "long " * 100), (3, "http://x/3", "same id")]
    r = random.Random(3)
    for i in range(100, 160):  # payloads cut at random out of archives
        rows.append((i, f"http://r/{i}", "".join(r.choice([FAKE, MARK, "\r\n", "abc", "\n", "WARC/1.1\r\n", "Content-Length: 7\r\n\r\n"]) for _ in range(r.randrange(12)))))
    path = temp_table_path(spark, f"warc-{uuid.uuid4().hex}")
    write_archives(pages(spark, rows).repartition(3), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = read_archives(spark, path)
        assert result(got) == expected(rows)
        assert got.select("file", "offset").distinct().count() == len(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_files_are_plain_archives(spark):
    path = temp_table_path(spark, f"warc-{uuid.uuid4().hex}")
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate(PAYLOADS)]
    write_archives(pages(spark, rows).coalesce(1), path)
    (data,) = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    at, found = 0, []
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        assert lines[0] == "WARC/1.1" and data[at + len(head) + 4 + size :][:4] == b"\r\n\r\n"
        if fields["WARC-Type"] == "response":
            found.append(data[at + len(head) + 4 :][:size].decode())
        at += len(head) + 4 + size + 4
    assert sorted(set(found)) == sorted({h or "" for h in PAYLOADS})


def test_broken_and_empty_archives(spark):
    path = temp_table_path(spark, f"warc-{uuid.uuid4().hex}")
    write_archives(pages(spark, []), path)
    assert read_archives(spark, path).collect() == []
    for text, n in (("no archive at all", 0), (FAKE + FAKE[:40], 1), (FAKE + "junk" + FAKE, 1), ("junk" + FAKE, 0)):
        path = temp_table_path(spark, f"warc-{uuid.uuid4().hex}")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
        assert read_archives(spark, path).count() == n
