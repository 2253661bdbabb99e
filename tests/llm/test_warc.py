"""Archives: round trip, revisits, shards, manifests."""

import hashlib
import os
import uuid

import pytest

from bandwalk.llm.warc import read_archives, write_archives
from bandwalk.session import shared_folder

ROWS = [(i, f"http://x.example/{i}", f"<p>{'same' * 50 if i % 3 == 0 else f'page {i} ' * 40}</p>") for i in range(60)] + [
    (100, "http://x.example/a b\r\nc", "short"), (101, "http://x.example/s", "short"), (102, None, None), (103, "http://e", ""),
    (104, "http://u", "é\r\n\r\nß" * 60), (None, "http://n", "null page " * 30), (None, "http://n2", "<p>" + "same" * 50 + "</p>"),
    (105, "http://r", "repeated " * 30), (105, "http://r", "repeated " * 30), (106, "http://r", "repeated " * 30), (107, "http://big", "z" * 3_000_000),
]


def expected(rows):
    out, groups = [], {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    for html, ids in groups.items():
        data = html.encode()
        low = min((i for i in ids if i is not None), default=None)
        told = False
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            revisit = len(data) >= 100 and told
            told = True
            out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", low if revisit else None))
    return sorted(out, key=str)


def folder(spark):
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


@pytest.mark.parametrize("roll", [64 << 20, 700])
def test_round_trip(spark, roll):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string").repartition(5)
    where = folder(spark)
    manifest = write_archives(pages, where, roll=roll)
    got = read_archives(spark, where, manifest).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(ROWS)
    bodies = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in ROWS}
    for r in got:
        assert (bytes(r.payload) == bodies[r.payload_digest]) if r.record_type == "response" else r.payload is None
    lines = manifest.collect()
    assert sum(m.records for m in lines) == len(ROWS)
    path = where.removeprefix("file:")
    assert {m.file for m in lines} == set(os.listdir(path))  # no temporary name is left
    if roll == 700:
        assert len(lines) > 20
    # what is not in the manifest is not read; written again, the files are the same
    with open(f"{path}/shard-999999-00000.warc.gz", "wb") as f:
        f.write(b"left behind")
    assert read_archives(spark, where, manifest).count() == len(ROWS)
    again = write_archives(pages.repartition(2), folder(spark), roll=roll)
    assert sorted((m.file, m.sha256) for m in again.collect()) == sorted((m.file, m.sha256) for m in lines)


def test_damage_is_seen(spark):
    pages = spark.createDataFrame(ROWS[:10], "page_id long, url string, html string")
    where = folder(spark)
    manifest = write_archives(pages, where)
    path = where.removeprefix("file:") + "/" + manifest.first().file
    data = bytearray(open(path, "rb").read())
    data[-12] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception):
        read_archives(spark, where, manifest).collect()


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    where = folder(spark)
    assert read_archives(spark, where, write_archives(pages, where)).count() == 0


def test_pages_without_id_spread_over_shards(spark):
    rows = [(None, f"http://n/{i}", f"page {i % 150} " * 30) for i in range(300)] + [(7, "http://n/7", "page 3 " * 30)]
    where = folder(spark)
    manifest = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), where)
    got = read_archives(spark, where, manifest).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert manifest.count() > 1


def test_a_repeated_task_writes_over_its_files(spark):
    where = folder(spark)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(5, "page_id")
    first, again = (sorted(map(tuple, write_archives(pages, where).collect())) for _ in range(2))
    assert first == again
    assert len([name for name in os.listdir(where.removeprefix("file:")) if name.endswith(".gz")]) == len(first)
