from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import zlib
from pathlib import Path

from framelake.llm.queries import op3_warc
from framelake.llm.warc import _one_stream, inflate, parse, record, warc_round_trip
from tests.conftest import SF


def brute(rows):
    """rows (page_id, html) of distinct ids -> expected results."""
    best = {}
    for i, h in rows:
        best[h or ""] = max(i, best.get(h or "", i))
    sha = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    return sorted((i, len((h or "").encode()), sha(h or ""), "response" if best[h or ""] == i else "revisit", None if best[h or ""] == i else best[h or ""]) for i, h in rows)


def take(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_whole_table(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert take(op3_warc(spark, SF)) == brute(rows)


def test_copies_nulls_long_payloads_and_index(spark, tmp_path):
    rows = [(k, f"page {k % 5}\r\n\r\nWARC/1.1 é" * (k % 3)) for k in range(60)] + [(100, None), (101, ""), (102, "x" * 3_000_000)]
    df = spark.createDataFrame([(i, "http://é\r\n/", h, "t") for i, h in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = warc_round_trip(df, folder=f"file://{tmp_path}/w", archive_bytes=2000)
    assert take(got) == brute(rows)
    assert {r.page_id: r.payload for r in got.collect() if r.record_type == "response"}[102] == b"x" * 3_000_000
    archives = list(Path(tmp_path, "w").glob("each-*.warc.gz"))
    assert len(archives) > 3 and not list(Path(tmp_path, "w").glob("mono-*"))
    for a in archives:
        data = a.read_bytes()
        entries = json.loads(Path(str(a).replace(".warc.gz", ".idx")).read_text())
        whole = b"".join(zlib.decompress(data[at : at + n], 31) for *_, at, n in entries)
        assert whole == gzip.decompress(data) and sum(e[-1] for e in entries) == len(data)


def test_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, None, "a"), (None, "u", "a"), (3, "u", "b"), (3, "u", "b"), (4, "u", "a")], "page_id long, url string, html string")
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc_round_trip(df).collect()]
    assert sorted(got, key=str) == sorted([(None, "revisit", 4), (None, "revisit", 4), (4, "response", None), (3, "response", None), (3, "revisit", 3)], key=str)
    assert warc_round_trip(df.limit(0)).count() == 0


def test_stream_of_one_member_or_many_is_inflated_alike():
    records = [record(k, None, "response", "D", k * 7, b"y" * (k * 7)) for k in range(200)]
    one = b"".join(_one_stream(iter(records)))
    many = b"".join(gzip.compress(r) for r in records)
    for data in (one, many):
        assert [len(c) for _, c in parse(inflate(io.BytesIO(data)))] == [k * 7 for k in range(200)]
