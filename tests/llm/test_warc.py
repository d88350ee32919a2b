"""WARC archives: round trips, predicates, skipped payloads, and repeated payloads kept once."""

import base64
import gzip
import hashlib
import io
import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from rankloom.llm import warc as W


def rows_for(payloads):
    out = []
    for i, payload in enumerate(payloads):
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append({
            "record_type": "response", "record_id": f"urn:page:{i}", "target_uri": f"http://h{i % 3}.example/é {i}\r\nX: y",
            "warc_date": None, "payload_digest": digest, "refers_to": None, "http_length": None, "payload": payload,
        })
    return out


PAYLOADS = [b"", b"<p>x</p>", "é日\r\n\r\nWARC/1.1\r\n".encode(), b"\0\xff" * 5000, b"y" * 400_000, b"\r\n"]


class Watched(io.BytesIO):
    """Counts what is read through it."""

    def __init__(self, raw):
        super().__init__(raw)
        self.seen = 0

    def readinto(self, buffer):
        many = super().readinto(buffer)
        self.seen += many
        return many


@pytest.mark.parametrize("zipped", [True, False])
def test_records_round_trip_and_unwanted_payloads_are_passed_over(zipped):
    rows = rows_for(PAYLOADS)
    pack = W.gzip_member if zipped else (lambda x: x)
    raw = b"".join(pack(W.record_bytes(r)) for r in rows)
    read = lambda wanted, payload, **k: list(W.read_records(io.BufferedReader(io.BytesIO(raw)), zipped, wanted, payload, **k))
    got = read(lambda r: True, True)
    assert [(r["record_id"], r["payload"], r["http_length"]) for r in got] == [
        (r["record_id"], r["payload"], len(r["payload"])) for r in rows
    ]
    assert "\r" not in got[0]["target_uri"] and "%20" in got[0]["target_uri"]
    assert [r["record_id"] for r in read(lambda r: r["record_id"] == "urn:page:5", True)] == ["urn:page:5"]
    assert [r["payload"] for r in read(lambda r: True, False)] == [None] * len(rows)
    if zipped:
        assert gzip.decompress(raw) == b"".join(W.record_bytes(r) for r in rows)


def test_unwanted_payloads_are_not_read():
    import random

    noise = [random.Random(i).randbytes(300_000) for i in range(6)]
    for pack, zipped in ((W.gzip_member, True), (lambda x: x, False)):
        file = Watched(b"".join(pack(W.record_bytes(r)) for r in rows_for(noise)))
        got = list(W.read_records(io.BufferedReader(file, 4096), zipped, lambda r: r["record_id"] == "urn:page:3", True))
        assert [r["payload"] for r in got] == [noise[3]]
        assert file.seen < 2 * 300_000 < 6 * 300_000


def test_members_without_a_length_are_read_too():
    rows = rows_for(PAYLOADS)
    raw = b"".join(gzip.compress(W.record_bytes(r)) for r in rows)
    got = list(W.read_records(io.BufferedReader(io.BytesIO(raw)), True, lambda r: r["record_id"] != "urn:page:4", True))
    assert [r["payload"] for r in got] == PAYLOADS[:4] + PAYLOADS[5:]


def test_broken_records_are_errors():
    raw = W.record_bytes(rows_for([b"abc"])[0])
    read = lambda x: list(W.read_records(io.BufferedReader(io.BytesIO(x)), False, lambda r: True, True))
    assert len(read(raw + b"\r\n\r\n")) == 1
    for broken in (b"HTTP" + raw, raw[:60], raw[:-6], raw[:-1]):
        with pytest.raises(ValueError):
            read(broken)


def test_predicates_follow_sql():
    row = {"record_type": "revisit", "refers_to": None, "target_uri": "http://a/b"}
    col = ("record_type",)
    assert W.holds(ds.EqualTo(col, "revisit"), row) and W.holds(ds.In(col, ("x", "revisit")), row)
    assert W.holds(ds.Not(ds.EqualTo(col, "response")), row)
    assert W.holds(ds.EqualTo(("refers_to",), "x"), row) is None
    assert W.holds(ds.Not(ds.EqualTo(("refers_to",), "x")), row) is None
    assert W.holds(ds.IsNull(("refers_to",)), row) and not W.holds(ds.IsNotNull(("refers_to",)), row)
    assert W.holds(ds.StringStartsWith(("target_uri",), "http://a"), row) and W.holds(ds.GreaterThan(col, "response"), row)
    assert not W.can_push(ds.EqualTo(("payload",), b"")) and W.can_push(ds.EqualTo(col, "x"))


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_source_pushes_predicates_and_plans_files(spark, folder, compression):
    path = f"file://{folder}/a"
    rows = spark.createDataFrame([tuple(r.values()) for r in rows_for(PAYLOADS * 3)], W.SCHEMA).repartition(3)
    W.write_warc(rows, path, compression=compression, fileBytes=1000)
    assert len(list(Path(folder, "a").glob("*.warc*"))) > 3
    Path(folder, "a", "part-00000-lost.warc").write_bytes(b"a lost task's file")  # listed nowhere
    every = W.read_warc(spark, path, partitionBytes=2000)
    assert 1 < every.rdd.getNumPartitions() < 18
    assert sorted(bytes(r["payload"]) for r in every.collect()) == sorted(PAYLOADS * 3)
    some = W.read_warc(spark, path, W.HEADERS_ONLY).filter("record_id IN ('urn:page:2', 'urn:page:7') AND record_type = 'response'")
    assert sorted(r["http_length"] for r in some.collect()) == sorted([len(PAYLOADS[2]), len(PAYLOADS[1])])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan  # the reader took every predicate
    assert every.filter(F.length("payload") == 2).count() == 3
    W.write_warc(rows, path, compression=compression)  # adds
    assert W.read_warc(spark, path, "record_id string").count() == 36


def test_pages_with_equal_payloads_are_kept_once(spark, folder):
    pages = [(5, "u", "same"), (2, "u", "same"), (9, None, "same"), (None, "u", "same"), (3, "u", None), (4, "u", ""),
             (7, "v", "other é"), (2, "u", "same"), (None, "u", "lone"), (None, "u", "lone"), (8, "u", "x" * 100_000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, record_type string").repartition(4)

    def archived(min_bytes, name):
        W.write_warc(W.page_records(df, min_bytes), f"{folder}/{name}")
        rows = W.archived_pages(spark, f"{folder}/{name}").collect()
        return sorted((tuple(r) for r in rows), key=str)

    def want(min_bytes):
        out = []
        for i, _, html in pages:
            raw = (html or "").encode()
            same = [j for j, _, h in pages if (h or "").encode() == raw and j is not None]
            again = len(raw) >= min_bytes and bool(same) and i != min(same)
            digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
            out.append((i, len(raw), digest, "revisit" if again else "response", min(same) if again else None))
        return sorted(out, key=str)

    for min_bytes, name in ((0, "a"), (1, "b"), (5, "c")):
        assert archived(min_bytes, name) == want(min_bytes)
    W.write_warc(W.page_records(df.limit(0)), f"{folder}/none")
    assert W.archived_pages(spark, f"{folder}/none").count() == 0
    assert json.loads(next(Path(folder, "none").glob("_manifest-*")).read_text()) == []
