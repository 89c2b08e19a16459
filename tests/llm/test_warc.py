import base64
import gzip
import hashlib
import os

import pytest

from textcluster.llm import warc
from textcluster.session import scratch_path

SCHEMA = "page_id long, url string, html string, first string, payload string, refers_to string"
TRICKY = ["a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "ends\r\n", "\r\n\r\nWARC/1.", "x\r\n\r\n\r\nWARC/1.0\r\n", "é\U0001f600" * 3000, "\n\n", "\r"]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "f", "p", "r") for i, u, h in rows], SCHEMA).repartition(3)


def brute(rows, min_bytes=0):
    first = {}
    for i, _, h in rows:
        body = (h or "").encode()
        if i is not None and len(body) >= min_bytes:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [x for x in rows if (x[2] or "").encode() == body]
        to = first.get(body) if len(same) > 1 and len(body) >= min_bytes else None
        to = None if to == i else to
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def rows():
    out = [(i, f"http://e.org/{i}\r\nX: y", h) for i, h in enumerate(TRICKY)]
    out += [(20 + i, None, "copy") for i in range(30)] + [(60, "u", None), (61, "u", ""), (62, "u", None)]
    return out + [(None, "u", "copy"), (None, "u", "alone"), (20, None, "copy"), (70, "u", "x" * 300000)]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip_matches_brute_force(spark, min_bytes):
    index, base = warc.archive_pages(pages(spark, rows()), min_bytes)
    got = [(x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in warc.read_archives(index, base).collect()]
    assert sorted(got, key=str) == brute(rows(), min_bytes)


def test_members_stand_alone_and_fill_the_archive(spark):
    index, base = warc.archive_pages(pages(spark, rows()), path=scratch_path(spark, "warc-test"))
    folder = base.removeprefix("file://")
    by_archive = {}
    for x in index.collect():
        by_archive.setdefault(x["archive"], []).append(x)
    payloads = {}
    for name, own in by_archive.items():
        data = open(f"{folder}/archives/{name}", "rb").read()
        own.sort(key=lambda x: x["offset"])
        assert own[0]["offset"] == 0 and [a["offset"] + a["length"] for a in own] == [b["offset"] for b in own[1:]] + [len(data)]
        for x in own:
            record = gzip.decompress(data[x["offset"] : x["offset"] + x["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            if x["record_type"] == "response":
                payloads[x["page_id"]] = record.partition(b"\r\n\r\n")[2][:-4].decode()
    assert {i: payloads[i] for i in range(len(TRICKY))} == dict(enumerate(TRICKY))
    # a monolithic stream is one gzip member of several records
    streams = [f for f in os.listdir(f"{folder}/streams") if f.endswith(".gz")]
    assert sum(gzip.open(f"{folder}/streams/{f}").read().count(b"WARC-Record-ID") for f in streams) == index.count()


def test_other_streams_are_normalised(spark, tmp_path):
    body = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nWARC-Payload-Digest: sha1:%s\r\nX-Payload-Length: 2\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    body %= base64.b32encode(hashlib.sha1(b"hi").digest())
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(body * 3))
    index = warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    assert [x["payload"] for x in warc.read_archives(index, f"file://{tmp_path}/out", True).collect()] == [b"hi"] * 3


def test_empty_table(spark):
    index, base = warc.archive_pages(spark.createDataFrame([], SCHEMA))
    assert warc.read_archives(index, base).count() == 0
