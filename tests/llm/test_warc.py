import gzip
import io
import random

from quillspark.llm.warc import base32_sha1, page_number, parse_records, read_range, read_warc, record, write_warc

SCHEMA = "page_id long, url string, html string, payload string"


def test_ranges_own_each_record_once():
    rng = random.Random(3)
    parts, starts, at = [], [], 0
    for i in range(60):
        body = bytes(rng.randrange(256) for _ in range(rng.randrange(3000))) + b"\x1f\x8b\x08" * 3
        data = gzip.compress(record(i, "http://x/ y", body, base32_sha1(body), None, False, "2024-01-01T00:00:00Z"), compresslevel=rng.choice([0, 6]))
        parts.append(data)
        starts.append(at)
        at += len(data)
    whole = b"".join(parts)
    for split in (100, 997, 4096, 1 << 20):
        got = [(o, h["warc-record-id"]) for s in range(0, len(whole), split) for o, h, _ in read_range(io.BytesIO(whole), s, s + split, len(whole))]
        assert [o for o, _ in got] == starts
        assert len({x for _, x in got}) == 60


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" if i < 40 else f"<p>é {i}</p>" * i, "clash") for i in range(80)]
    rows += [(100, None, None, None), (101, "u\nv", "", ""), (102, "u", "long " * 300_000, "")]
    got = read_warc(write_warc(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}/w"), split_bytes=1500)
    got = got.select(page_number("record_id").alias("page_id"), "record_type", page_number("refers_to").alias("refers_to"), "payload_digest", "payload_bytes", "payload", "target_uri").collect()
    assert len(got) == len(rows)
    by = {}
    for i, _, h, _ in rows:
        by.setdefault(h or "", []).append(i)
    source = {i: h or "" for i, _, h, _ in rows}
    for r in got:
        body = source[r["page_id"]].encode()
        keep = max(by[source[r["page_id"]]])
        assert (r["payload_digest"], r["payload_bytes"]) == (base32_sha1(body), len(body))
        if r["page_id"] == keep:
            assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["payload"]) == body
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == keep and bytes(r["payload"]) == b""


def test_least_payload_and_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "aa", ""), (2, "u", "aa", ""), (3, "u", "bbbb", ""), (4, "u", "bbbb", ""), (None, "u", "x", "")], SCHEMA)
    got = {page: kind for page, kind in read_warc(write_warc(rows, f"file://{tmp_path}/a", min_bytes=3)).select(page_number("record_id"), "record_type").collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response", None: "response"}
    assert read_warc(write_warc(rows.limit(0), f"file://{tmp_path}/b")).count() == 0


def test_member_with_two_records():
    a = record(1, "u", b"x", base32_sha1(b"x"), None, False, "d")
    assert [h["warc-record-id"] for h, _ in parse_records(a + a)] == ["<urn:quillspark:page:1>"] * 2


def test_repeated_rows_and_hot_payload(spark, tmp_path):
    rows = [(7, "u", "same", "")] * 3 + [(i, "u", "same", "") for i in range(200)] + [(500, "v", "other", "")] * 2 + [(501, None, None, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = read_warc(write_warc(df, f"file://{tmp_path}/r")).select(page_number("record_id").alias("p"), "record_type", page_number("refers_to").alias("to")).collect()
    assert len(got) == len(rows)
    kinds = {}
    for r in got:
        kinds.setdefault(r["p"], []).append((r["record_type"], r["to"]))
    assert kinds[199] == [("response", None)] and kinds[7] == [("revisit", 199)] * 4
    assert kinds[500] == [("response", None)] * 2 and kinds[501] == [("response", None)] * 2
