"""WARC archives: any ranges give the same records."""

import hashlib
import io
import random

import pytest
from compare import of_duckdb, of_spark, oracle

from brindle.llm import warc
from brindle.llm.common import new_folder
from brindle.llm.warc import gzip_member, parse, plan_records, read_archives, record, write_archives

SCHEMA = "page_id long, url string, html string, id string, digest string, n int, first int"


def archives(spark, rows):
    pages, folder = spark.createDataFrame([(i, u, h, "i", "d", 1, 2) for i, u, h in rows], SCHEMA), new_folder(spark, "warc")
    return folder, write_archives(plan_records(pages), folder).collect()


def test_round_trip_with_any_ranges(spark):
    rng = random.Random(1)
    same = "<p>an equal payload of more than a hundred bytes</p>" * 4
    rows = [(i, f"http://a.example/{i}?q=ä b", "".join(rng.choice("abcé<>\x1f\n") for _ in range(rng.randint(0, 3000)))) for i in range(60)]
    rows += [(100 + i, None, same) for i in range(9)] + [(200, "u", None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (None, "u", same), (None, "v", "none else"), (300, "big", "x y" * 400_000), (100, None, same)]
    folder, made = archives(spark, rows)
    assert sum(x["records"] for x in made) == len(rows)
    results = [sorted(map(str, read_archives(spark, folder, made, split=n).collect())) for n in (1 << 22, 5000, 777)]
    assert results[0] == results[1] == results[2]
    found = read_archives(spark, folder, made).collect()
    by = {}
    for x in found:
        by.setdefault(x["id"], []).append(x)
    for i, u, h in rows:
        x = by[i][0]
        data = (h or "").encode()
        if i is not None:
            assert (x["url"], x["payload_bytes"], x["payload_digest"]) == (u, len(data), hashlib.sha256(data).hexdigest())
        if x["record_type"] == "response":
            assert bytes(x["payload"]) in {(h or "").encode() for j, _, h in rows if j == i}
    assert [(x["record_type"], x["refers_to"]) for i in range(100, 109) for x in by[i]] == [("response", None)] * 2 + [("revisit", 100)] * 8
    assert {x["record_type"] for i in (200, 201, 202, 203, 300) for x in by[i]} == {"response"}
    assert sorted(str(x["refers_to"]) for x in by[None]) == ["100", "None"]


def test_false_members_are_passed_over(tmp_path):
    """Magic bytes and whole gzip members inside stored data, before and between records."""
    import zlib

    fake = gzip_member(b"not a record at all" * 3) + b"\x1f\x8b\x08" + b"\x1f\x8b\x08\x00garbage"
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)
    block = record(1, "u", fake, hashlib.sha256(fake).hexdigest(), None, False)
    stored = pack.compress(block) + pack.flush()  # the magic bytes stand in the file
    plain = [gzip_member(record(k, "u", b"p%d" % k, hashlib.sha256(b"p%d" % k).hexdigest(), None, False)) for k in (2, 3)]
    data = stored + plain[0] + b"junk\x1f\x8b\x08" + plain[1]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    import pyarrow as pa

    file = pa.OSFile(str(path))
    for step in (1, 7, 50, len(data)):
        found = [parse(x)["id"] for at in range(0, len(data), step) for x, _ in warc.members(file, at, min(at + step, len(data)))]
        assert found == [1, 2, 3]


def test_archives_inside_archives(spark, tmp_path):
    """Stored records that hold whole archives: the records inside are none, in ranges of any size."""
    own = lambda k, payload: record(k, "u", payload, hashlib.sha256(payload).hexdigest(), None, False)
    inner = b"".join(gzip_member(own(90 + k, b"inside %d " % k * 20)) for k in range(5))
    nested = b"".join([gzip_member(own(80, inner), 0), gzip_member(own(81, b"deep"))])
    data = b"".join([gzip_member(own(1, inner), 0), gzip_member(own(2, b"two")), b"junk" + gzip_member(own(3, nested), 0), gzip_member(own(4, b"four" * 900)), gzip_member(own(5, inner), 0)])
    (tmp_path / "a.warc.gz").write_bytes(data)
    archive = [{"path": f"{tmp_path}/a.warc.gz", "bytes": len(data)}]
    for split in (len(data), 1500, 700, 300, 200, 64):
        assert sorted(x["id"] for x in read_archives(spark, f"file://{tmp_path}", archive, split=split).collect()) == [1, 2, 3, 4, 5]


def test_bytes_are_read_once():
    rng = random.Random(2)
    data = b"".join(gzip_member(record(k, "u", p, hashlib.sha256(p).hexdigest(), None, False)) for k in range(1500) for p in [rng.randbytes(1300)])

    class Counted(io.BytesIO):
        total = 0

        def read(self, n=-1):
            out = super().read(n)
            self.total += len(out)
            return out

    for split in (1 << 30, 1 << 20):
        read, found = 0, 0
        for at in range(0, len(data), split):
            file = Counted(data)
            found += sum(1 for _ in warc.members(file, at, min(at + split, len(data))))
            read += file.total
        assert found == 1500 and read < 1.3 * len(data)


def test_damage_is_noticed(spark, tmp_path, monkeypatch):
    good = record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False)
    assert parse(good)["digest_ok"] is True and parse(good.replace(b"payload\r\n\r\n", b"payloaf\r\n\r\n"))["digest_ok"] is False
    spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(warc, "record", lambda *x: record(*x).replace(b"payload\r\n\r\n", b"payloaf\r\n\r\n"))
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.op5_warc_round_trip(spark, str(tmp_path)).collect()


URLS = ["http://a/b%20c?q=1%2F2", "http://a/b c", "http://a/ä?ü=%C3%BC", "http://a/100%", "", " http://a/ ", "a\r\nX: y", "line\nend", "%0D%0A", "x\u2028y", "<http://a/>x", "<http://a/>", "<", ">", None]


def test_urls_come_back_as_they_were(spark):
    folder, made = archives(spark, [(i, u, f"page {i}") for i, u in enumerate(URLS)])
    found = read_archives(spark, folder, made).collect()
    assert [x["url"] for x in sorted(found, key=lambda x: x["id"])] == URLS
    plain = parse(record(1, URLS[0], b"", hashlib.sha256().hexdigest(), None, False))
    assert plain["url"] == URLS[0] and b"WARC-Target-URI: " + URLS[0].encode() in record(1, URLS[0], b"", "", None, False)


def foreign(kind, id_, head, block):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{id_}>", "WARC-Date: 2024-01-01T00:00:00Z", *head, f"Content-Length: {len(block)}"]
    return gzip_member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_an_archive_of_another_writer(spark, tmp_path):
    """Other types, identifiers, digests and headers; none of them ends the job."""
    import base64

    page = b"<html>a page</html>"
    sha1 = base64.b32encode(hashlib.sha1(page).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page
    response = "Content-Type: application/http; msgtype=response"
    rows = [
        foreign("warcinfo", "i", ["Content-Type: application/warc-fields"], b"software: some crawler\r\n"),
        foreign("request", "q", ["WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        foreign("response", "r", ["WARC-Target-URI: <http://a/%7Ex>", f"WARC-Payload-Digest: sha1:{sha1}", response], http),
        foreign("response", "w", ["WARC-Target-URI: http://a/\r\n folded", "WARC-Payload-Digest: sha1:" + "A" * 32, response], http),
        foreign("response", "u", ["WARC-Payload-Digest: blake3:00", response], http),
        foreign("resource", "s", ["WARC-Target-URI: ftp://a/", f"WARC-Payload-Digest: md5:{hashlib.md5(page).hexdigest().upper()}", "Content-Type: text/html"], page),
        foreign("revisit", "v", ["WARC-Target-URI: http://a/", f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Refers-To: <urn:uuid:r>", response], b"HTTP/1.1 200 OK\r\n\r\n"),
        foreign("metadata", "m", ["X-\xff: odd"], b""),
    ]
    data = b"".join(rows)
    (tmp_path / "b.warc.gz").write_bytes(data)
    archive = [{"path": f"{tmp_path}/b.warc.gz", "bytes": len(data)}]
    for split in (1 << 20, 100):
        found = {x["record_id"][10:-1]: x for x in read_archives(spark, f"file://{tmp_path}", archive, split=split).collect()}
        assert list(map(found.__contains__, "iqrwusvm")) == [True] * 8 and all(x["id"] is None for x in found.values())
        assert [found[k]["digest_ok"] for k in "iqrwusvm"] == [None, None, True, False, None, True, None, None]
        assert [bytes(found[k]["payload"]) for k in "rwus"] == [page] * 4 and bytes(found["i"]["payload"]).startswith(b"software") and found["v"]["payload"] is None
        assert found["r"]["url"] == "http://a/%7Ex" and found["w"]["url"] == "http://a/ folded" and found["s"]["content_type"] == "text/html"
        assert (found["v"]["refers_to"], found["v"]["refers_to_id"], found["v"]["payload_digest"], found["v"]["payload_bytes"]) == (None, "<urn:uuid:r>", f"sha1:{sha1}", None)
        assert {x["record_type"] for x in found.values()} == {"warcinfo", "request", "response", "resource", "revisit", "metadata"}


def test_empty_table(spark):
    folder, made = archives(spark, [])
    assert read_archives(spark, folder, made).collect() == []


def test_query(spark, sf_dir):
    assert of_spark(warc.op5_warc_round_trip(spark, sf_dir)) == of_duckdb(oracle(sf_dir), warc.OP5_SQL)


def test_identifiers_are_numbers(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        plan_records(spark.createDataFrame([("a-1", "u", "x")], "page_id string, url string, html string"))
