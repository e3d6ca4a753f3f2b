"""Archives and pages that others have made."""

import gzip
import os

import pytest

from pitwright.llm import html_extraction, warc


def record(kind, block, **fields):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {fields.pop('id', '<urn:x:1>')}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_others(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>body</p>"
    records = [
        record("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\nHost: x\r\nContent-Length: 9\r\n\r\n", Content_Type="application/http; msgtype=request"),
        record("response", page, WARC_Target_URI="http://x/", Content_Type="application/http; msgtype=response", WARC_Block_Digest=f"sha1:{warc.digest(page)}", id="<urn:uuid:9b2e7d6e-1c1c-4a4a-9c9c-0a0a0a0a0a0a>"),
        record("metadata", b"outlink: http://y/", Content_Type="application/warc-fields", WARC_Refers_To="<urn:x:3>"),
        record("resource", b"\x00\x01", Content_Type="image/x", WARC_Block_Digest="blake3:abc"),
    ]
    path = os.path.join(tmp_path, "a.warc.gz")
    with open(path, "wb") as f:
        f.write(b"".join(records))
    got = {r["record_type"]: r for r in warc.read(spark.createDataFrame([(path, None, None)], "archive string, records long, bytes long")).collect()}
    assert set(got) == {"warcinfo", "request", "response", "metadata", "resource"} and all(r["id"] is None for r in got.values())
    assert bytes(got["response"]["payload"]) == b"<p>body</p>" and got["response"]["payload_digest"] == warc.digest(b"<p>body</p>") and got["response"]["record_id"].endswith("0a>")
    assert bytes(got["resource"]["payload"]) == b"\x00\x01" and got["request"]["payload_bytes"] == 0 and bytes(got["metadata"]["payload"]) == b"outlink: http://y/"
    with pytest.raises(ValueError):
        warc.decode_record(gzip.decompress(record("response", page, WARC_Block_Digest=f"sha1:{warc.digest(b'other')}")))


@pytest.mark.parametrize("name", ["commentlist", "replies", "kommentare", "werbung", "publicidad", "hinweis", "comentarios"])
def test_names_of_comments_and_adverts_in_other_languages(spark, name):
    pages = [(k, f"http://h/{k}", f"<html><body><article><h1>Title {k}</h1><p>{'Words of the article that differ here and there. ' * 6}{k}</p></article><ol class='{name}'><li>Someone said number {k * 7}</li></ol></body></html>") for k in range(12)]
    got = html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 12 and all("Someone said" not in r["text"] and f"Title {r['page_id']}" in r["text"] for r in got)


def test_an_archive_is_one_gzip_member_for_each_record(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "<p>same</p>" if k % 2 else f"<p>{k}</p>") for k in range(20)], "page_id long, url string, html string")
    made = warc.write(pages.coalesce(1)).collect()
    raw = open(made[0]["archive"].removeprefix("file://"), "rb").read()
    assert gzip.decompress(raw).startswith(b"WARC/1.1") and raw.count(b"\x1f\x8b\x08") >= made[0]["records"] == 20
