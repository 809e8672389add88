import hashlib

import pytest

from glyphmill.llm import warc


def brute(rows):
    out, seen = [], {}
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(first.get(body, page), page)
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        original = first.get(body) if page is not None else None
        again = (page, body) in seen
        seen[page, body] = True
        revisit = original is not None and (page != original or again)
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", original if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    long, other = "é<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 5, "x" * 100
    rows = [(7, "http://a/\r\nb c", long), (3, None, long), (9, "u", long), (9, "u", long), (3, "z", long), (4, "u", None), (5, "u", ""), (1, "u", other), (2, "v", other), (6, "w", "x" * 99), (8, "w", "x" * 99), (None, "n", other), (None, "n", other), (20, "big", "word " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as copy").repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"))
    back = warc.read_archives(spark, str(tmp_path / "w"))
    got = warc.with_originals(back).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    stored = {r.page_id: bytes(r.block).decode() for r in back.where("record_type = 'response' and page_id is not null").collect()}
    assert stored == {3: long, 1: other, 4: "", 5: "", 6: "x" * 99, 8: "x" * 99, 20: "word " * 400_000}
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_damage_is_an_error():
    import gzip

    with pytest.raises(ValueError):
        list(warc.parsed(gzip.compress(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort\r\n\r\n")))
