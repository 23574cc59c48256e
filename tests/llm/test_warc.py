import gzip
import hashlib

import pytest

from pathloom.llm import warc


def rows():
    same = "same payload, " * 20
    out = [(5, "http://a/b c\r\nX: y", same), (2, None, same), (9, "http://é", same), (1, "u", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short"),
           (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (8, "u", "0\r\n\r\n" * 50), (10, "u", "é😀\n" * 30_000), (11, "u", "é😀\n" * 30_000),
           (12, "u", "b" * 99), (13, "u", "b" * 99), (14, "u", "b" * 100), (15, "u", "b" * 100), (5, "again", same), (None, "u", same)]
    return out


def expected(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = p is not None and b in first and p > first[b]
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [50, 1 << 16])
def test_round_trip(spark, tmp_path, segment):
    data = rows() if segment > 50 else [r for r in rows() if len(r[2] or "") < 10_000]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "page_id long, url string, html string, refers_to long, value string").repartition(3)
    path = str(tmp_path / "archive")
    warc.write_archives(df, path, segment)
    got = [tuple(r) for r in warc.archive_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == expected(data)
    whole = warc.read_archives(spark, path).collect()
    assert all(r.complete for r in whole)
    texts = {(r.page_id, bytes(r.payload).decode()) for r in whole if r.record_type == "response"}
    assert texts <= {(p, h or "") for p, _, h in data}


def test_files_are_plain_warc(spark, tmp_path):
    path = tmp_path / "archive"
    warc.write_archives(spark.createDataFrame(rows(), "page_id long, url string, html string"), str(path))
    files = [[h for h, _ in warc.parse(gzip.decompress(f.read_bytes()))] for f in path.glob("part-*")]
    assert files and all([h["WARC-Type"] for h in hs].index("warcinfo") == 0 for hs in files)
    heads = [h for hs in files for h in hs]
    types = [h["WARC-Type"] for h in heads]
    assert types.count("continuation") > 2 and types.count("revisit") == 5
    pages = {h["WARC-Record-ID"]: h.get("X-Page-ID") for h in heads if h["WARC-Type"] == "response"}
    for h in heads:
        if h["WARC-Type"] == "revisit":
            assert pages[h["WARC-Refers-To"]] == {"5": "2", "9": "2", "11": "10", "15": "14"}[h["X-Page-ID"]]
    for f in path.glob("part-*"):  # a member a record
        assert all(len(list(warc.parse(m))) == 1 for m in warc.members(f.read_bytes(), 100))


def test_repeated_long_rows(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = [(1, "u", "k" * 1000)] * 3 + [(2, "u", "k" * 1000)] * 2 + [(1, "v", "k" * 1000)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, 100)
    got = [tuple(r) for r in warc.archive_index(spark, path).drop("payload_digest").collect()]
    assert sorted(got) == [(1, 1000, "response", None, True)] * 4 + [(2, 1000, "revisit", 1, True)] * 2


def test_files_of_many_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    path = tmp_path / "archive"
    warc.write_archives(spark.createDataFrame([(i, "u", f"{i}" * 200) for i in range(40)], "page_id long, url string, html string").coalesce(1), str(path))
    kinds = [[h["WARC-Type"] for h, _ in warc.parse(gzip.decompress(f.read_bytes()))] for f in path.glob("part-*") if f.stat().st_size]
    assert len(kinds) > 5 and all(k[0] == "warcinfo" and k.count("warcinfo") == 1 for k in kinds)
    assert warc.archive_index(spark, str(path)).where("complete").count() == 40


def test_lost_responses(spark, tmp_path):
    first, second = (list(warc.page_records(p, "u", b"x" * 500, of, "u", "a")) for p, of in ((1, None), (2, 1)))
    (tmp_path / "a.gz").write_bytes(gzip.compress(second[0]))
    assert [tuple(r) for r in warc.archive_index(spark, str(tmp_path)).select("page_id", "refers_to", "complete").collect()] == [(2, None, False)]
    (tmp_path / "b.warc").write_bytes(first[0])
    assert {tuple(r) for r in warc.archive_index(spark, str(tmp_path)).select("page_id", "refers_to", "complete").collect()} == {(1, None, True), (2, 1, True)}


def test_broken_segments(spark, tmp_path):
    parts = list(warc.page_records(1, "u", b"x" * 500, None, None, "a", 100))
    other = list(warc.page_records(2, "u", b"y" * 500, None, None, "b", 100))
    third = list(warc.page_records(3, "u", b"z" * 500, None, None, "c", 100))
    wrong = [x.replace(b"Total-Length: ", b"Total-Length: 9") for x in other]
    changed = [x.replace(b"zzz", b"zzq", 1) for x in third]
    lost = list(warc.page_records(4, "u", b"w" * 500, None, None, "d", 100))[1:]
    data = [*parts[:2], *parts[3:], *reversed(wrong), *changed, *lost]
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"".join(data)))
    got = {r.page_id: (r.complete, r.payload) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3}
    assert not any(c for c, _ in got.values()) and got[1][1] is None and got[2][1] is None


def test_framing():
    for payload in (b"", b"a", b"\r\n0\r\n\r\n", b"x" * 20_000):
        assert warc.unchunked(b"".join(warc.chunked(payload))) == payload
    assert warc.unchunked(b"4;ext=1\r\nwiki\r\n0\r\n\r\n") == b"wiki"
    for bad in (b"", b"4\r\nwik", b"5\r\nwiki\r\n0\r\n\r\n", b"0\r\n\r\nmore", b"zz\r\n", b"-1\r\n\r\n"):
        assert warc.unchunked(bad) is None


def test_empty(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.archive_index(spark, path).collect() == []
