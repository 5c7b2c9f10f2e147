import hashlib

import numpy as np

from tracewell.llm.warc import archived_pages, candidates, reachable, read_warc, write_warc

BIG = "é" * 700  # 1400 bytes
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 99\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages():
    rows = [(1, "http://a", BIG), (5, "http://b", BIG), (3, None, BIG), (2, "u", "small"), (4, "u", "small"), (6, "x\r\ny: z", FAKE * 40), (7, "u", None), (8, "u", ""), (None, "u", BIG), (None, "u", "ab\n" * 600), (None, "v", "ab\n" * 600)]
    rows += [(9, "u", "n" * 999), (10, "u", "n" * 999), (11, "u", "n" * 1000), (12, "u", "n" * 1000), (12, "u", "n" * 1000), (13, " ", FAKE + "WARC/1.1\r\n"), (14, "u", "<p>\r\n\r\nWARC/1.0\r\nContent-Length: 999999999\r\n\r\n")]
    return [(*r, "x", 1) for r in rows] + [(100 + i, "u", "page %d " % i * (i % 40), None, 2) for i in range(300)]


def brute(rows):
    groups = {}
    for k, _, html, *_ in rows:
        if k is not None and len((html or "").encode()) >= 1000:
            groups[html] = max(k, groups.get(html, k))
    out = []
    for k, _, html, *_ in rows:
        raw = (html or "").encode()
        kept = groups.get(html) if sum(r[2] == html for r in rows) > 1 else None
        revisit = kept is not None and kept != k
        out.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", kept if revisit else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, path string, start int")


def test_round_trip(spark):
    rows = pages()
    assert sorted(map(tuple, archived_pages(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_small_archives_and_payloads(spark, tmp_path):
    rows = pages()
    folder = write_warc(frame(spark, rows), str(tmp_path / "w"), roll_bytes=20_000)
    found = read_warc(spark, folder, with_payload=True).collect()
    assert len(found) == len(rows) and len({r.path for r in found}) > 5
    texts = {k: html or "" for k, _, html, *_ in rows if k is not None}
    for r in found:
        if r.record_type == "response" and r.page_id is not None:
            assert bytes(r.payload).decode() == texts[r.page_id]
        elif r.record_type == "revisit":
            assert bytes(r.payload) == b"" and r.payload_digest == hashlib.sha1(texts[r.refers_to].encode()).hexdigest()
    by_file = {}
    for r in found:
        by_file.setdefault(r.path, []).append((r.start, r.next, r.size))
    for spans in by_file.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == spans[-1][2]
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_a_joined_repeat_table_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr("tracewell.llm.warc.BROADCAST_ROWS", -1)
    rows = pages()
    assert sorted(map(tuple, archived_pages(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_chain(spark):
    start = np.array([30, 0, 10, 12, 20, 25])
    after = np.array([40, 10, 20, 25, 30, 30])
    assert reachable(start, after).tolist() == [True, True, True, False, True, False]
    assert reachable(np.array([5]), np.array([9])).tolist() == [False]
    assert reachable(np.array([], dtype=int), np.array([], dtype=int)).tolist() == []
    n = 5000
    assert reachable(np.arange(n), np.arange(n) + 1).all()


def test_what_only_looks_like_a_record(spark):
    assert list(candidates(b"")) == []
    assert list(candidates(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nab")) == []
    assert [c[:2] for c in candidates(FAKE.encode() * 2)] == [(0, len(FAKE)), (len(FAKE), 2 * len(FAKE))]


def test_empty_table(spark):
    assert archived_pages(frame(spark, [])).collect() == []


def test_long_urls_and_ids(spark):
    big = 10**18 + 7
    rows = [(k, "http://a/?" + "q" * size, BIG + str((k or 0) % 3), "x", 1) for k, size in [(big, 100_000), (2**63 - 1, 70_000), (-(2**63), 5), (big + 1, 5), (big + 3, 200_000), (None, 100_000), (4, 5)]]
    assert sorted(map(tuple, archived_pages(frame(spark, rows).coalesce(1)).collect()), key=str) == brute(rows)


def test_archives_of_any_name(spark, tmp_path):
    (tmp_path / "crawl-0001.warc").write_bytes(FAKE.encode() * 2)
    (tmp_path / "b.warc").write_bytes(FAKE.encode())
    assert [r.page_id for r in read_warc(spark, str(tmp_path)).collect()] == [99] * 3


def test_many_beginnings_without_an_end():
    payload = b"WARC/1.1\r\n" * 400_000 + b"WARC/1.1\r\n\r\n" * 100_000
    record = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(payload), payload)
    assert [c[:2] for c in candidates(record * 2)] == [(0, len(record)), (len(record), 2 * len(record))]
