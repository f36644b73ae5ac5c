"""Large archives are read in linear time; pages without an id, repeated rows and odd columns are written."""

import time

import pytest

from bookglass.llm import warc

BODY = "<p>é</p>" * 300


def test_a_large_archive_is_read_in_linear_time():
    import os

    blobs = [os.urandom(4000).hex().encode() for _ in range(6000)]
    data = warc.archive([warc.record(i, "u", b, None) for i, b in enumerate(blobs)])
    began = time.time()
    assert sum(1 for _ in warc.frames(data)) == len(blobs) and time.time() - began < 20


def test_edge_rows(spark):
    rows = [(None, "u", BODY), (None, "u", BODY), (1, "u", BODY), (2, "u", BODY), (2, "u", BODY), (3, "u", None), (4, None, ""), (5, "u", "z" * 3_000_000), (6, "u", BODY + "x"), (6, "u", "y" * 2000), (7, "u", "y" * 2000)]
    t = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, refers_to string")
    got = warc.read_archives(warc.write_archives(t), payloads=True).collect()
    assert len(got) == len(rows)
    told = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    n = len(BODY.encode())
    assert told == [(0, n, "response", None), (0, n, "response", None), (1, n, "revisit", 2), (2, n, "response", None), (2, n, "response", None), (3, 0, "response", None), (4, 0, "response", None), (5, 3_000_000, "response", None), (6, 2000, "revisit", 7), (6, n + 1, "response", None), (7, 2000, "response", None)]
    assert warc.read_archives(warc.write_archives(t.limit(0))).count() == 0


@pytest.mark.parametrize("cut", [1, 7, 100])
def test_cut_archives_are_faults(cut):
    data = warc.archive([warc.record(i, "u", b"x" * 500, None) for i in range(3)])
    with pytest.raises(warc.WarcError):
        list(warc.frames(data[:-cut]))
