from __future__ import annotations

import glob
import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import warc as W


@pytest.mark.parametrize("most", [W.MAX_BROADCAST, 0])
def test_round_trip_and_seek(spark, tmp_path, most):
    big = "<p>" + "x" * 1500
    rows = [(1, "u1", big), (5, "u5", big), (3, "u3\r\ny%0Dz ü", big), (4, "u4%20x%", "small"), (6, "u6", "small"), (7, None, None), (8, "u8", ""), (5, "u5", big), (None, "n", big), (9, "é", "ü" * 700), (10, "b", "y" * 900_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    pages = pages.withColumns({c: F.lit(1) for c in ("payload", "refers_to", "__key", "__digest", "number", "frame")})  # names that the operator uses
    bundles = W.write_bundles(W.plan_records(pages, max_broadcast=most), frame_bytes=4000, bundle_bytes=250)
    got = W.read_bundles(bundles).collect()
    assert len(got) == len(rows)
    for r in got:
        want = next(h or "" for i, _, h in rows if i == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(want), hashlib.sha1(want).hexdigest())
        revisit = r.page_id in (1, 3, None)
        assert (r.record_type, r.refers_to) == (("revisit", 5) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else want) and r.url in [u for i, u, _ in rows if i == r.page_id]
    some = W.fetch(bundles, spark.createDataFrame([(10,), (4,), (4,), (99,)], "number long")).collect()
    assert sorted((r.page_id, len(r.payload)) for r in some) == [(4, 5), (10, 900_000)]
    kept = {hashlib.sha1(bytes(b.bundle)).hexdigest(): bytes(b.bundle) for b in bundles.collect()}
    places = W.index_of(bundles).collect()
    assert sorted(p.number or 0 for p in places) == sorted(i or 0 for i, _, _ in rows) and len(kept) > 2
    for p in places:
        assert W.read_record(kept[p.bundle_id], p.frame, p.offset).number == p.number
    files = W.export(bundles, f"file://{tmp_path}").collect()
    assert len(files) == len(kept) == len(glob.glob(f"{tmp_path}/*.warc.zst"))


def test_frames_are_plain_zstandard():
    import zstandard

    w = W.BundleWriter(frame_bytes=100)
    for i in range(5):
        w.add(W.Record(i, "u", b"p" * 80, "d", 80))
    data = w.finish()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1") == 5 and len(W.seek_table(data)) == 5 and sum(raw for *_, raw in W.seek_table(data)) == len(whole)


def test_empty(spark):
    assert W.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
