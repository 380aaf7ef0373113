import hashlib


from lexweave.llm import warc_archive as W
from lexweave.llm._common import new_folder

BIG = "<p>" + "x\r\n\r\nWARC/1.1 é" * 20
PAGES = [(5, "http://a/ b\n", BIG), (3, None, BIG), (3, "u", BIG), (9, "u", BIG), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", BIG), (7, "u", "y" * 300_000), (8, "u", "z" * 100), (10, "u", "z" * 100)]


def test_round_trip_and_revisits(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    got = W.archive_and_read(pages).collect()
    assert len(got) == len(PAGES)
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        first = min((j for j, _, g in PAGES if g == h and j is not None), default=None) if len(data) >= 100 else None
        revisit = first is not None and first != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)


def test_selection_and_payloads(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = new_folder(spark, "test-warc")
    index = W.write_archive(W.plan_records(pages), folder)
    assert index.where("length <= 0 OR offset < 0").count() == 0
    got = W.read_records(index.where("id = 7"), folder).collect()
    assert [bytes(r.payload) for r in got] == [b"y" * 300_000]


def test_null_ids_only(spark):
    pages = spark.createDataFrame([(None, "u", BIG), (None, "v", BIG)], "page_id long, url string, html string")
    assert {r.record_type for r in W.archive_and_read(pages).collect()} == {"response"}


def test_empty(spark):
    assert W.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ranges_join():
    assert W.coalesce_ranges([(0, 10), (10, 5), (100, 5)], gap=20, most=50) == [(0, 15, [0, 1]), (100, 105, [2])]
    assert W.coalesce_ranges([(0, 10), (12, 10)], gap=20, most=15) == [(0, 10, [0]), (12, 22, [1])]


def test_index_matches_file(spark):
    pages = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string").coalesce(1)
    folder = new_folder(spark, "test-warc")
    rows = W.write_archive(W.plan_records(pages), folder).orderBy("file", "offset").collect()
    for r in rows:
        with open(f"{folder.removeprefix('file://').removeprefix('file:')}/{r.file}", "rb") as f:
            f.seek(r.offset)
            import zlib

            headers, _, _ = W.parse_record(zlib.decompress(f.read(r.length), 31))
        assert headers["WARC-Payload-Digest"] == f"sha256:{r.digest}"
