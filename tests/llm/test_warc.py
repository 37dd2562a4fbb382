import hashlib

from aperture.llm import common as C
from aperture.llm import warc


def test_round_trip(spark):
    big, other = "<p>" + "é" * 600, "x" * 1500
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/\n3", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", other), (None, "u", other), (None, "u", "y" * 2000), (None, "u", "y" * 2000), (9, "u", "z" * 3_000_000), (9, "u", "z" * 3_000_000), (8, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame([(i, u, h, "f") for i, u, h in rows], "page_id long, url string, html string, file string")
    scratch = C.Scratch(spark, "t")
    index = warc.write_archives(pages, scratch)
    got = warc.read_archives(index).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == b and j is not None]
        last = max(same) if same and len(b) >= 1000 else None
        refers = last if last is not None and last != i else None
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if refers else "response", refers or 0))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got) == sorted(want)
    head, block = warc.lookup(index, 2)[0]
    assert head["WARC-Type"] == "response" and block.endswith(big.encode())
    assert len(warc.lookup(index, 9)) == 2


def test_seek_table_is_skippable(spark, tmp_path):
    import zstandard

    parts = [zstandard.ZstdCompressor().compress(x) for x in (b"one", b"two" * 1000)]
    data = b"".join(parts) + warc.seek_table([(len(parts[0]), 3), (len(parts[1]), 3000)])
    path = tmp_path / "f"
    path.write_bytes(data)
    with C.open_shared(f"file://{path}") as f:
        assert warc.read_seek_table(f) == [(0, len(parts[0]), 3), (len(parts[0]), len(parts[1]), 3000)]
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data) == b"one" + b"two" * 1000


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, C.Scratch(spark, "t"))).count() == 0
