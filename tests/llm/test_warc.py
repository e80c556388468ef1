import hashlib

import pytest
from cuewright.llm import warc


def test_version_2_headers_and_lengths():
    data = warc.arc_version_block("a", 2) + warc.arc_record("http://x/", "20200102030405", "text/html", b"a\n\nb", 2) + warc.arc_record("http://y/", "2020", "text/html", b"", 2)
    found = list(warc.parse_arc(data))
    assert [r["body"] for r in found] == [b"a\n\nb", b""]
    assert found[0]["Result-code"] == "200" and found[0]["Archive-length"] == "4"
    assert warc.warc_date("20200102030405") == "2020-01-02T03:04:05Z"


@pytest.mark.parametrize(
    "data",
    [
        b"http://x/ 0.0.0.0 2020 text/html 1\na\n",  # no version block
        warc.arc_version_block("a", 1) + b"http://x/ 0.0.0.0 2020 text/html 9\nab\n",  # too short
        warc.arc_version_block("a", 1) + warc.arc_record("http://x/", "2020", "text/html", b"ab", 2),  # other version's fields
        warc.arc_version_block("a", 1) + b"http://x/ 0.0.0.0 2020 text/html many\nab\n",
    ],
)
def test_bad_archives(data):
    with pytest.raises(ValueError):
        list(warc.parse_arc(data))


def test_identifiers_hold_keys():
    digest = hashlib.sha1(b"x").hexdigest()
    for key in (0, 1, 77, (1 << 59) - 1, -5, (1 << 63) - 1, -(1 << 63)):
        assert warc.key_of(warc.record_id(digest, key, "p#0")) == key
    assert warc.key_of(warc.record_id(digest, None, "p#0")) is None


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, version):
    big, other = "ü" * 600, "b" * 1000
    rows = [(1, "http://a/ b", big, 9), (2, None, big, 9), (3, "u", big + "x", 9), (4, "", "s", 9), (5, "v", "s", 9), (6, "w", None, 9), (None, "n", other, 9), (7, "n", other, 9), (7, "n", other, 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    got = warc.read_warcs(warc.arcs_to_warcs(warc.write_arcs(pages, version=version))).collect()
    assert len(got) == len(rows)
    by_key = {r["key"]: r for r in got}
    assert (by_key[1]["kind"], by_key[1]["refers_to"], by_key[2]["kind"]) == ("revisit", 2, "response")
    assert by_key[1]["size"] == 1200 and by_key[1]["digest"] == hashlib.sha1(big.encode()).hexdigest()
    assert {by_key[k]["kind"] for k in (3, 4, 5, 6)} == {"response"} and by_key[6]["size"] == 0
    assert sorted(r["kind"] for r in got if r["size"] == 1000) == ["response", "revisit", "revisit"]
    assert [r["refers_to"] for r in got if r["size"] == 1000 and r["kind"] == "revisit"] == [7, 7]
    empty = warc.read_warcs(warc.arcs_to_warcs(warc.write_arcs(pages.limit(0))))
    assert empty.count() == 0


def test_members_in_slices():
    import random
    import zlib

    rng = random.Random(2)
    parts = [rng.randbytes(n) for n in (0, 10, 5000, 300_000, 1, 4096)]
    data = b"".join(warc._member(p) for p in parts)
    found = list(warc.members(data))
    assert [c for _, _, c in found] == parts
    assert [data[a : a + n] for a, n, _ in found] == [warc._member(p) for p in parts]
    with pytest.raises(ValueError):
        list(warc.members(data[:-1]))
    packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    assert [c for _, _, c in warc.members(packer.compress(b"a" * 10**6) + packer.flush())] == [b"a" * 10**6]


def test_long_pages_blank_lines_and_large_or_repeated_ids(spark):
    odd = "HTTP/1.1 200 OK\r\n\r\nx\r\n\r\ny" + "<p>\r\n\r\n</p>" * 200
    keys = [(1 << 63) - 1, -(1 << 63), 1 << 59, 1 << 62]
    rows = [(k, "u", odd) for k in keys] + [(8, "v", "z" * 3_000_000), (9, "w", odd), (9, "w", odd), (9, "w", "short")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warcs = warc.arcs_to_warcs(warc.write_arcs(pages))
    got = warc.read_warcs(warcs).collect()
    assert sorted((r["key"], r["size"], r["digest"]) for r in got) == sorted((k, len(h), hashlib.sha1(h.encode()).hexdigest()) for k, _, h in rows)
    assert {r["refers_to"] for r in got if r["kind"] == "revisit"} == {keys[0]} and sum(r["kind"] == "revisit" for r in got) == 5
    names = [h["WARC-Record-ID"] for row in warcs.collect() for h, _ in warc.parse_warc(warc.read_file(row["path"]))]
    assert len(set(names)) == len(rows)
