"""Archives: round trip, revisits and odd rows against a plain version."""
import hashlib
import zlib

from oracle import compare

from queryscope.llm import queries, warc
from queryscope.llm.common import file_system

SMALL = "/root/testdata/sf0.01"


def plain(rows):
    last = {}
    for page, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000:
            last[b] = max(last.get(b, -1), -1 if page is None else page)
    out = []
    for page, _, html in rows:
        b = (html or "").encode()
        other = len(b) >= 1000 and last[b] != (-1 if page is None else page)
        out.append((page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if other else "response", last[b] if other else None))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, digest int").repartition(3)
    files, folder = warc.archive(df)
    records = warc.read_records(files, folder)
    got = warc.resolved_records(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted(map(tuple, got), key=str), files, folder


def test_query(spark):
    assert compare(spark, SMALL, queries.QUERIES["op7_warc_revisits"], queries.ORACLES["op7_warc_revisits"]) is None


def test_odd_rows(spark):
    big, odd = "é" * 600, "x" * 5_000_000
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, None), (4, "", ""), (5, "http://c", "z" * 999), (6, "http://c", "z" * 999), (7, "u", odd), (8, "u", odd), (None, "n", big),
            (9, "v", "WARC/1.1\r\n\r\n" + "q" * 1000), (10, "v", "\x00\r\n\r\n" * 400)]
    got, files, folder = run(spark, rows)
    assert got == plain(rows)
    system, path = file_system(folder)
    kinds = []
    for f in files.collect():
        with system.open_input_stream(f"{path}/{f.file}", compression=None) as s:
            for data in warc.members(s, piece=7919):
                fields, payload = warc.parse(data)
                kinds.append(fields["WARC-Type"])
                assert fields["WARC-Type"] == "response" or (not payload and fields["WARC-Refers-To"])
                assert "X" not in fields
    assert kinds.count("revisit") == sum(r[3] == "revisit" for r in got)


def test_repeated_rows_keep_one_original(spark):
    rows = [(5, "u", "y" * 1200)] * 4
    got, _, _ = run(spark, rows)
    assert [g[3] for g in got].count("response") == 1 and len(got) == 4
    assert {g[4] for g in got if g[3] == "revisit"} == {5}


def test_empty_table(spark):
    assert run(spark, [])[0] == []


def test_damage_is_found(spark):
    data = zlib.compress(b"x" * 50, wbits=31)
    import io

    import pytest
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-12])))
