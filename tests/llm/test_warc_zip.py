import io
import zipfile

import pyarrow as pa
import pytest

from tessera.llm.common import fresh_path
from tessera.llm.queries_op4 import op4_warc
from tessera.llm.warc_zip import base32_sha1, central_directory, data_start, package, parse_record, read_records, record, record_ranges, with_originals, write_archives


def test_digest_of_nothing():
    assert base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


@pytest.mark.parametrize("zip64", [False, True])
def test_package_is_a_zip_file(zip64):
    members = [("a/ä.warc", b"x" * 1000), ("empty", b""), ("b", b"PK\5\6 within")]
    data = package(members, zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    f = pa.BufferReader(data)
    found = central_directory(f)
    for name, content in members:
        f.seek(data_start(f, found[name]))
        assert f.read(found[name].size) == content


def test_files_of_another_writer():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.comment = b"PK\5\6 a comment"
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"abc" * 50)
        z.writestr("packed", b"a" * 500, zipfile.ZIP_DEFLATED)
    f = pa.BufferReader(buffer.getvalue())
    found = central_directory(f)
    f.seek(data_start(f, found["big"]))
    assert f.read(found["big"].size) == b"abc" * 50
    with pytest.raises(ValueError):
        data_start(f, found["packed"])
    with pytest.raises(ValueError):
        central_directory(pa.BufferReader(b"no archive"))


def test_record():
    fields, block = parse_record(record(5, "http://a/b c", b"\r\n\r\nx", "D", None))
    assert fields["warc-type"] == "response" and block.endswith(b"\r\n\r\n\r\n\r\nx")
    fields, block = parse_record(record(4, "u", b"yy", "D", 5))
    assert fields["warc-type"] == "revisit" and fields["warc-refers-to-page"] == "5" and fields["x-payload-length"] == "2" and block.endswith(b"\r\n\r\n")


def expected(rows):
    data = [(i, (h or "").encode()) for i, h in rows]
    largest = {}
    for i, h in data:
        if i is not None:
            largest[h] = max(largest.get(h, i), i)
    out = []
    for i, h in data:
        revisit = i is not None and i < largest[h]
        out.append((i, len(h), base32_sha1(h), "revisit" if revisit else "response", largest[h] if revisit else None))
    return sorted(out, key=str)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "same"), (4, "same"), (4, "same"), (5, "é\r\n\r\nWARC/1.1"), (None, "same"), (6, "x" * 3_000_000), (7, "same"), (None, None)]
    df = spark.createDataFrame([(i, None if i == 3 else f"http://x/{i}\r\ny", h, "z") for i, h in rows], "page_id long, url string, html string, payload string")
    manifest = write_archives(df, fresh_path(spark, "warc"), max_bytes=2000)
    found = read_records(record_ranges(manifest, per_range=2)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == expected(rows)
    html = {i: h for i, h in rows}
    for r in found:
        assert bytes(r.payload).decode() == ((html[r.page_id] or "") if r.record_type == "response" else "") or r.page_id is None
    assert write_archives(df.limit(0), fresh_path(spark, "warc")).collect() == []


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(i, "u", "ab") for i in range(4)], "page_id long, url string, html string")
    kinds = {r.record_type for r in read_records(record_ranges(write_archives(df, fresh_path(spark, "warc"), min_bytes=3))).collect()}
    assert kinds == {"response"}


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()]
    assert sorted((tuple(r) for r in op4_warc(spark, sf_dir).collect()), key=str) == expected(rows)


def test_originals_by_salted_join(spark):
    rows = [(i, f"u{i}", "same" if i % 3 == 0 else None if i % 3 == 1 else f"own {i}") for i in range(60)] + [(None, None, "same"), (5, "u5", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain, spread = (sorted(map(str, with_originals(pages, 0, **how).collect())) for how in ({}, {"broadcast_rows": 0, "salts": 4}))
    assert plain == spread and len(plain) == len(rows)


def test_payloads_are_read_in_bounded_batches(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (100 + i)) for i in range(40)], "page_id long, url string, html string")
    ranges = record_ranges(write_archives(pages, f"file://{tmp_path}/w"))
    assert sorted(r.page_id for r in read_records(ranges, max_bytes=300).collect()) == list(range(40))
