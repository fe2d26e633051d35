import hashlib
import io
import struct

import pytest
import zstandard
from pyarrow import fs

from skriva.llm import warc as W

from . import edge


def pages(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (1, "http://a/", "<p>é</p>"), (2, None, None), (None, "http://b/\r\nX: y", ""), (3, "u", "z" * 1_500_000), (4, "u", "<html>\r\n\r\nWARC/1.1\r\n</html>")]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, frame int"), rows


def test_round_trip_and_bundle_format(spark, tmp_path):
    df, rows = pages(spark)
    path = f"file://{tmp_path}/w"
    index = W.write_bundles(df.coalesce(1), path, bundle_bytes=1 << 20)
    back = W.read_records(index, path).collect()
    assert sorted((str(r.id), bytes(r.payload).decode()) for r in back) == sorted((str(i), t or "") for i, _, t in rows)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.sha1 for r in back)
    assert len({(r.bundle, r.frame, r.record_offset) for r in back}) == len(rows) and len({r.record_id for r in back}) == len(rows) - 1
    for bundle in {r.bundle for r in back}:
        raw = (tmp_path / "w/bundles" / bundle).read_bytes()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()  # any zstd reader skips the table
        own = sorted((r for r in back if r.bundle == bundle), key=lambda r: (r.frame, r.record_offset))
        assert len(plain) == sum(r.record_length for r in own) and plain.startswith(b"WARC/1.1\r\n")
        count, _, magic = struct.unpack("<IBI", raw[-9:])
        assert magic == W.FOOTER and count == own[-1].frame + 1
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "w/bundles" / bundle)) as f:
            table = W.read_seek_table(f)
        assert [t[0] for t in table] == sorted({r.frame_offset for r in own}) and sum(t[2] for t in table) == len(plain)
    r = next(r for r in back if r.id == 4)
    one = W.read_record(path, r.bundle, r.frame, r.record_offset, r.record_length)
    assert W.payload_of(one).decode() == rows[-1][2] and f"<{r.record_id}>".encode() in one
    assert not [p for p in (tmp_path / "w/bundles").iterdir() if not p.name.endswith((".zst", ".crc"))]


def test_headers_hold_one_line_each():
    _, _, raw = W.record(1, "http://b/\r\nX: y", b"body")
    head = raw.split(b"\r\n\r\n")[0].split(b"\r\n")
    assert b"WARC-Target-URI: http://b/%0D%0AX: y" in head and b"Content-Length: 4" in head and head[0] == b"WARC/1.1"


def test_not_a_bundle(tmp_path):
    (tmp_path / "x").write_bytes(b"0" * 50)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as f, pytest.raises(ValueError):
        W.read_seek_table(f)


def test_edge_cases(spark, tmp_path):
    docs = edge.table(spark)
    index = W.write_bundles(docs, f"file://{tmp_path}/e", "doc_id", "source", "text")
    back = W.read_records(index, f"file://{tmp_path}/e").collect()
    assert sorted((str(r.id), bytes(r.payload).decode()) for r in back) == sorted((str(i), t or "") for i, t, *_ in edge.ROWS)
    nothing = W.write_bundles(edge.empty(spark), f"file://{tmp_path}/n", "doc_id", "source", "text")
    assert nothing.count() == 0 and W.read_records(nothing, f"file://{tmp_path}/n").count() == 0


def test_query(spark):
    rows = W.query(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 50 and all(r.intact for r in rows)


def test_stores_and_spare_files(spark, tmp_path):
    assert W.filesystem("s3a://bucket/x/bundles?region=us-east-1")[1] == "bucket/x/bundles" and W.filesystem(f"file://{tmp_path}")[1] == str(tmp_path)
    df, rows = pages(spark)
    with pytest.raises(NotImplementedError):
        W.write_bundles(df, "wasbs://c@a.blob/x")
    (tmp_path / "w/bundles").mkdir(parents=True)
    (tmp_path / "w/bundles/part-000000-0000.warc.zst.0123").write_bytes(b"a task that was lost")
    W.write_bundles(df, f"file://{tmp_path}/w")
    assert all(p.name.endswith(".warc.zst") for p in (tmp_path / "w/bundles").iterdir())
