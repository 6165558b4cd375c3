import base64
import glob
import hashlib
import tempfile

import spindle.llm.warc as W
from spindle.llm.queries import REGISTRY


def brute(rows):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out, used = [], set()
    for i, h in rows:
        raw = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        w = first.get(h or "")
        response = i == w and (h or "") not in used
        if response:
            used.add(h or "")
        out.append((i, len(raw), d, "response" if response else "revisit", None if response else w))
    return sorted(out, key=repr)


def test_query(spark, sf="/root/testdata/sf0.001"):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = REGISTRY["op7_warc"](spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_odd_rows_rolling_and_determinism(spark, monkeypatch):
    monkeypatch.setattr(W, "SHARD_BYTES", 40_000)
    rows = [(i, f"page {i % 40}" + "é\r\n\r\n x" * (i % 40)) for i in range(300)]
    rows += [(None, None), (500, ""), (501, None), (7, rows[7][1]), (None, "page 3é"), (None, "alone"), (None, "alone"), (502, "q" * 3_000_00)]
    df = spark.createDataFrame([(i, f"http://x/é \n{i}" if i != 500 else None, h, "c") for i, h in rows], "page_id long, url string, html string, digest string")
    a, b = tempfile.mkdtemp(), tempfile.mkdtemp()
    W.write_warc(df, a, roll=2000)
    manifest = W.write_warc(df.repartition(3), b, roll=2000).collect()
    files = sorted(f.split("/")[-1] for f in glob.glob(a + "/*.warc.gz"))
    assert files == sorted(r.final for r in manifest) and len(files) > 5
    assert sum(r.records for r in manifest) == len(rows)
    assert all(W.sha1_base32(open(f"{a}/{f}", "rb").read()) for f in files)
    got = W.archive_pages(df).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    payloads = {r.page_id: bytes(r.payload).decode() for r in W.read_warc(spark, a).where("payload is not null and page_id is not null").collect()}
    assert payloads[0] == rows[0][1] and payloads[502] == "q" * 3_000_00


def test_least_and_empty(spark, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in W.archive_pages(df, least=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}
    assert W.archive_pages(df.limit(0)).collect() == []


def test_second_write_replaces_the_first(spark, tmp_path):
    folder = str(tmp_path / "again")
    rows = lambda ids: spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * 50) for i in ids], "page_id long, url string, html string")
    ids = lambda: sorted(r.page_id for r in W.read_warc(spark, folder).collect())
    W.write_warc(rows(range(30)), folder, roll=300)
    assert ids() == list(range(30))
    before = len(glob.glob(folder + "/*.warc.gz"))
    manifest = W.write_warc(rows(range(100, 103)), folder, roll=300).collect()
    assert ids() == [100, 101, 102] and sum(m.records for m in manifest) == 3
    assert sorted(m.final for m in manifest) == sorted(f.split("/")[-1] for f in glob.glob(folder + "/*.warc.gz"))
    assert before > len(manifest) and not glob.glob(folder + "/.part-*")
    W.write_warc(rows([]), folder)
    assert ids() == []
