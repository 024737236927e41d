import hashlib
import random

import pytest

from compare import database, of_duckdb, of_spark
from conftest import SF
from lexigrain.llm import queries
from lexigrain.llm.warc import archived_pages, chain, read_warc, write_warc


def test_against_sql(spark):
    assert of_spark(queries.op9_warc(spark, SF)) == of_duckdb(database(SF), queries.oracle_sql()["op9_warc"])


MAGIC = "WARC/1.1\r\n"
INNER = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
PAYLOADS = [None, "", "é" * 600, "é" * 600, "x" * 999, "x" * 999, "y" * 1_000, "y" * 1_000, "a" + MAGIC + "b", INNER, INNER * 3 + "WARC/1.", "\r\n\r\n" * 500, "WARC/1.0\r\n" * 300, "z" * 300_000]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    rng = random.Random(6)
    rows = [(k, f"http://x/{k}\r\nX: y", rng.choice(PAYLOADS), "clash") for k in range(150)] + [(None, None, "n" * 2_000, "clash"), (7, "u", "y" * 1_000, "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(3)
    path = str(tmp_path / "out")
    write_warc(df, path, compression=compression)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits in each file
        found = read_warc(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(found) == len(rows) and all(r.complete for r in found)
    keepers = {}
    for i, _, h, _ in rows:
        if h and len(h.encode()) >= 1_000 and i is not None:
            keepers[h] = max(keepers.get(h, i), i)
    counts = {h: sum(r[2] == h for r in rows) for h in keepers}
    want = sorted((f"<urn:x-page:{'' if i is None else i}>", *(("revisit", f"<urn:x-page:{keepers[h]}>", None) if h in keepers and counts[h] > 1 and keepers[h] != i else ("response", None, (h or "").encode())), hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h, _ in rows)
    got = sorted((r.record_id, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload), r.payload_digest, r.payload_bytes) for r in found)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert all(r.digest_ok for r in found if r.record_type == "response")


def raw(payload, ident=1, kind="resource", version="1.0"):
    return f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{ident}>\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(raw(b"one") + raw(b"\xff\xfe" + raw(b"fake", 9) + b"!", 2, version="1.1") + raw(b"", 3))
    (tmp_path / "b.warc").write_bytes(raw(b"whole", 4) + raw(b"cut off", 5)[:-8])
    (tmp_path / "c.warc").write_bytes(b"junk" + raw(b"lost", 6))
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.warc").write_bytes(raw(b"first", 7) + b"junk" + raw(b"lost", 8))
    got = {r.record_id: (r.record_type, bytes(r.payload), r.complete, r.digest_ok) for r in read_warc(spark, str(tmp_path)).collect()}
    assert set(got) == {"<1>", "<2>", "<3>", "<4>", "<5>", "<7>"}
    assert got["<2>"][1] == b"\xff\xfe" + raw(b"fake", 9) + b"!" and got["<5>"][2] is False and got["<1>"] == ("resource", b"one", True, None)
    assert all(v[2] for k, v in got.items() if k != "<5>")


def test_chain(spark):
    rows = [("f", 7 + 10 * k, 17 + 10 * k) for k in range(37)] + [("f", 12, 22), ("f", 22, 27), ("g", 8, 18), ("h", 7, 99)]
    found = {tuple(r) for r in chain(spark.createDataFrame(rows, "file string, at long, to long")).collect()}
    assert found == {("f", 7 + 10 * k) for k in range(37)} | {("h", 7)}


def test_edges(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert archived_pages(df).collect() == []
