import base64
import gzip
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from orbisplit.llm import queries, warc


def brute(rows, least=0):
    out, seen = [], {}
    for page, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = seen.setdefault(digest, page) if (new := digest not in seen) else seen[digest]
        same = not new and len(raw) >= least and first is not None
        out.append((page, len(raw), digest, "revisit" if same else "response", first if same else None))
    return sorted(out, key=str)


ROWS = [
    (3, "http://b.example.org/x?q=1", "<p>same</p>"), (1, "http://a.example.org/", "<p>same</p>"), (2, None, None), (4, "", ""),
    (5, "https://Ü.example.org/a b\n\\c %20: y", "ü" * 50000), (6, "no scheme", "ü" * 50000), (7, "http://b.example.org/x?q=1", "other\r\n\r\nWARC/1.1\r\n"),
    (7, "http://b.example.org/x?q=1", "other\r\n\r\nWARC/1.1\r\n"), (None, "http://n.example/", "<p>same</p>"), (None, None, "lonely"), (9, "z" * 5000, "z"),
]


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip_equals_brute_force(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 2)
    df = spark.createDataFrame([(*r, "k") for r in ROWS], "page_id long, url string, html string, key string").repartition(3)
    got = [tuple(r) for r in warc.round_trip(spark, df, least).collect()]
    assert sorted(got, key=str) == brute([(p, h) for p, _, h in ROWS], least)


def test_table_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted([tuple(r) for r in queries.op6_warc(spark, sf_dir).collect()], key=str) == brute(rows)


def test_archives_are_plain_warc_and_the_index_is_sparse(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    lines, index = warc.archive(df, f"file://{tmp_path}")
    rows = sorted(lines.collect(), key=lambda r: (r.key, r.row))
    assert len(rows) == len(ROWS) and list(index.top) == sorted(index.top)
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(tmp_path.glob("*.warc.gz")))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)
    reader = warc.Reader(index)
    for r in rows:
        found = reader.record(r.key, r.row)
        assert found["page_id"] == r.page_id and reader.line(r.key, r.row) == (r.archive, r.offset, r.length)
    urls = sorted((u or "") for _, u, _ in ROWS)
    assert sorted(reader.record(r.key, r.row)["url"] for r in rows) == urls
    for key in ("", "zzz", rows[0].key):
        with pytest.raises(KeyError):
            reader.record(key, "missing")
    assert not list(tmp_path.glob(".*"))


def test_keys_put_domains_side_by_side(spark):
    df = spark.createDataFrame([("http://b.A.org/p?q",), ("a.org",), (None,)], "url string")
    assert [r.k for r in df.select(warc.sort_key(F.col("url")).alias("k")).collect()] == ["org,a,b)/p?q", ")a.org", ")"]


def test_a_second_attempt_leaves_one_whole_file(tmp_path):
    for _ in range(2):
        w = warc.Writer(f"file://{tmp_path}", "x")
        assert w.add(b"abc") == (0, 3) and w.add(b"d") == (3, 1)
        w.close()
    assert [p.name for p in tmp_path.iterdir()] == ["x"] and (tmp_path / "x").read_bytes() == b"abcd"


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(spark, df).count() == 0


def test_damage_is_found():
    page = {"record_type": "response", "url": "u", "row": "r", "page_id": 1, "payload_digest": warc.digest_of(b"x"), "payload_bytes": 1, "refers_to": None}
    raw = warc.record(page, b"x")
    assert warc.parse(raw)["payload"] == b"x"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"\r\n\r\nx", b"\r\n\r\ny"))
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1\r\n\r\n")


#: The query's columns in SQL. It is no registered check, since a column of nulls alone has another type in each engine's frames.
BY_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT *, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first_id FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


def test_the_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    got = [tuple(r) for r in queries.op6_warc(spark, sf_dir).collect()]
    assert sorted(got) == sorted(con.execute(BY_SQL).fetchall()) and got
