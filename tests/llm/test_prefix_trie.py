"""The prefix trie against SQL and a plain trie; heavy levels, cut conversations, odd rows."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from orbisplit.llm import prefix_trie as pt
from orbisplit.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, K1 int, place string, depth int, a int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


def plain(rows):
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    seq = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    nodes = {}
    for c, s in seq.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for s in nodes:
        if s:
            kids[s[:-1]] += 1
    for s, m in nodes.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += kids[s] == 0
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
    ends = lambda s: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[s] if len(seq[c]) == len(s)))).encode()).hexdigest()
    return sorted((min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], ends(s)) for s, m in nodes.items())


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql_and_a_plain_trie(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    df = queries.QUERIES["op12_prefix_trie"](spark, d)
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.SQL['op12_prefix_trie']})").fetchall(), key=lambda r: (r[0], r[1]))
    assert got(df) == want
    assert want == sorted(plain(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("shard", [7, 1 << 16])
def test_large_groups_at_any_size_of_shard(spark, shard):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(400):
        kind = c % 4
        if kind == 0:  # copies of one conversation
            said = [f"s{i}" for i in range(12)]
        elif kind == 1:  # one first turn, then anything
            said = ["s0"] + [f"x{rng.integers(3)}" for _ in range(rng.integers(0, 15))]
        else:
            said = [f"é{rng.integers(2)}" for _ in range(rng.integers(1, 12))]
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(said)]
    rows += [(1000, i, "user", f"long{i // 2}") for i in range(300)]
    assert got(pt.trie(frame(spark, rows), shard)) == sorted(plain(rows), key=lambda r: (r[0], r[1]))


def test_odd_rows(spark):
    rows = [
        (3, None, None, None), (3, 1, "user", "a"), (3, None, None, None), (4, 0, "user", ""), (None, 0, "user", "lost"), (7, 2, "user", "b"), (7, 1, "user", "c"),
        (23, 0, "user", "a"), (20, 0, "user", "long " * 50_000), (24, 5, None, "a"), (-3, 0, "user", "a"), (-5, 0, "user", "z"), (-5, 1, "user", "y"),
    ]
    assert got(pt.trie(frame(spark, rows))) == sorted(plain(rows), key=lambda r: (r[0], r[1]))
    assert got(pt.trie(frame(spark, []))) == []
    assert got(pt.trie(frame(spark, [(None, 0, "user", "lost")]))) == []
    assert len(got(pt.trie(frame(spark, [(5, i % 3, "user", "same") for i in range(9)])))) == 10


def test_louds_parents():
    parent = np.array([-1, 0, 0, 0, 1, 1, 3, 4, 6])
    bits, degree = pt.louds(parent)
    assert degree.tolist() == [3, 2, 0, 1, 1, 0, 1, 0, 0]
    assert "".join("10"[not b] for b in bits) == "11101100101001000"
    assert pt.parents(bits).tolist() == parent[1:].tolist()


def test_a_nodes_members_come_in_pieces(spark):
    ends = spark.createDataFrame([(1, 2, 3, c) for c in range(5000)] + [(4, 5, 6, 7)], "k1 long, k2 long, k3 long, conv_id long")
    found = {r.k1: r.ends_sha256 for r in pt.members(ends, piece=500).collect()}
    assert found == {1: hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest(), 4: hashlib.sha256(b"7").hexdigest()}
