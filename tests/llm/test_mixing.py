import hashlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from orbisplit.llm import mixing as m


def fill(children, budget):
    """children: name -> (cap, weight). Water-filling in exact numbers, then rounded down."""
    open_, alloc = dict(children), {}
    while open_:
        level = Fraction(budget - sum(alloc.values()), sum(w for _, w in open_.values()))
        full = {n: c for n, (c, w) in open_.items() if c <= w * level}
        if not full:
            alloc |= {n: int(w * level) for n, (_, w) in open_.items()}
            break
        alloc |= full
        for n in full:
            del open_[n]
    return alloc


def brute(rows, t):
    """rows: (doc_id, text, lang, source, domain) -> how often each row is taken."""
    tree = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    size = lambda x: len((x or "").split())
    key = lambda r: tuple(x or "unknown" for x in (r[4], r[2], r[3]))
    for r in rows:
        d, lang, s = key(r)
        tree[d][lang][s] += size(r[1])
    weight = lambda level, n: getattr(t, level).get(n, t.other)
    total = sum(size(r[1]) for r in rows) if t.budget is None else t.budget
    leaf = lambda x: x * t.max_epochs
    cap = lambda x: sum(map(cap, x.values())) if isinstance(x, dict) else leaf(x)
    alloc = {}
    top = fill({d: (cap(x), weight("domain", d)) for d, x in tree.items()}, total)
    for d, langs in tree.items():
        mid = fill({n: (cap(x), weight("lang", n)) for n, x in langs.items()}, top[d])
        for n, sources in langs.items():
            low = fill({s: (leaf(x), weight("source", s)) for s, x in sources.items()}, mid[n])
            alloc |= {(d, n, s): a for s, a in low.items()}
    out = []
    for k, a in alloc.items():
        own = [r for r in rows if key(r) == k]
        tokens = sum(size(r[1]) for r in own)
        full = a // tokens if tokens else 0
        rest = a - full * tokens
        place = lambda r: int(hashlib.md5(f"{t.seed}:{full}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)  # noqa: B023,E731
        order = lambda r: (place(r), -1 if r[0] is None else r[0], size(r[1]))  # noqa: B023,E731
        for r in own:
            upto = sum(size(x[1]) for x in own if order(x) <= order(r))
            e = full + (rest > 0 and upto <= rest)
            if e:
                out.append((r[0], r[1], e))
    return sorted(out, key=str)


ROWS = [(i, "w " * (i % 13), ["en", "de", None][i % 3], f"src{i % 5}", ["web", "books", "x", None][i * 7 % 4]) for i in range(300)]
ROWS += [(7, "twice twice", "en", None, "web")] * 2 + [(None, "no id", "fr", "src1", "web"), (400, None, "en", "src9", "web"), (401, " ", "en", "src9", "zero")]


@pytest.mark.parametrize("budget, epochs", [(None, 4), (500, 1), (0, 3), (10**9, 2), (1000, 100)])
def test_equals_brute_force(spark, budget, epochs):
    t = m.Targets(domain={"web": 6, "books": 3}, lang={"en": 3, "de": 1}, source={"src1": 2}, budget=budget, max_epochs=epochs)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, domain string")
    got = m.mix(df, t, domain=F.col("domain"))
    assert got.columns == [*df.columns, "_domain", "n_tokens", "epochs"]
    assert sorted([(r.doc_id, r.text, r.epochs) for r in got.collect()], key=str) == brute(ROWS, t)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000)], "domain string, lang string, source string, tokens long")
    t = m.Targets(domain={}, lang={}, source={}, budget=400, max_epochs=1)
    got = {r.source: r.alloc for r in m.allocate(leaves, t).collect()}
    assert got == {"s1": 10, "s2": 90, "s3": 100, "s4": 200}


def test_empty_table_and_no_python(spark, sf_dir):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert m.mix(df).count() == 0
    plan = m.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan


def test_joins_without_broadcast_hints(spark, monkeypatch):
    monkeypatch.setattr(m, "BROADCAST_LEAVES", 0)
    t = m.Targets(domain={"web": 6}, budget=700)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, domain string")
    assert sorted([(r.doc_id, r.text, r.epochs) for r in m.mix(df, t, domain=F.col("domain")).collect()], key=str) == brute(ROWS, t)
