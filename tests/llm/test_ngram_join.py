import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbisplit.llm import ngram_join as j
from orbisplit.operators.components import components, extended


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def merged(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    root = merged(range(len(rows)), links)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root[i]] = min(least.get(root[i], doc), doc)
    return sorted([(doc, len(s), least.get(root[i]) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))], key=str)


def fixture(seed):
    r = random.Random(seed)
    text = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    rows = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "a b c d e"), (6, "a b c d e f"), (None, "a b"), (None, "null only one two"), (None, None)]
    passage = text(40)
    for group in range(6):
        base = text(r.choice([8, 20, 60, 150]))
        for i in range(12):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = "new" + str(r.randrange(9))
            if r.random() < 0.3:
                w = w[: -r.randrange(1, 4)]
            rows.append((1000 - 20 * group - i, " ".join(w)))
        rows.append((100 + group, " ".join(passage + text(6))))
        rows.append((200 + group, " ".join(passage + text(70))))
    # A chain: each text is near the next one only.
    long = text(400)
    rows += [(2000 + i, " ".join(long[i * 12 : i * 12 + 100])) for i in range(20)]
    rows += [(50, rows[12][1]), (1000, rows[9][1]), (1000, "same id, other text " + rows[9][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = fixture(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, set int").repartition(3)
    assert sorted([tuple(x) for x in j.join(df).collect()], key=str) == brute(rows)


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([(1, "x y " * 30000), (2, "x y " * 29000), (3, "z " * 9)], "doc_id long, text string")
    assert sorted(tuple(r) for r in j.join(df).collect()) == [(1, 2, 1), (2, 2, 1), (3, 1, 3)]
    assert j.join(df.where(F.lit(False))).count() == 0


def test_components_equal_union_find(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(500, i) for i in range(501, 560)]
    edges += [(7, 7), (-5, -9)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == merged(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chain", [(1, 5, 2, 6, 0), (3, 4, 0, 5, 1), (2, 6, 0, 5, 3, 4, 1)])
def test_components_of_chains(spark, chain):
    edges = list(zip(chain, chain[1:]))
    got = sorted((x.node, x.label) for x in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == [(n, 0) for n in sorted(chain)]


def test_components_of_many_chains(spark):
    r = random.Random(9)
    edges = []
    for k in range(200):
        chain = r.sample(range(10 * k, 10 * k + 10), r.randrange(3, 9))
        edges += zip(chain, chain[1:])
    got = sorted((x.node, x.label) for x in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == sorted(merged({n for e in edges for n in e}, edges).items())


def test_chain_of_five_texts_is_one_component(spark):
    # Texts whose classes are ordered as 1-5-2-6-0 along the chain.
    r = random.Random(4)
    while True:
        long = [f"w{r.randrange(10**6)}" for _ in range(148)]
        texts = [" ".join(long[i * 12 : i * 12 + 100]) for i in range(5)]
        cls = [j._class(s) for s in j._sets(pa.array(texts), j.SIZE)]
        if [sorted(cls).index(c) for c in cls] == [1, 3, 2, 4, 0]:
            break
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((x.doc_id, x.component_id) for x in j.join(df).collect()) == [(i, 0) for i in range(5)]
    assert [x.doc_id for x in j.first_of_groups(df).collect()] == [0]


@pytest.mark.parametrize("local", [0, 1 << 17])
def test_components_and_more_links(spark, local):
    r = random.Random(11)
    old = [(r.randrange(-50, 90), r.randrange(-50, 90)) for _ in range(60)]
    new = [(r.randrange(-90, 120), r.randrange(-90, 120)) for _ in range(40)] + [(3, 3)]
    edges = lambda e: spark.createDataFrame(e, "a long, b long")
    labels = components(edges(old), local=local)
    expected = lambda es: merged({n for a, b in es if a != b for n in (a, b)}, [e for e in es if e[0] != e[1]])
    assert sorted((x.node, x.label) for x in labels.collect()) == sorted(expected(old).items())
    got = extended(labels, edges(new), local)
    assert sorted((x.node, x.label) for x in got.collect()) == sorted(expected(old + new).items())
    assert extended(components(edges([])), edges([])).count() == 0


def test_few_links_take_few_jobs(spark):
    long = [(i, i + 1) for i in range(2000)]
    spark.sparkContext.setJobGroup("few", "")
    got = components(spark.createDataFrame(random.Random(2).sample(long, 2000), "a long, b long")).where("label = 0").count()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few")
    spark.sparkContext.setJobGroup("rest", "")
    assert got == 2001
    assert len(jobs) <= 8
