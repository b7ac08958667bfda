import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from orbisplit.llm import queries
from orbisplit.llm import token_counts as t


def best(word, v):
    """Plain dynamic programming over one word."""
    word = t.MARK + word
    at = [(0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(at[end - 1][0] + n * v.byte_score, at[end - 1][1] - n)]
        options += [(at[s][0] + v.scores[word[s:end]], at[s][1] - 1) for s in range(end) if word[s:end] in v.scores]
        at.append(max(options))
    return -at[-1][1]


def test_trie_equals_plain_programming():
    r = random.Random(3)
    v = t.load()
    words = {"".join(r.choice("abcdeßéñ日qx-.") for _ in range(r.randrange(1, 14))) for _ in range(400)}
    words |= {"the", "theory", "theoretical", "thereof", "a", "internationalisation", "x" * 300}
    words |= {"a" * n for n in (126, 127, 128, 129, 700)} | {"theory" * 100 + c for c in "xyz"}
    for nodes in (t.NODES, 50):
        trie = t.Trie(v, nodes)
        assert {w: trie.count([w]) for w in words} == {w: best(w, v) for w in words}


def test_shared_prefixes_are_computed_once():
    trie = t.Trie(t.load())
    steps = []
    step = trie._step
    trie._step = lambda word, end, way: steps.append(word[:end]) or step(word, end, way)
    trie.count(["theory", "theories", "the", "theory", "thermal"])
    assert len(steps) == len(set(steps)) == len({(t.MARK + w)[:k] for w in ("theory", "theories", "the", "thermal") for k in range(1, len(w) + 2)})


def test_counts_equal_an_independent_tokenizer():
    v = t.load()
    pieces = sorted(v.scores)
    other = Tokenizer(models.Unigram([("<unk>", -99.0), *[(p, v.scores[p] / 1000) for p in pieces]], unk_id=0))
    words = [w for w in "the theory of international understanding and handmade reasoning".split()]
    trie = t.Trie(v)
    assert [trie.count([w]) for w in sorted(words)] == [len(other.encode(t.MARK + w).ids) for w in sorted(words)]


def test_the_query_equals_plain_programming(spark, sf_dir):
    v, known = t.load(), {}
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        known |= {w: best(w, v) for w in words if w not in known}
        want[r.doc_id] = (len(words), sum(known[w] for w in words))
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in queries.op3_token_counts(spark, sf_dir).collect()}
    assert got == want


def test_tables(spark):
    v = t.load()
    texts = [None, "", " \n", "one two two", "é ü long" + "g" * 9000, "one two two"]
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(texts)] + [(None, "one", "k")], "doc_id long, text string, k string")
    want = [(i, len((x or "").encode().split()), sum(best(w.decode(), v) for w in (x or "").encode().split())) for i, x in enumerate(texts)]
    for nodes in (t.NODES, 1):
        got = [tuple(r) for r in t.count(df, nodes=nodes).orderBy("doc_id").collect()]
        assert got == [(None, 1, best("one", v)), *want]
    assert t.count(df.where(F.lit(False))).count() == 0
    with pytest.raises(RuntimeError):
        t.load("/nowhere/x.model")
