import corpus_pipeline
from tests.llm import test_decontaminate, test_mixing, test_ngram_join, test_quality_rules, test_secret_scan

from orbisplit.llm import mixing, ngram_join


def names(docs):
    return [tuple(r) for r in docs.collect()]


def by_hand(rows, items):
    """rows: (doc_id, text, lang, source). The five stages written anew, with the operators' own brute-force versions."""
    kept = []
    for r in rows:
        n, chars, symbols, lines, repeats = test_quality_rules.brute(r[1])
        w = test_quality_rules.split(r[1] or "")
        with_words = sum(1 for x in (r[1] or "").split("\n") if test_quality_rules.split(x))
        upper = sum(c.isupper() for c in r[1] or "")
        bad = n < 20 or 100 * repeats > 30 * n or 10 * symbols > n or (lines >= 3 and 100 * lines > 30 * with_words)
        bad = bad or 10 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > 2 * n or 2 * upper > chars or not 2 * n <= chars <= 16 * n
        kept += [] if bad else [r]
    groups = {doc: c for doc, _, c in test_ngram_join.brute([r[:2] for r in kept])}
    kept = [r for r in kept if groups[r[0]] == r[0]]
    leaked = {doc for doc, *_ in test_decontaminate.brute([r[:2] for r in kept], items)}
    kept = [r for r in kept if r[0] not in leaked]
    out = []
    for doc, text, lang, source in kept:
        spans = [(a, b, k) for k, a, b in test_secret_scan.brute(text)]
        parts, at, stretch = [], 0, None
        for a, b, k in [*spans, (len(text) + 1, 0, "")]:
            if stretch and a < stretch[1]:
                stretch = (stretch[0], max(stretch[1], b), stretch[2])
                continue
            if stretch:
                parts += [text[at : stretch[0]], f"[REDACTED:{stretch[2]}]"]
                at = stretch[1]
            stretch = (a, b, k)
        domain = ["web", "books", "news", "forum"][int(source[3:]) % 4]
        out.append((doc, "".join([*parts, text[at:]]), lang, source, domain))
    return test_mixing.brute(out, mixing.Targets())


def test_pipeline_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted([(r.doc_id, r.text, r.epochs) for r in got.collect()], key=str) == by_hand(rows, items)


def test_stages_keep_the_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema == docs.schema
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).columns == [*docs.columns, "domain", "n_tokens", "epochs"]


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(2, text), (1, text.upper()), (3, text + " x"), (4, "other words here"), (4, "other words here"), (None, text), (None, "n"), (5, None)]
    kept = ngram_join.first_of_groups(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, _r int"))
    assert sorted(names(kept), key=str) == sorted([(1, text.upper(), 0), (4, "other words here", 0), (None, text, 0), (None, "n", 0), (5, None, 0)], key=str)


def test_other_texts_under_a_key_that_goes_stay(spark):
    t, u, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "tuyz")
    rows = [(1, t, 1), (5, t, 2), (5, u, 3), (6, z, 4), (6, y, 5), (7, y + " end", 6), (6, z, 3), (8, u + " more", 0), (8, u + " else", 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, _set int")
    for parts in (1, 5):
        kept = ngram_join.first_of_groups(df.repartition(parts))
        assert kept.schema == df.schema
        assert sorted(names(kept)) == [(1, t, 1), (5, u, 3), (6, y, 5), (6, z, 3)]


def test_two_near_texts_under_one_key_leave_one(spark):
    a = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(3, a), (3, a + " end"), (9, a + " tail")], "doc_id long, text string")
    kept = ngram_join.first_of_groups(df).collect()
    assert len(kept) == 1 and kept[0].doc_id == 3


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, blank and very long texts, repeated rows and ids, clashing names: each stage gives what the docstring says."""
    words = lambda c, n: " ".join(f"{c}{i % 89}{chr(97 + i % 7)}" for i in range(n))
    plain = "the old miller walked slowly over the {} bridge and told a long story about his youngest daughter who sails {} boats at sea"
    rows = [
        (1, None, "en", "src1"), (2, " \n", "en", "src1"), (3, plain.format("red", "big"), None, None), (3, plain.format("red", "big"), None, None),
        (4, plain.format("red", "big"), "en", "src2"), (5, " ".join(f"{a}w{i}" for i, a in enumerate("xyz" * 20000)), "de", "src3"), (None, plain.format("blue", "tiny"), "en", "src1"),
        (None, None, None, None), (6, "another tale of a quiet harbour where nobody ever asked why the lamps were lit at noon on every day", "en", "src0"),
        (6, "some other words under this very id tell of mountains rivers and the people who once lived between them all", "en", "src0"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    odd = spark.createDataFrame(rows, schema).selectExpr("*", "1 as n_chars", "'k' as _set", "'k' as c0", "'k' as domain", "'k' as kept", "'k' as failed")
    items = spark.createDataFrame([(1, None), (None, " "), (3, "no such question was ever asked of anyone here before now")], "item_id long, text string")
    items.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    odd.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert [r.doc_id for r in corpus_pipeline.quality(spark, odd, str(tmp_path)).orderBy("doc_id").collect()] == [None, 3, 3, 4, 5, 6, 6]
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert got.columns[: len(odd.columns)] == odd.columns
    left = corpus_pipeline.secrets(spark, corpus_pipeline.decontamination(spark, corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, odd, ""), ""), f"file://{tmp_path}"), "")
    # The row without an id is near 3 and 4, and stays.
    assert sorted((r.doc_id or 0 for r in left.collect())) == [0, 3, 5, 6, 6]
    assert {r.doc_id for r in got.collect()} <= {None, 3, 5, 6}
    empty = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, f"file://{tmp_path}").count() == 0
