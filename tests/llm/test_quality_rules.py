from orbisplit.llm import quality_rules as q

WORD_BREAK = " \t\n\v\f\r"


def split(text):
    out, word = [], ""
    for c in text:
        if c in WORD_BREAK:
            out, word = (out + [word] if word else out), ""
        else:
            word += c
    return out + [word] if word else out


def brute(text):
    text = text or ""
    w = split(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h a b c d e f g h", "x " * 50, "line\nline\nline\n\n \nother",
    "é ü\u00a0ñ # * $ | <b> & %", "p q r s t u v w x y z p q r s t u v w x y z tail end " * 2, "A B C\r\nD\x0bE\x0cF", "w " * 7 + "w",
]


def test_measurements_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    got = {r.doc_id: tuple(r)[1:6] for r in q.ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert {k: v[:5] for k, v in got.items()} == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_long_text_and_repeated_rows(spark):
    long = " ".join(f"w{i % 9000}" for i in range(20000))
    docs = spark.createDataFrame([(1, long), (1, long), (None, "short")], "doc_id long, text string")
    rows = q.ledger(docs).orderBy("doc_id").collect()
    assert [r.n_words for r in rows] == [1, 20000, 20000]
    assert rows[1].n_repeat_words == 20000 and rows[1] == rows[2]


def test_policies_and_ablations_are_bit_arithmetic(spark):
    book = spark.createDataFrame([(0,), (0,), (1,), (3,), (4,), (4,)], "failed_bits long")
    policy = q.Policy("p", 1, ("few_words", "symbols"))
    assert q.mask(policy) == 5
    assert [r.kept for r in q.apply_policy(book, policy).orderBy("failed_bits").collect()] == [True, True, False, False, False, False]
    got = {r.rule: tuple(r)[1:] for r in q.ablations(book, policy).collect()}
    assert got == {"few_words": (2, 2, 4), "symbols": (2, 2, 4)}


def test_empty_table_and_keep(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert q.ledger(docs).count() == 0 and q.keep(docs).columns == docs.columns
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs = spark.createDataFrame([(1, good, "x"), (2, "few", "y"), (3, None, None)], "doc_id long, text string, kept string")
    assert [tuple(r) for r in q.keep(docs).collect()] == [(1, good, "x")]


def test_no_python_and_no_shuffle(spark, sf_dir):
    plan = q.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
