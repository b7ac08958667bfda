import re
import time

import regex
from pyspark.sql import functions as F

from orbisplit.llm import decontaminate as d
from orbisplit.llm import queries


def tokens(text):
    """[(template, value)]: written anew, token by token."""
    text = re.sub("[\x01-\x03]", "", text or "")
    out, after_number = [], False
    for m in regex.finditer(r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{N}]+?(?=[0-9]|[^\p{L}\p{N}]|$)|[^\p{L}\p{N}]+", text):
        s = m[0]
        if re.match("[0-9]", s):
            out.append(("#", "#" + s))
            after_number = True
        elif regex.match(r"[\p{L}\p{N}]", s):
            before = text[max(0, m.start() - 2) : m.start()]
            if after_number and s.lower() in d.UNITS:
                out.append(("unit", "unit" + s.lower()))
            elif len(before) == 2 and regex.match(r"[\p{L}\p{N},] ", before) and regex.match(r"\p{Lu}\p{Ll}", s):
                out.append(("name", "name" + s.lower()))
            else:
                out.append((s.lower(), None))
            after_number = False
        elif s.strip(" ") or not after_number:
            after_number = False
    return out


def brute(docs, items, share=d.SHARE):
    out = set()
    read = [(doc, tokens(body)) for doc, body in docs]
    known = {}

    def places_of(n, size):
        """Where each template window of a document starts."""
        if (n, size) not in known:
            known[n, size] = {}
            w = [x for x, _ in read[n][1]]
            for j in range(len(w) - size + 1):
                known[n, size].setdefault(tuple(w[j : j + size]), []).append(j)
        return known[n, size]

    for item, text in set(items):
        t = tokens(text)
        size = min(len(t), d.WINDOW)
        if size < d.LEAST:
            out |= {(doc, item, 1, 1) for doc, w in read if size and [v or x for x, v in w] == [v or x for x, v in t]}
            continue
        need = d.LITERALS if size == d.WINDOW else (size + 1) // 2
        places = [i for i in range(len(t) - size + 1) if sum(v is None for _, v in t[i : i + size]) >= need]
        for n, (doc, w) in enumerate(read):
            lined = {}
            for i in places:
                for j in places_of(n, size).get(tuple(x for x, _ in t[i : i + size]), ()):
                    lined.setdefault(j - i, {})[i] = {(t[i + k][1], w[j + k][1]) for k in range(size) if t[i + k][1]}
            met = set()
            for windows in lined.values():
                pairs = set().union(*windows.values())
                met |= {i for i, own in windows.items() if not own or len({p for p, _ in pairs}) == len(pairs)}
            if places and met and 100 * len(met) >= share * len(places):
                out.add((doc, item, len(met), len(places)))
    return sorted(out)


ITEMS = [
    (1, "A train leaves the old station with Anna at 9 o'clock and travels 120 km in 2 hours, then Anna walks 3 km more."),
    (2, "What is the capital of the small island in the north?"),
    (3, "Short item here now"),
    (4, "no"),
    (5, None),
    (6, "1 2 3 4 5 6 7 8 9 10 11 12"),
    (7, "Übung macht den Meister, sagte der alte Mann und ging dann ohne ein Wort nach Hause."),
    (2, "What is the capital of the small island in the north?"),
]
DOCS = [
    (10, "Intro text. " + ITEMS[0][1] + " Outro."),
    (11, "A train leaves the old station with Berta at 7 o'clock and travels 1,240.5 miles in 5 minutes, then Berta walks 8 kg more."),
    (12, "A train leaves the old station with Berta at 7 o'clock and travels 90 km in 5 hours, then Carla walks 8 km more."),
    (13, "and what is the CAPITAL of the small island, in the north? yes"),
    (14, "What is the capital of the big island in the south?"),
    (15, "well: short item here now!"),
    (16, "9 8 7 6 5 4 3 2 1 0 1 2"),
    (17, None),
    (18, ""),
    (19, "x " * 20000 + ITEMS[6][1] + " y" * 20000),
    (10, "Intro text. " + ITEMS[0][1] + " Outro."),
    (20, ITEMS[1][1] + " " + ITEMS[0][1].replace("Anna", "Zoe") * 3),
    (21, " No!"),
    (22, "no no"),
]


def got(spark, docs, items):
    a = spark.createDataFrame([(*x, "q") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    return sorted(tuple(r) for r in d.leaks(a, b).collect())


def test_edges_equal_brute_force(spark, monkeypatch):
    want = brute(DOCS, ITEMS)
    assert got(spark, DOCS, ITEMS) == want
    found = {(x, i) for x, i, *_ in want}
    assert {(10, 1), (11, 1), (13, 2), (15, 3), (19, 7), (20, 1), (20, 2), (21, 4)} <= found
    assert not {x for x, _ in found} & {14, 16, 17, 18, 22}
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    assert got(spark, DOCS, ITEMS) == want


def test_inconsistent_slots_do_not_count(spark):
    item = [(1, "Tom gave 4 apples to Kim and then Kim gave 4 apples back to Tom")]
    docs = [(1, "so Tom gave 4 apples to Kim and then Kim gave 4 apples back to Tom"), (2, "so Max gave 4 apples to Eva and then Pia gave 9 apples back to Leo")]
    assert [x[0] for x in got(spark, docs, item)] == [1]


def test_a_value_stands_for_one_value_over_the_whole_alignment(spark):
    item = [(1, "Tom has 3 red apples in a large old box under the stairs and so he gives 3 red apples to the boy")]
    docs = [
        (1, "Tom has 7 red apples in a large old box under the stairs and so he gives 7 red apples to the boy"),
        (2, "Tom has 7 red apples in a large old box under the stairs and so he gives 9 red apples to the boy"),
        (3, "Tom has 5 red cups in a large new box under the roof and so she gives 7 blue cups to the girl"),
    ]
    assert got(spark, docs, item) == brute(docs, item)
    found = {x[0]: x[2:] for x in got(spark, docs, item)}
    assert found[1][0] == found[1][1] and 3 not in found
    assert found.get(2, (0, 0))[0] < found[1][0]  # windows with slots don't count
    short = [(1, "Tom has 3 big apples and gives 3 big apples away")]
    assert [x[0] for x in got(spark, [(1, "Tom has 7 big apples and gives 7 big apples away"), (2, "Tom has 7 big apples and gives 9 big apples away")], short)] == [1]


def test_time_is_linear_in_a_texts_words(spark):
    words = " ".join(f"w{i * 7919 % 100_003} {i % 50 if i % 40 == 0 else 'x'}" for i in range(100_000))
    docs = [(1, words + " " + ITEMS[0][1] + " " + words[:5000])]
    start = time.time()
    assert [x[:2] for x in got(spark, docs, ITEMS)] == [(1, 1)]
    assert time.time() - start < 40


def test_reversed_bindings_are_not_found(spark):
    item = [(1, "now Tom beats Kim and then Kim beats Tom and so Tom wins")]
    docs = [(1, "now Max beats Eva and then Eva beats Max and so Max wins"), (2, "now Max beats Eva and then Max beats Eva and so Eva wins")]
    assert [x[0] for x in got(spark, docs, item)] == [1]


def test_shuffled_windows_leave_the_tokens_behind(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    long = " ".join(f"w{i % 977} {i}" for i in range(10000)) + " " + ITEMS[0][1]
    a = spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = d.leaks(a, b)
    assert [tuple(r)[:2] for r in found.collect()] == [(1, 1)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = d.leaks(a, b)
        found.schema, found._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    sent = [x.split("\nInput", 1)[1].split("\n")[0] for x in plan.split("\n\n") if ") Exchange" in x and "hashpartitioning(_hash" in x]
    assert sent and all("d_slots" in x and "_w#" not in x and "_at#" not in x for x in sent)


def test_documents_equal_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = sorted(tuple(r) for r in queries.op10_decontaminate(spark, sf_dir).collect())
    assert rows == brute(docs, items) and rows


def test_clean_and_empty_tables(spark):
    a = spark.createDataFrame([(*x, "q") for x in DOCS] + [(None, DOCS[0][1], "q")], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = d.clean(a, b)
    assert kept.columns == a.columns
    assert {r.doc_id for r in kept.collect()} == {None, 14, 16, 17, 18, 22} | {12} - {x for x, *_ in brute(DOCS, ITEMS)}
    assert d.leaks(a.where(F.lit(False)), b).count() == 0 and d.leaks(a, b.where(F.lit(False))).count() == 0
    plan = d.leaks(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_items_of_slots_are_found_by_their_real_tokens(spark):
    items = [(1, "What is 3 + 4 * 5 - 6 / 2?"), (2, "1 2 3 4 5 6 7 8 9 10 11 12"), (3, "the sum of 1 2 3 4 5 6 7 8 9 10")]
    docs = [(1, "So: What is 3 + 4 * 5 - 6 / 2? It is 20."), (2, "0 1 2 3 4 5 6 7 8 9 10 11 12 13"), (3, "the sum of 1 2 3 4 5 6 7 8 9 10"), (4, "What is 3 + 4 * 5 - 7 / 2? 5 4 3 2 1 9 8 7")]
    assert got(spark, docs, items) == [(1, 1, 1, 1), (2, 2, 5, 5), (2, 3, 3, 6), (3, 2, 3, 5), (3, 3, 6, 6)]


def test_verbatim_items_are_found_in_any_surroundings(spark):
    items = [(1, "Where does the red fox live?"), (2, "In the morning our friend Anna\twalks to the old mill by the river")]
    docs = [(1, "and so on Where does the red fox live?"), (2, "In the morning our friend\nAnna  walks to the old mill\nby the river"), (3, "In the morning our friend Berta rests")]
    assert got(spark, docs, items) == [(1, 1, 1, 1), (2, 2, 7, 7)]
