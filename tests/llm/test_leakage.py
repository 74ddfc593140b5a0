"""Leaked passages against a comparison of all word runs."""

import random
import re

from seqloom.llm import leakage

DOC, ITEM = "doc_id long, text string, item_id long, part string", "item_id long, suite string, question string, answer string"
VOCAB = ["alpha", "Beta", "gamma", "delta's", "épée", "x1", "42", "straße", "and", "the"]


def runs(text, n=13):
    w = [x.lower() for x in re.findall(r"[^\W_]+", text or "")]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def data():
    rng = random.Random(4)
    say = lambda n: rng.choice([" ", ", ", "\n", " - "]).join(rng.choice(VOCAB) + str(rng.randrange(30)) for _ in range(n))
    items = [(i, "s", say(rng.randrange(5, 60)), rng.choice(["b", None, "yes no", say(20)])) for i in range(30)]
    items += [(30, "s", None, None), (31, "s", "", ""), (32, "s", items[0][2], "b"), (33, "s", "one two three", "b")]
    docs = []
    for i in range(120):
        text = say(rng.randrange(0, 80))
        if rng.random() < 0.5:
            q = rng.choice(items)[2] or ""
            w = q.split()
            a = rng.randrange(0, max(1, len(w)))
            text += " >> " + " ".join(w[a : a + rng.randrange(5, 40)]).upper() + "! " + say(10)
        docs.append((i, text, 0, "x"))
    docs += [(120, None, 0, ""), (121, "", 0, ""), (122, "word " * 200_000 + (items[1][2] or ""), 0, "")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = data()
    out = leakage.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    got = {(r["doc_id"], r["item_id"]) for r in out if r["part"] == "question"}
    q = {i: runs(t) for i, _, t, _ in items}
    want = {(d, i) for d, t, *_ in docs for i in q if runs(t) & q[i]}
    assert got == want and len(want) > 10
    text = {d: t for d, t, *_ in docs}
    for r in out:
        if r["part"] == "question":
            piece = text[r["doc_id"]][r["start_char"] : r["end_char"]]
            w = [x.lower() for x in re.findall(r"[^\W_]+", piece)]
            assert len(w) == r["n_words"] >= 13 and runs(piece) <= q[r["item_id"]]


def test_portions_agree(spark, monkeypatch):
    docs, items = data()
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    one = sorted(tuple(r) for r in leakage.leaks(d, i).collect())
    monkeypatch.setattr(leakage, "MAX_PATTERN_CHARS", 5000)
    assert sorted(tuple(r) for r in leakage.leaks(d, i).collect()) == one


def test_every_place_of_a_short_answer(spark):
    question = " ".join(f"w{i}" for i in range(14))
    items = [(1, "s", question, "yes, Sir"), (2, "s", "w " * 20, "yes")]
    docs = [(1, f"Yes sir! {question}; yes SIR yes sir", 0, ""), (2, "yes sir", 0, "")]
    out = leakage.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).where("part = 'short answer'").collect()
    text = docs[0][1]
    assert sorted((r["doc_id"], r["item_id"], text[r["start_char"] : r["end_char"]].lower()) for r in out) == [(1, 1, "yes sir")] * 3


def test_one_scan_and_one_automaton_for_many_items(spark):
    rng = random.Random(1)
    plain = [w for w in VOCAB if w.isalnum()]
    items = [(i, "s", " ".join(f"{rng.choice(plain)}{rng.randrange(500)}" for _ in range(45)), "b") for i in range(14_000)]
    docs = [(i, "x " + " ".join(items[i * 7][2].split()[3 : 3 + n]) + " y", 0, "") for i, n in enumerate([12, 13, 14, 20] * 50)]
    out = leakage.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sum(len(q) + 1 for _, _, q, _ in items) < leakage.MAX_PATTERN_CHARS
    got = {(r["doc_id"], r["item_id"], r["n_words"]) for r in out.where("part = 'question'").collect()}
    assert {(d, i) for d, i, _ in got} == {(i, i * 7) for i, n in enumerate([12, 13, 14, 20] * 50) if n > 12}
    index = leakage.Index([(i, q, a) for i, _, q, a in items], 13)
    assert len(index.automaton) <= 14_000 * 6 + 1


def test_empty(spark):
    docs, items = data()
    assert leakage.leaks(spark.createDataFrame([], DOC), spark.createDataFrame(items, ITEM)).count() == 0
    assert leakage.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame([], ITEM)).count() == 0
