"""Packed fields against a plain reader written from the rules."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from seqloom.operators import packed
from tests.conftest import rows

SCHEMA = "id long, f string, _items string, item string, error string"


def allowed(c, blank_cuts):
    return c.isalpha() or c.isdigit() or c in ".:%-" or (c == " " and not blank_cuts)


def bracket(text, i):
    """End of the bracket at i, or None; brackets of any depth may stand inside."""
    depth, j = 0, i
    while j < len(text):
        depth += (text[j] == "(") - (text[j] == ")")
        j += 1
        if depth == 0:
            return j
    return None


def quoted(text, i, blank_cuts):
    q, j = text[i], i + 1
    while j < len(text):
        if text[j] == q:
            if text[j + 1 : j + 2] == q:
                j += 2
                continue
            k = j + 1
            while not blank_cuts and text[k : k + 1] == " ":
                k += 1
            if k == len(text) or not (allowed(text[k], blank_cuts) or text[k] == "("):
                return j + 1
            return None
        j += 1
    return None


def plain(text, blank_cuts=False):
    out, i = [], 0
    while i < len(text):
        end = quoted(text, i, blank_cuts) if text[i] in "\"'" else None
        if end:
            q = text[i]
            out.append(text[i + 1 : end - 1].replace(q + q, q).strip(" "))
            i = end
            continue
        j = i
        while j < len(text):
            if allowed(text[j], blank_cuts):
                j += 1
            elif text[j] == "(" and (z := bracket(text, j)):
                j = z
            else:
                break
        if j > i:
            out.append(text[i:j].strip(" "))
        i = max(j, i + 1)
    return [x for x in out if x]


def run(spark, texts, blank_cuts=False):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)
    got = {}
    for _, i, pos, item, _, _, _ in rows(packed.unpack(df, "f", "id", "t.f", blank_cuts)):
        got.setdefault(i, {})[pos] = item
    return [[got[i][p] for p in range(1, len(got[i]) + 1)] if i in got else [] for i in range(len(texts))]


def test_stated_cases(spark):
    texts = [
        "A; B", None, "", "  ", ";;,", '"a, b", c', "'it''s', x", '["p","q"]', "low (a, b); high", '"Signal ""patchy"" in lung", z', "a, , b", "x|x|x", 'bad " quote, b', "open (a, b", "12.5%: x-y / z",
    ]
    assert run(spark, texts) == [
        ["A", "B"], [], [], [], [], ["a, b", "c"], ["it's", "x"], ["p", "q"], ["low (a, b)", "high"], ['Signal "patchy" in lung', "z"], ["a", "b"], ["x", "x", "x"],
        ["bad", "quote", "b"], ["open", "a", "b"], ["12.5%: x-y", "z"],
    ]
    assert run(spark, ["ACG TTT  GG", '"AA" "CC"', "AA|CC GG"], True) == [["ACG", "TTT", "GG"], ["AA", "CC"], ["AA", "CC", "GG"]]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \"'(),;|1.%", max_size=14), min_size=60, max_size=120), st.booleans())
def test_random_texts(spark, texts, blank_cuts):
    assert run(spark, texts, blank_cuts) == [plain(t, blank_cuts) for t in texts]


def test_brackets_of_any_depth(spark):
    deep = "(" * 3000 + "x, y" + ")" * 3000
    texts = ["Foo (a (b (c, e)) d), Bar", "a (b, (c, (d))), e", "(((((a, b)))))); c", "((((a, b); (c, d", deep + "; z", '"q (((", (((a, b)))', "a (1, (2) (3, (4))), b"]
    got = run(spark, texts)
    assert got == [plain(t) for t in texts]
    assert got[0] == ["Foo (a (b (c, e)) d)", "Bar"] and got[4] == [deep, "z"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a \"'(),;1", max_size=24), st.booleans())
def test_reader_of_deep_texts(text, blank_cuts):
    assert [x[0] for x in packed.read(text, blank_cuts)[0]] == plain(text, blank_cuts)


def test_both_readers_agree(spark):
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choice("ab (),;\"'") for _ in range(rng.randrange(16))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, f string")
    got = {}
    for r in packed.unpack(df, "f", "id", "t.f").collect():
        got.setdefault(r["row_id"], []).append((r["item_pos"], r["item"], r["kind"], r["item_error"], r["error"]))
    for i, t in enumerate(texts):
        items, error = packed.read(t)
        assert sorted(got.get(i, [])) == [(n + 1, *x, error) for n, x in enumerate(items)]


def test_long_text_and_errors(spark):
    long_ = ", ".join(["v" * 50] * 20_000) + ', "' + "x" * 100_000
    df = spark.createDataFrame([(1, long_), (2, 'a "b'), (3, "a (b"), (4, "a, b")], "id long, f string")
    out = packed.unpack(df, "f", "id", "t.f")
    assert out.where("row_id = 1").count() == 20_001
    assert {(r[0], r[1]) for r in out.select("row_id", "error").distinct().collect()} == {(1, "quote"), (2, "quote"), (3, "bracket"), (4, "")}


def test_empty_table(spark):
    assert packed.unpack(spark.createDataFrame([], "id long, f string"), "f", "id", "t.f").count() == 0
