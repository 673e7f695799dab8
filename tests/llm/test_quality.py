import re

import pytest
from pyspark.sql import functions as F

from civiclens.llm import quality as Q
from tests.llm.helpers import docs, empty, prose

TEXTS = ["", None, " \t\n", "a", "a b c d e f g h i j", "x " * 4 + "y", "a b c d e " * 3, "# $ % & | < > *",
         "one line\none line\n\none line\n \n", prose(5000), "a b c d e f a b c d e g a b c d e", "é ü ß x " * 4,
         ("w1 w2 w3 w4 w5 w6\n" * 400), prose(300) + "\n" + prose(300)]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    twice = {g for g in grams if grams.count(g) > 1} if len(w) < 3000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    hit = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
    ls = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(hit))


def test_measures_match_brute_force(spark):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: tuple(r[n] for n in names)
           for r in Q.measure(docs(spark, list(enumerate(TEXTS))), names).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_verdict_does_not_depend_on_the_order_of_rules(spark):
    df = docs(spark, list(enumerate(TEXTS)))
    a = {r["doc_id"]: r["kept"] for r in Q.cascade(df).collect()}
    b = {r["doc_id"]: r["kept"] for r in Q.cascade(df, rules=Q.RULES[::-1], measures=("n_words",)).collect()}
    assert a == b and a[9] and not a[0] and not a[1] and not a[7] and not a[12]


def test_cheap_selective_rules_come_first(spark):
    first = Q.rank_rules(docs(spark, [(i, "a b") for i in range(50)]), Q.RULES)[0]
    assert first.name in ("too_few_words", "word_length")


def test_order_by_rejections_per_cost_is_stable(spark):
    """The order equals a plain count over the rows, in every call."""
    rows = [(i, prose(3 + i % 90, i) + (" #$%" * (i % 7))) for i in range(300)] + [(i, "a b c d e " * 9) for i in range(300, 340)]
    df = docs(spark, rows)
    names = {r.name: r for r in Q.RULES}
    rates = {}
    measured = Q.measure(df, tuple(Q.MEASURES))
    for position, (name, rule) in enumerate(names.items()):
        hits = measured.filter(rule.rejects(F.col)).count()
        chars, n_words = sum(len(t) for _, t in rows), sum(len(t.split()) for _, t in rows)
        amount = {"row": len(rows), "char": chars, "word": n_words}
        used = {"too_few_words": ["n_words"], "repeated_words": ["n_repeat_words", "n_words"], "symbols": ["n_symbols", "n_words"],
                "repeated_lines": ["n_dup_lines", "n_lines"], "word_length": ["word_chars", "n_words"],
                "capitals": ["n_words", "upper_words"]}[name]
        cost = sum(Q.UNIT_NS[m][1] * amount[Q.UNIT_NS[m][0]] for m in ["rule", *used])
        rates[name] = (-hits / cost, position)
    want = sorted(rates, key=rates.get)
    for _ in range(10):
        assert [r.name for r in Q.rank_rules(df, Q.RULES)] == want
    assert want[0] == "too_few_words"


def test_empty_table_extra_and_clashing_columns(spark):
    assert Q.keep_good(empty(spark)).count() == 0
    df = docs(spark, [(None, prose(50)), (1, prose(50, 1)), (1, prose(50, 1)), (2, "x")]).withColumn("kept", F.lit(7)).withColumn("row", F.lit("r")).withColumn("n_words", F.lit(-1))
    out = Q.keep_good(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == 3 and all(r["kept"] == 7 and r["row"] == "r" and r["n_words"] == -1 for r in rows)
    assert Q.cascade(df, measures=("n_words",)).select("n_words").first()[0] == 50


def test_no_python_in_the_plan(spark):
    plan = Q.cascade(docs(spark, [(1, prose(20))]), measures=tuple(Q.MEASURES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("text", [prose(60), "Kurzer Satz mit zehn Wörtern, die alle ganz verschieden sind hier."])
def test_clean_texts_stay(spark, text):
    assert Q.keep_good(docs(spark, [(1, text)])).count() == 1
