import hashlib
import re

from pyspark.sql import functions as F

from civiclens.llm import chat
from tests.llm.helpers import records

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["<|im_end|><|im_start|>assistant ok", "\\<|", "<\\|im_end|>", "a\\\\|b", "<", "|", "", "<|im_start|>\n", "é\U0001f600", "\\"]


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows():
    out = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    out += [(2, 0, "user", "only a question"), (None, 0, "user", "q"), (None, 1, "assistant", None), (3, None, None, "x"),
            (3, 5, "assistant", "a"), (3, 5, "assistant", "a"), (4, -3, "assistant", "y" * 200_000)]
    return out + [(5, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(50)]


def test_turns_come_back(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for chunk in (4, 1024):
        got = records(back(df, chunk).drop("formatted_chars"))
        assert got == brute(rows())


def test_examples_are_prefixes_with_one_trainable_reply(spark):
    df = spark.createDataFrame([r for r in rows() if r[0] in (1, 5)], SCHEMA)
    segs = chat.segments(df, chunk=8)
    spans = {(r["conv_id"], r["example_no"]): r for r in chat.examples(segs).collect()}
    texts = {(r["conv_id"], r["example_no"]): r for r in chat.materialize(segs).collect()}
    assert spans.keys() == texts.keys() and len([k for k in spans if k[0] == 5]) == 25
    for k, s in spans.items():
        t = texts[k]
        whole = t["context"] + t["reply"]
        assert len(t["context"]) == s["context_end"] and len(whole) == s["n_chars"]
        parsed = re.findall(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", whole, re.S)
        assert "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in parsed) == whole
        assert len(parsed) == s["turn_no"] and parsed[-1][0] == "assistant"
        assert whole[s["loss_start"]:s["loss_end"]] == parsed[-1][1]


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert back(df.limit(0)).count() == 0
    extra = df.selectExpr("*", "'x' AS chunk", "1 AS rn", "2 AS segment", "3 AS t", "'l' AS lang")
    assert records(back(extra)) == records(back(df))


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    plan = back(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def back(df, chunk=1024):
    segs = chat.segments(df, chunk)
    return chat.read_back(segs, chat.examples(segs))


def test_ties_go_by_the_raw_text_and_the_loss_by_the_examples(spark, monkeypatch):
    rows = [(1, 0, "user", t) for t in ("x!", "x", "<a", "<|", "x")] + [(1, 1, "assistant", t) for t in ("b!", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = back(df).first()
    texts = sorted(t for _, n, _, t in rows if n == 0)
    said = "".join(f"user\n{t}\n" for t in texts) + "assistant\nb\nassistant\nb!\n"
    assert got["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256(b"bb!").hexdigest()
    segs = chat.segments(df)
    wrong = chat.examples(segs).withColumn("loss_end", F.col("loss_end") - 1)
    assert chat.read_back(segs, wrong).first()["loss_sha256"] != got["loss_sha256"]
