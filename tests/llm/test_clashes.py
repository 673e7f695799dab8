"""Input columns named as an operator's helpers or outputs."""

from pyspark.sql import functions as F

from civiclens.llm import lm, simhash, toxicity
from civiclens.llm import queries as Q
from tests.llm.helpers import docs, prose

NAMES = ["fp", "root", "node", "f", "first", "component_id", "number", "known", "n_tokens", "own", "word", "rare", "score", "row",
         "key0", "c0", "c"]


def wide(spark):
    rows = [(i, prose(20, i % 5)) for i in range(12)] + [(None, None), (50, "")]
    return docs(spark, rows).select("doc_id", "text", *[F.lit(f"in {n}").alias(n) for n in NAMES])


def check(out, made):
    first = out.first()
    assert sorted(out.columns) == sorted({"doc_id", *NAMES, *made})
    assert all(first[n] == f"in {n}" for n in NAMES if n not in made)
    assert all(not str(first[n]).startswith("in ") for n in made) and out.count() == 14


def test_simhash(spark):
    check(simhash.cluster(wide(spark)), {"fp", "root", "component_id"})


def test_lm(spark):
    model, counts = lm.train(wide(spark))
    check(lm.score(wide(spark), model, counts), {"n_tokens", "n_known", "base_score", "score"})


def test_toxicity_and_a_null_id(spark, tmp_path):
    rows = [(i, f"{'vile rotten' if i % 2 else 'kind lovely'} {prose(8, i)}") for i in range(80)] + [(None, "vile")]
    df = docs(spark, rows)
    labels = df.select("doc_id", F.lit(1).alias("quality"), F.pmod("doc_id", F.lit(2)).cast("int").alias("toxic"))
    model = toxicity.train(df, labels.select("doc_id", "toxic"))
    check(toxicity.score(wide(spark), model), {"score"})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = Q.QUERIES["op9_toxicity_cnn"](spark, str(tmp_path))
    assert out.filter("held_out is null").count() == 0 and out.count() == 81
