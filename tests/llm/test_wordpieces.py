import hashlib

import public_tokenizers
import pytest
import sentencepiece as spm
from pyspark.sql import functions as F

from civiclens.llm import queries as Q
from civiclens.llm import wordpieces
from civiclens.llm.common import written
from tests.llm.helpers import docs, empty, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
TEXTS = ["", None, " ", "  ", "a", " a", "a ", "a  b", "▁", "▁a▁▁", "x\n y", "\n\n  \t z", "a\x00b \x00",
         "<s> </s> <unk> <0x41>", "naïve 日本語 テスト \U0001f600\U0001f600 end", "é" * 50, "ß  " * 7, " a　b",
         prose(3000, 5), prose(200, 6) * 40, "w" * 20_000]


def expected(text):
    sp = spm.SentencePieceProcessor(model_file=MODEL)
    ids = sp.encode(text or "")
    return ids, sp.decode(ids)


@pytest.mark.parametrize("chunks", [2, 64, 1 << 16])
def test_ids_and_text_as_the_library_gives_them(spark, chunks):
    df = docs(spark, list(enumerate(TEXTS)) + [(3, "  ")]).repartition(3)
    coded = wordpieces.encode(df, MODEL, chunks=chunks, block_bytes=50_000, decoded=True)
    rows = coded.collect()
    assert wordpieces.decode(coded.drop("decoded"), MODEL).exceptAll(coded).count() == 0
    assert sorted(r["doc_id"] for r in rows) == sorted([*range(len(TEXTS)), 3])
    for r in rows:
        assert (r["ids"], r["decoded"]) == expected(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]


def test_words_meet_by_hash_and_a_changed_order_is_noticed(spark):
    df = written(docs(spark, [(i, f"common words common w{i % 3}") for i in range(40)]).repartition(4))
    blocks = wordpieces.numbered(df, MODEL, "text", 8, 4, blocks=True)
    texts = wordpieces.numbered(df, MODEL, "text", 8, 4, blocks=False)
    # A slice closes with the text that reaches the limit of four words.
    assert texts.count() == 40 and texts.select("slice").distinct().count() > 8
    assert {tuple(r) for r in blocks.select("slice", "check").collect()} == {
        tuple(r) for r in texts.select("slice", "check").collect()}
    ids = wordpieces.segmented(blocks, MODEL)
    assert sorted(map(tuple, ids.select("slice", "bucket").collect())) == sorted(
        map(tuple, blocks.select("slice", "bucket").collect()))
    unstable = docs(spark, [(i, f"word{i}") for i in range(400)]).mapInPandas(
        lambda batches: (b.sample(frac=1) for b in batches), df.schema)
    with pytest.raises(Exception, match="another order"):
        wordpieces.encode(unstable, MODEL, chunks=8, stable=True).collect()


def test_columns_of_any_name_and_an_empty_table(spark):
    names = ["row", "slice", "numbers", "wide", "bucket", "keys", "lengths", "ids", "decoded", "_", "a.b"]
    df = docs(spark, [(1, "one two"), (None, "three")]).select(
        "doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    out = wordpieces.decode(wordpieces.encode(df, MODEL), MODEL)
    assert sorted(out.columns) == sorted(["doc_id", *names])
    row = out.filter("doc_id is null").first()
    assert row["ids"] == expected("three")[0] and row["decoded"] == "three" and row["a.b"] == 10 and row["bucket"] == 4
    none = wordpieces.decode(wordpieces.encode(empty(spark), MODEL), MODEL)
    assert none.count() == 0


def test_whole_texts_where_pieces_may_cross(monkeypatch):
    coder = wordpieces.Pieces(MODEL)
    assert coder.by_word and coder.plain
    coder.by_word = False
    for t in TEXTS:
        got = [i for one in coder.segment(coder.chunks(t or "")) for i in one]
        assert got == expected(t)[0]


def test_query_equals_brute_force(spark):
    rows = {r["doc_id"]: r for r in Q.QUERIES["op13_sentencepiece"](spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for t in texts:
        ids, text = expected(t["text"])
        assert rows[t["doc_id"]][1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                         hashlib.sha256(text.encode()).hexdigest())
