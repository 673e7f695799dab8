import bisect
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civiclens.llm import packing as P
from tests.llm.helpers import docs, empty, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  two  spaces ", "a\n b", "a \nb", "tab\t x", "é ü  z  q", "x<|endoftext|> y <|endoftext|>", "\n\n c",
         "it's John's 'll we'll 12 345", "\x1c a \x85 b", "😀 😀😀", prose(20_000), "nospace" * 3000]


TOKENIZER = Tokenizer.from_file(PATH)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizer_files():
    coder = P.FileTokenizer(PATH)
    for t in [*TEXTS, " " * 5000 + "x", "\n" * 3000]:
        coder.check(t or "")
        assert np.frombuffer(coder.encode(t or ""), "<u4").tolist() == ids(t)


def test_a_marked_text_gets_the_plain_calls_ids():
    coder, text = P.FileTokenizer(PATH), "x<|endoftext|> y"
    assert 50256 in ids(text) and np.frombuffer(coder.encode(text), "<u4").tolist() == ids(text)
    assert 50256 not in coder.ids(text)  # as ordinary text, for the alignment


def test_ids_of_random_texts():
    r = random.Random(1)
    coder = P.FileTokenizer(PATH)
    for _ in range(3000):
        t = "".join(r.choice(" \n\tab'1.é\x85\xa0日_%’ſt s") if r.random() < .8 else chr(r.randrange(1, 0x3000)) for _ in range(r.randrange(40)))
        assert coder.ids(t) == ids(t)


def test_every_id_lies_in_one_piece_and_windows_have_no_gaps(spark):
    rows = list(enumerate(TEXTS)) + [(100, prose(50))] * 3 + [(1000 + i, prose(30 + i * 7 % 900, i)) for i in range(300)]
    out = P.pack(P.pieces(docs(spark, rows), PATH)).collect()
    parts = {}
    for r in out:
        parts.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        want = [*ids(t), 1]
        mine = sorted(parts[i], key=lambda r: r["start"])
        if i == 100:
            assert len(mine) == 3
            mine = mine[:1]
        assert b"".join(bytes(r["ids"]) for r in mine) == np.asarray(want, "<u4").tobytes()
        assert all(r["doc_tokens"] == len(want) and r["length"] <= 2048 for r in mine)
        assert [r["start"] for r in mine] == np.cumsum([0, *[r["length"] for r in mine]])[:-1].tolist()
    windows = {}
    for r in out:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(r["length"] for r in out) / (2048 * len(windows)) > 0.97


def test_tree_finds_the_tightest_window():
    r = random.Random(3)
    tree, rooms, number = P.OpenWindows(64), [], 0
    for _ in range(3000):
        n = r.randrange(1, 65)
        found = tree.tightest(n)
        at = bisect.bisect_left(rooms, n)
        assert (found is None) == (at == len(rooms))
        room = 64
        if found is not None:
            assert found[0] == rooms.pop(at)
            room = found[0]
        number += 1
        tree.add(room - n, number)
        if room > n:
            bisect.insort(rooms, room - n)


def test_sequences_digest_empty_and_extra_columns(spark):
    assert P.pack(P.pieces(empty(spark), PATH)).count() == 0
    df = docs(spark, [(i, prose(100, i)) for i in range(40)]).withColumn("ids", F.lit(1)).withColumn("offset", F.lit(1))
    packed = P.pack(P.pieces(df, PATH))
    assert packed.columns == ["doc_id", "doc_tokens", "start", "length", "ids", "sequence_id", "offset"]
    seqs = P.sequences(packed).collect()
    assert all(len(bytes(s["ids"])) == 4 * s["n_tokens"] for s in seqs)
    r = packed.select("ids", F.crc32("ids").alias("c")).first()
    assert zlib.crc32(bytes(r["ids"])) == r["c"]
