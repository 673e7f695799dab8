import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as spm
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civiclens.llm import align, mphf
from civiclens.llm import queries as Q
from tests.llm.helpers import docs, empty, prose

FILE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
TEXTS = ["", None, " ", "a", "plain words here", "a▁b", "<|endoftext|> x", "naïve 日本語 \U0001f600", "\n\n tab\t", "<s></s>",
         "x" * 3000, prose(900, 1), prose(60, 2), prose(60, 2), "plain words here and there", " " * 2500 + "end"]


def plain(texts):
    """Tokens, groups and links of each text, one pair of tokens at a time."""
    tok, sp = Tokenizer.from_file(FILE), spm.SentencePieceProcessor(model_file=MODEL)
    tok.encode_special_tokens = True
    vocab = {i: t for t, i in json.load(open(FILE))["model"]["vocab"].items()}
    others = iter(range(256, 512))
    alphabet = {chr(b if 33 <= b < 127 or 161 <= b < 173 or 174 <= b else next(others)): b for b in range(256)}
    out = []
    for text in texts:
        want = (" " + (text or "")).encode()
        a = [(i, bytes(alphabet[c] for c in vocab[i])) for i in tok.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i)
              else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text or "")]
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            out.append(([], [], [], []))
            continue
        spans = []
        for side in (a, b):
            at, mine = 0, []
            for i, x in side:
                mine.append((i, at, at + len(x)))
                at += len(x)
            spans.append(mine)
        shared = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, start = [], 0
        for e in shared:
            groups.append("|".join(",".join(str(i) for i, s, z in side if start <= s and z <= e) for side in spans))
            start = e
        links, first = [], 0
        for i, s, z in spans[0]:
            while spans[1][first][2] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < z:
                links.append((i, spans[1][k][0]))
                k += 1
        out.append((a, b, groups, links))
    return out


def expected(texts):
    found = plain(texts)
    count, best = Counter(), Counter()
    for *_, links in found:
        count.update(set(links))
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(len(a), len(b), len(g), len(ls), sum(count[x] == best[x[0]] for x in ls), sum(count[x] for x in ls),
             ";".join(g)) for a, b, g, ls in found], count


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 5000))
    parts = [keys[:1], keys[1:4], keys[4:], keys[:0]]
    made = [mphf.build(p) for p in parts]
    numbers = mphf.Numbers.of(made)
    for i, p in enumerate(parts):
        at = numbers.find(p, np.full(len(p), i))
        assert sorted(at - numbers.first[i]) == list(range(len(p)))
    unknown = numbers.find(np.arange(1 << 41, (1 << 41) + 500), np.full(500, 2))
    assert ((unknown == -1) | (unknown >= 0)).all() and (unknown == -1).any()


@pytest.mark.parametrize(("held", "lookup"), [(1 << 21, 96 << 20), (50, 2000)])
def test_operator(spark, monkeypatch, held, lookup):
    monkeypatch.setattr(align, "FAN", 2)
    df = docs(spark, list(enumerate(TEXTS))).repartition(5)
    rows = {r["doc_id"]: r for r in align.align(df, FILE, MODEL, held=held, lookup_bytes=lookup).collect()}
    want, _ = expected(TEXTS)
    for i, w in enumerate(want):
        r = rows[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) == w, TEXTS[i]
    assert len(rows) == len(TEXTS)


def test_counted_pairs(spark):
    df = docs(spark, list(enumerate(TEXTS)) + [(3, "a")]).repartition(3)
    both = align.read(df, FILE, MODEL)
    wide = align.pair_of(FILE, MODEL).wide
    table = align.counted(both.filter("bucket is not null").select("part", "bucket", "keys", "counts"), wide)
    got = {(r["a"], r["b"]): r["count"] for r in align.pairs(table, wide).collect()}
    assert got == dict(expected([*TEXTS, "a"])[1])


def test_columns_of_any_name_and_an_empty_table(spark):
    names = ["n", "row", "a", "b", "part", "bucket", "keys", "counts", "groups", "n_a", "a.b"]
    df = docs(spark, [(1, "one two"), (None, "three")]).select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    out = align.align(df, FILE, MODEL)
    row = out.filter("doc_id is null").first()
    assert (row["n"], row["a.b"], row["bucket"]) == (0, 10, 5) and row["groups"] == expected(["three"])[0][0][-1]
    assert align.align(empty(spark), FILE, MODEL).count() == 0


def test_query_equals_brute_force(spark):
    rows = {r["doc_id"]: r for r in Q.QUERIES["op11_token_alignment"](spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, _ = expected([t["text"] for t in texts])
    for t, w in zip(texts, want, strict=True):
        digest = hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else ""
        assert tuple(rows[t["doc_id"]]) == (t["doc_id"], *w[:-1], digest)
