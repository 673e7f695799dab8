from pyspark.sql import functions as F

import corpus_pipeline
from civiclens.llm import lines as L
from tests.llm.helpers import docs, empty, prose

WS = " \t\n\x0b\x0c\r"


def brute(rows, min_sites):
    sites, first = {}, {}
    for i, t, s in rows:
        for p, raw in enumerate((t or "").split("\n") if t is not None else []):
            line = raw.strip(WS)
            if line:
                sites.setdefault(line, set()).add(s)
                key = (i is not None, i or 0, t, p)
                first[line] = min(first.get(line, key), key)
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        ls = t.split("\n")
        keep = [x for p, x in enumerate(ls) if not (x.strip(WS) and len(sites[x.strip(WS)]) >= min_sites
                                                    and first[x.strip(WS)] != (i is not None, i or 0, t, p))]
        out.append((i, "\n".join(keep), len(ls), len(ls) - len(keep)))
    return sorted(out, key=repr)


def run(df, k):
    return sorted((tuple(r) for r in L.dedup_lines(df, k).select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr)


def test_matches_brute_force(spark):
    rows = [(i, f"own {i}\nshared by all \n\n  mid {i % 6}\nshared by all", f"site{i % 25}") for i in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, " \n\t", None), (103, "shared by all", None), (None, "shared by all", "z"),
             (104, "x" * 100_000 + "\nshared by all", "site1")]
    for k in (3, 5, 10, 24, 27, 40):
        assert run(docs(spark, rows), k) == brute(rows, k), k


def test_exact_at_the_threshold_with_many_sites(spark):
    rows = [(i, "on 199 sites" if i < 199 else "on 200 sites", f"s{i % 199 if i < 199 else i}") for i in range(399)]
    out = {r["doc_id"]: r["n_removed"] for r in L.dedup_lines(docs(spark, rows), 200).collect()}
    assert sum(out.values()) == 199 and out[199] == 0 and all(out[i] == 0 for i in range(199))


def test_repeated_rows_empty_table_clashing_columns(spark):
    rows = [(1, "same\nline", f"s{i}") for i in range(12)] + [(2, "same\nother", "t")]
    out = run(docs(spark, rows), 10)
    assert out.count((1, "same\nline", 2, 0)) == 12 and (2, "other", 2, 1) in out
    assert L.dedup_lines(empty(spark)).count() == 0
    df = docs(spark, rows).withColumn("doc", F.lit(1)).withColumn("a", F.lit(2)).withColumn("cut", F.lit(3)).withColumn("n_removed", F.lit("x"))
    got = L.dedup_lines(df, 10)
    assert got.columns == [*df.columns, "n_lines"] and got.filter("n_removed = 1 AND cut = 3 AND a = 2").count() == 1


def test_pipeline_cuts_passages_of_few_sites_and_of_a_hot_source(spark):
    rows, passage = [], {n: prose(55, 1000 + n) for n in (3, 5, 7, 9, 40)}
    for n in (3, 5, 7, 9):  # one document a source
        rows += [(100 * n + i, f"own {n} {i}\n{passage[n]}", f"s{i}") for i in range(n)]
    rows += [(5000 + i, f"own hot {i}\n{passage[40]}", "hot" if i < 36 else f"s{i - 36}") for i in range(40)]
    got = corpus_pipeline.line_dedup(spark, docs(spark, rows), None).collect()
    held = {n: sum(p in r["text"] for r in got) for n, p in passage.items()}
    # Copies on three sources are left to the near-duplicate search.
    assert held == {3: 3, 5: 1, 7: 1, 9: 1, 40: 1} and len(got) == len(rows)
    assert all(r["text"].startswith("own") for r in got)


def test_hot_lines_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_ROWS", 20)
    rows = [(i, f"own {i}\nhot line\nmid {i % 6}\nhot line", f"site{i % 9}") for i in range(80)]
    rows += [(200 + i, "hot near the threshold", f"n{i % 4}") for i in range(50)]
    for k in (4, 5, 9):
        assert run(docs(spark, rows), k) == brute(rows, k), k
    found = L.spread(L.line_table(docs(spark, rows)), 4)
    assert found.filter("rows > 20").count() == 2
