import re

from polystrata.llm import substrings

SENTENCE = re.compile(r"[\s\S]+?(?:[.!?]+(?=\s)\s*|\n\s*|\Z)", re.A)


def brute(rows, run, least):
    docs = {(i is not None, i or 0, t): SENTENCE.findall(t or "") for i, t in rows}
    first, places = {}, {}
    for key, p in sorted(docs.items(), key=lambda x: x[0][:2]):
        norm = [s.strip(" \t\n\r\f\v").lower() for s in p]
        for at in range(max(0, len(p) - run) + 1 if p else 0):
            k = "\n".join(norm[at : at + run])
            if len(k) >= least:
                first.setdefault(k, (key, at))
                places.setdefault(k, []).append((key, at))
    gone = {k: set() for k in docs}
    for k, at in places.items():
        for key, i in at:
            if (key, i) != first[k]:
                gone[key] |= set(range(i, i + run))
    return {key: ("".join(s for i, s in enumerate(p) if i not in gone[key]), len(p), sum(i in gone[key] for i in range(len(p)))) for key, p in docs.items()}


def check(spark, rows, run, least):
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_removed int")
    got = substrings.drop_repeats(df, run, least).collect()
    want = brute(rows, run, least)
    have = {}
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
        have[(i is not None, i or 0, t)] = (r.text or "", r.n_sentences, r.n_removed)
    assert len(got) == len(rows) and have == want


def test_small_tables(spark):
    a, b, c = "The first sentence of all.", "Another one follows it here!", "And a third, is it?"
    rows = [(1, f"{a} {b} {c}"), (2, f"Intro. {a}\n{b} tail"), (3, f"{b} {c} {b} {c} {b}"), (4, None), (5, ""), (6, " \n"), (7, a), (8, a.upper()), (None, f"{a} {b}"), (9, "x" * 200_000 + ". " + a), (10, "é. " * 400)]
    for run in (1, 2, 3):
        check(spark, rows, run, 20)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.drop_repeats(empty).collect() == []
    twice = spark.createDataFrame([(1, f"{a} {b} {c} and more"), (1, f"{a} {b} {c} and more")], "doc_id long, text string")
    assert len({(r.text, r.n_removed) for r in substrings.drop_repeats(twice, 2, 20).collect()}) == 1


def test_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()], 2, 80)
