import random

import pytest
from pyspark.sql import functions as F

from polystrata.operators import search as S
from polystrata.operators.stemmers import STEMMERS

SIMPLE = S.Analyzer(("lowercase", "ascii"))
STEMMED = S.Analyzer(("lowercase", "ascii", "stemmer"))


def ids(df, analyzer, q, mode="term"):
    return sorted(r.id for r in df.where(S.matches(analyzer, F.col("body"), q, mode)).collect())


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(1, "Ada Lovelace wrote the first program"), (2, "Lovelace, Ada: a café in Paris"), (3, "Ada and Charles Babbage"), (4, "vector search and vectorised vectors"), (5, "the analyzer of a container"), (6, None), (7, ""), (8, "日本語 text, running runs")]
    return spark.createDataFrame(rows, "id int, body string").cache()


def test_words(notes):
    m = lambda q, mode="term": ids(notes, SIMPLE, q, mode)
    assert m("lovelace") == [1, 2] and m("CAFE") == [2] and m("ada program") == [1] and m("ada hopper") == []
    assert m("babbage OR program") == [1, 3] and m("ada NOT babbage") == [1, 2] and m("ada babbage OR paris") == [2, 3] and m("NOT ada") == [] and m("") == []
    assert m('"ada lovelace"') == [1] and m('"lovelace ada"') == [2] and m('"ada wrote"') == [] and m('"ada wrote"~1') == [1] and m('"wrote ada"~9') == [] and m('"ada love"*') == [1]
    assert m('"ada lovelace') == [1, 2] and m("vecto*") == [4] and m("語") == [8] and m("日語") == [8]
    assert m("vec", "prefix") == [4] and m("vec sea", "prefix") == [4] and m("vec zzz", "prefix") == [] and m("ecto", "infix") == [4]
    assert m("vectr", "fuzzy") == [4] and m("vetcor", "fuzzy") == [4] and m("evctor", "fuzzy") == [] and m("containr analyzr", "fuzzy") == [5]
    for q, mode in (("ve", "prefix"), ("v", "fuzzy"), ('"a b"~x', "term"), ('"a b"~', "term"), ("ab*", "term")):
        with pytest.raises(S.BadQuery):
            m(q, mode)
    assert ids(notes, STEMMED, "run") == [8] and ids(notes, SIMPLE, "run") == [] and ids(notes, STEMMED, "vectors") == [4]


def test_edits_against_plain_recursion():
    def plain(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    r = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(7))) for _ in range(2))
        assert S.edits(a, b) == min(plain(a, b), 3)


def test_phrases_against_plain_code(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(9))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")

    def plain(text, words, slop):
        t = text.split()
        for i in range(len(t)):
            if t[i] == words[0]:
                k = 0
                for x in t[i : i + len(words) + slop]:
                    k += k < len(words) and x == words[k]
                if k == len(words):
                    return True
        return False

    for words, slop in (("ab", 0), ("aab", 1), ("cab", 2), ("a", 0)):
        assert ids(df, SIMPLE, f'"{" ".join(words)}"~{slop}') == [i for i, t in enumerate(texts) if plain(t, words, slop)]


def test_ranks_marks_and_vocabulary(spark, notes):
    hits = S.rank([S.Member("notes", notes, "id", {"body": 2.0})], SIMPLE, "ada OR vector").collect()
    assert {r.id for r in hits} == {1, 2, 3, 4} and all(r.score > 0 for r in hits) and {e.word for r in hits for e in r.explain} == {"ada|vector"}
    every = S.rank([S.Member("notes", notes, "id", {"body": 1.0})], SIMPLE, "lovelace", all_rows=True).collect()
    assert len(every) == 7 and sum(r.score > 0 for r in every) == 2
    fuzzy = {r.id: r.score for r in S.rank([S.Member("n", notes, "id", {"body": 1.0})], SIMPLE, "vectr", "fuzzy").collect()}
    exact = {r.id: r.score for r in S.rank([S.Member("n", notes, "id", {"body": 1.0})], SIMPLE, "vector").collect()}
    assert fuzzy.keys() == exact.keys() == {4} and 0 < fuzzy[4] < exact[4]
    syn = S.rank([S.Member("n", notes, "id", {"body": 1.0})], SIMPLE, "countess", synonyms={"countess": ["lovelace"]}).collect()
    assert {r.id for r in syn} == {1, 2}
    marks = {r.id: [(m.start, m.end) for m in r.m] for r in notes.where("body is not null").select("id", S.highlight(SIMPLE, F.col("body"), "cafe ada").alias("m")).collect()}
    assert marks[2] == [(10, 13), (17, 22)] and marks[1] == [(0, 3)] and marks[7] == []
    phrase = notes.where("id = 1").select(S.highlight(SIMPLE, F.col("body"), '"ada lovelace"').alias("m")).first().m
    assert [(m.start, m.end) for m in phrase] == [(0, 3), (4, 12)]
    long_text = "x " * 100 + "needle " + "y " * 30 + "needle thread " + "z " * 50
    d = spark.createDataFrame([(1, long_text), (2, "none")], "id int, body string")
    got = {r.id: r.s for r in d.select("id", S.snippet(SIMPLE, F.col("body"), "needle OR thread").alias("s")).collect()}
    assert "thread" in long_text[got[1].start : got[1].end] and len(long_text[got[1].start : got[1].end].split()) == 24 and got[2].start is None
    assert [r.term for r in S.complete(notes, ["body"], SIMPLE, "Vec").collect()] == ["vector", "vectorised", "vectors"]
    assert S.did_you_mean(notes, "body", SIMPLE, "lovelase ada zzz") == {"lovelase": "lovelace", "zzz": None}


def test_stemmers():
    known = {
        "english": "running run,relational relat,hopping hop,hoping hope,happily happili,skies sky,communication communic,ties tie,cries cri,knightly knight,consistency consist,dying die,proceed proceed,generously generous",
        "german": "häuser haus,kategorischen kategor,aufeinanderfolge aufeinanderfolg,schönheit schonheit,freundlichkeit freundlich,straße strass",
        "french": "continuellement continuel,majestueusement majestu,accablaient accabl,d'enfants enfant,chevaux cheval,opéra oper",
        "spanish": "chicas chic,cheques chequ,torneados torn,trabajando trabaj,rápidamente rapid,tecnología tecnolog",
        "russian": "важная важн,книгами книг,важность важност,вагона вагон,читающий чита",
    }
    for language, pairs in known.items():
        for word, stem in (x.split() for x in pairs.split(",")):
            assert STEMMERS[language](word) == stem, (language, word)
    assert all(f("Ω9") == "Ω9" and f("") == "" for f in STEMMERS.values())
