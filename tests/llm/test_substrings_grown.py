import random

from polystrata.llm import substrings

from .test_substrings import SENTENCE


def brute_grown(rows, run, least, lone):
    """Every stretch of sentences that is long enough and has an earlier place goes; all stretches are compared, not the shortest."""
    docs = {i: SENTENCE.findall(t) for i, t in rows}
    first, gone = {}, {i: set() for i in docs}
    for i, p in sorted(docs.items()):
        norm = [s.strip(" \t\n\r\f\v").lower() for s in p]
        for at in range(len(p)):
            for n in range(1, len(p) - at + 1):
                k = "\n".join(norm[at : at + n])
                if (n >= min(run, len(p)) and len(k) >= least) or (n == 1 and len(k.split()) >= lone):
                    key = tuple(norm[at : at + n])
                    if first.setdefault(key, (i, at)) != (i, at):
                        gone[i] |= set(range(at, at + n))
    return {i: "".join(s for j, s in enumerate(p) if j not in gone[i]) for i, p in docs.items()}


def test_grown_runs_take_whole_stretches(spark):
    items = [f"item {i}, {w}\n" for i, w in enumerate("ash oak elm fir yew".split() * 8)]
    alone = " ".join(f"word{i}" for i in range(60)) + ". "
    rows = [(1, "Old text here. " + "".join(items) + "The end."), (2, "New text there. " + "".join(items) + "Other end."), (3, "Yes. No. " + alone + "Then this."), (4, "No. Why? " + alone + "Then that."), (5, "Yes. No. Alone.")]
    text = {r.doc_id: r.text for r in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), grown=True).collect()}
    assert text == {1: rows[0][1], 2: "New text there. Other end.", 3: rows[2][1], 4: "No. Why? Then that.", 5: "Yes. No. Alone."}


def test_grown_runs_against_all_stretches(spark):
    rng = random.Random(7)
    words = ["a b.", "Some longer sentence stands here!", "x\n", "mid one?", "the words of this one are more than ten in all."]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for i in range(120)]
    for run, least, lone in ((2, 40, 10), (3, 25, 99)):
        got = substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), run, least, grown=True, lone_words=lone).collect()
        assert {r.doc_id: r.text for r in got} == brute_grown(rows, run, least, lone)
