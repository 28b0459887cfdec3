import duckdb

from polystrata.llm import chat


def render(rows, part_turns):
    out = {}
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, (r or "").strip() or "unknown", (x or "").replace("<|", "< |"), -1 if t is None else t // part_turns))
    for c, ts in convs.items():
        for who in {r for _, r, _, _ in ts} - {"system"}:
            for _, r, x, part in sorted(ts):
                n, text, mask = out.get((c, who, part), (0, "", []))
                text += "<|im_start|>" + ("assistant" if r == who else "system" if r == "system" else f"user name={r}") + "\n"
                if r == who:
                    mask = [*mask, (len(text), len(text) + len(x) + 10)]
                out[c, who, part] = (n + 1, text + x + "<|im_end|>\n", mask)
    return out


def test_views(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|> é😀"), (1, 2, "bob", None), (1, 3, "ann", ""), (1, 9, None, "who?"), (1, 9, None, "who?"), (1, None, "bob", "early"), (None, 0, "x", "y"), (2, 0, "system", "alone")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    for k in (2, 64):
        got = {(r.conv_id, r.speaker, r.part): (r.n_turns, r.text, [tuple(m) for m in r.mask]) for r in chat.rotate(df, k).where("piece = 0").collect()}
        whole = {key: x for key, x in render(rows, k).items() if x[0] <= k}
        assert got == whole and (k == 2 or len(got) == len(render(rows, k)))
        assert all(t[s:e].endswith("<|im_end|>") for _, t, m in got.values() for s, e in m)
    assert chat.rotate(df.limit(0)).collect() == []


def test_sql(spark, small):
    got = sorted(tuple(r) for r in chat.digest(chat.rotate(spark.read.parquet(f"{small}/conversations.parquet"))).collect())
    duckdb.sql(f"create or replace view conversations as from '{small}/conversations.parquet'")
    assert got == sorted(duckdb.sql(chat.DIGEST_SQL).fetchall()) and len(got) > 10


def test_full_parts_are_cut(spark):
    rows = [(1, None, "ann", f"text {i % 300}") for i in range(900)] + [(1, 5, "bob", "same")] * 1000 + [(1, 6, "bob", "x"), (1, 70, "ann", "y")]
    got = sorted(((r.part, r.piece), r.n_turns, r.text) for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 64).where("speaker = 'ann'").collect())
    assert len({k for k, _, _ in got}) == len(got) > 25 and sum(n for _, n, _ in got) == len(rows) and max(n for _, n, _ in got) < 200
    text = "".join(t for _, _, t in got)
    assert sorted(text.split("<|im_end|>\n")) == sorted("".join(v[1] for k, v in render(rows, 64).items() if k[1] == "ann").split("<|im_end|>\n"))
    assert [t.count("same") for _, _, t in got if "same" in t] == [64] * 15 + [40] and got[-1][0] == (1, 0)
