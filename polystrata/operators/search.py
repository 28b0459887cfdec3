"""Full text: analyzers, the MATCHES family, BM25F over several fields and tables, highlights, snippets, completion."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import ship, written
from .stemmers import STEMMERS, stem_all

K1, B = 1.2, 0.75
PREFIX_LETTERS, FUZZY_PREFIX, SNIPPET_TOKENS = 3, 2, 24
_IDEO = "㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_JAVA_IDEO = r"㐀-䶿一-鿿豈-﫿\x{20000}-\x{3FFFF}"
_JAVA_TOKEN = rf"[{_JAVA_IDEO}]|[\p{{L}}\p{{N}}&&[^{_JAVA_IDEO}]]+"
_TOKEN = re.compile(rf"[{_IDEO}]|[^\W_{_IDEO}]+")
_LOW = ("àáâãäåāăąçćčďèéêëēėęěìíîïīįıłńñňòóôõöøōőŕřśšşťùúûüūůűųýÿźżž", "aaaaaaaaacccdeeeeeeeeiiiiiiilnnnoooooooorrssstuuuuuuuuyyzzz")
_HIGH = [(x.upper(), y.upper()) for x, y in zip(*_LOW) if x != "ı" and len(x.upper()) == 1]
_PLAIN = (_LOW[0] + "".join(x for x, _ in _HIGH), _LOW[1] + "".join(y for _, y in _HIGH))
_PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d"}


class BadQuery(ValueError):
    """A query that is refused: a prefix that is too short, a slop that is no number."""


@dataclass(frozen=True)
class Analyzer:
    """Runs of letters and digits, an ideograph alone; then the filters, in order: lowercase, ascii, stemmer or stemmer(language)."""

    filters: tuple[str, ...] = ("lowercase",)

    def __post_init__(self) -> None:
        for f in self.filters:
            if f not in ("lowercase", "ascii") and self.language(f) not in STEMMERS:
                raise BadQuery(f"no filter {f}")

    @staticmethod
    def language(f: str) -> str | None:
        m = re.fullmatch(r"stemmer(?:\((\w+)\))?", f)
        return (m[1] or "english") if m else None

    def fold(self, word: str, stem: bool = True) -> str:
        for f in self.filters:
            if f == "lowercase":
                word = word.lower()
            elif f == "ascii":
                word = "".join(_PAIRS.get(c, c) for c in word.translate(str.maketrans(*_PLAIN)))
            elif stem:
                word = STEMMERS[self.language(f)](word)
        return word

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Byte ranges and terms."""
        out, at, done = [], 0, 0
        for m in _TOKEN.finditer(text):
            at += len(text[done : m.start()].encode())
            size = len(m[0].encode())
            out.append((at, at + size, m[0]))
            at, done = at + size, m.end()
        return out

    def words(self, text: str) -> list[tuple[str, str]]:
        """(folded, term) of each token: as typed and as stemmed."""
        return [(self.fold(w, False), self.fold(w)) for _, _, w in self.spans(text)]

    def surfaces(self, text: Column) -> Column:
        for f in self.filters:
            if f == "lowercase":
                text = F.lower(text)
            elif f == "ascii":
                text = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), _PAIRS.items(), F.translate(text, *_PLAIN))
        return F.regexp_extract_all(text, F.lit(_JAVA_TOKEN), F.lit(0))

    def terms(self, text: Column) -> Column:
        """An array of terms in the order of the text, by built-in functions; stemmers run in Arrow batches on the tokens."""
        out = self.surfaces(text)
        for f in self.filters:
            if (language := self.language(f)) is not None:
                out = _stemmed(language)(out)
        return out


@cache
def _stemmed(language: str):
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("array<string>")
    def run(tokens: pd.Series) -> pd.Series:
        return pd.Series([stem_all(language, t) for t in tokens])

    return run


def edits(a: str, b: str, most: int = 2) -> int:
    """Restricted Damerau distance: insert, delete, change, or swap two neighbours; most + 1 where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
        if min(row) > most:
            return most + 1
    return min(last[-1], most + 1)


def budget(word: str) -> int:
    return 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2


# ---- queries


@dataclass(frozen=True)
class Word:
    """What answers one word of a query: the term itself; a term that begins with, is near to, or holds one of the spellings."""

    kind: str  # term, prefix, fuzzy, infix
    spellings: tuple[str, ...]

    def answer(self, token: Column) -> Column:
        if self.kind == "term":
            return token.isin(*self.spellings)
        test = {"prefix": F.startswith, "infix": F.contains, "fuzzy": lambda t, s: t.startswith(s[:FUZZY_PREFIX])}[self.kind]
        return reduce(lambda a, b: a | b, ((test(token, F.lit(s)) if self.kind != "fuzzy" else test(token, s) & F.char_length(token).between(len(s) - budget(s), len(s) + budget(s))) for s in self.spellings))

    def weigh(self, term: str) -> float:
        """1 for an exact or longer word, 1 / (1 + edits) for a corrected one, 0 where the term doesn't answer."""
        if self.kind == "term":
            return float(term in self.spellings)
        if self.kind == "prefix":
            return float(term.startswith(self.spellings))
        if self.kind == "infix":
            return float(any(s in term for s in self.spellings))
        near = [edits(s, term, budget(s)) for s in self.spellings if term[:FUZZY_PREFIX] == s[:FUZZY_PREFIX]]
        return max((1 / (1 + d) for d, s in zip(near, self.spellings) if d <= budget(s)), default=0.0)


@dataclass(frozen=True)
class Query:
    """Each group must be answered by one of its words, no excluded one may be there; a phrase has its words in order within `slop` more tokens."""

    required: tuple[tuple[Word, ...], ...] = ()
    excluded: tuple[Word, ...] = ()
    phrase: tuple[Word, ...] = ()
    slop: int = 0

    @property
    def words(self) -> list[Word]:
        return list(self.phrase) or [w for g in self.required for w in g]


def parse(analyzer: Analyzer, text: str, mode: str = "term", synonyms: dict[str, list[str]] | None = None, stopwords: frozenset[str] = frozenset()) -> Query:
    """A query's words. `mode` is what each word may be: term (with OR, NOT, "phrase"~n, word*), prefix, fuzzy or infix."""

    def make(kind: str, folded: str, term: str) -> Word:
        least = {"prefix": PREFIX_LETTERS, "fuzzy": FUZZY_PREFIX, "infix": PREFIX_LETTERS}.get(kind, 0)
        if len(folded) < least:
            raise BadQuery(f"{kind} words have {least} letters at least: {folded}")
        return Word(kind, (term,) if kind == "term" else (folded,) if kind == "infix" else tuple(dict.fromkeys((folded, term))))

    if mode != "term":
        return Query(required=tuple((make(mode, f, t),) for f, t in analyzer.words(text)))
    m = re.fullmatch(r'\s*"(.*)"(\*)?(?:~(.*))?\s*', text, re.S)
    if m:
        if m[3] is not None and not m[3].isdigit():
            raise BadQuery(f"a slop is a number: {m[3]}")
        ws = analyzer.words(m[1])
        return Query(phrase=tuple(make("prefix" if m[2] and i == len(ws) - 1 else "term", f, t) for i, (f, t) in enumerate(ws)), slop=int(m[3] or 0))
    groups: list[list[Word]] = []
    excluded: list[Word] = []
    how = ""
    for raw in text.split():
        if raw in ("OR", "NOT"):
            how = raw
            continue
        ws = [(f, t) for f, t in analyzer.words(raw) if f not in stopwords]
        for i, (f, t) in enumerate(ws):
            found = [make("prefix" if raw.endswith("*") and i == len(ws) - 1 else "term", f, t)]
            for other in (synonyms or {}).get(f, ()):
                found += [make("term", g, u) for g, u in analyzer.words(other)]
            if how == "NOT":
                excluded += found
            elif how == "OR" and groups:
                groups[-1] += found
            else:
                groups.append(found)
        how = ""
    return Query(tuple(map(tuple, groups)), tuple(excluded))


@cache
def _near(word: Word):
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("boolean")
    def run(tokens: pd.Series) -> pd.Series:
        return pd.Series([t is not None and any(word.weigh(x) > 0 for x in t) for t in tokens])

    return run


def _held(terms: Column, word: Word) -> Column:
    if word.kind == "term":
        return F.arrays_overlap(terms, F.array(*(F.lit(s) for s in word.spellings)))
    if word.kind == "fuzzy":  # only tokens of the right beginning and length go to Python
        return _near(word)(F.array_distinct(F.filter(terms, word.answer)))
    return F.exists(terms, word.answer)


def _phrase(terms: Column, words: tuple[Word, ...], slop: int) -> Column:
    n = len(words)
    if n == 0:
        return F.lit(False)
    ask = F.array(*(F.struct(F.lit(w.kind == "prefix").alias("p"), F.array(*(F.lit(s) for s in w.spellings)).alias("s")) for w in words))
    ok = lambda x, w: F.exists(w["s"], lambda s: F.when(w["p"], F.startswith(x, s)).otherwise(x == s))

    def within(held: Column) -> Column:
        # from each place of the first word on, words are met in order as early as they come, within n + slop tokens
        run = lambda i: F.aggregate(F.slice(held, i + 1, n + slop), F.lit(0), lambda k, x: F.when((k < n) & ok(x, F.get(ask, k)), k + 1).otherwise(k)) == n
        begins = lambda i: ok(F.get(held, i), F.get(ask, F.lit(0)))
        return F.when(F.size(held) > 0, F.exists(F.sequence(F.lit(0), F.size(held) - 1), lambda i: begins(i) & run(i))).otherwise(False)

    return F.get(F.transform(F.array(terms), within), F.lit(0))  # the tokens are bound, so that no place makes them anew


def answers(terms: Column, q: Query) -> Column:
    """Whether an array of terms answers a query; an absent text answers none."""
    if q.phrase:
        found = _phrase(terms, q.phrase, q.slop)
    elif not q.required:
        found = F.lit(False)
    else:
        found = reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (_held(terms, w) for w in g)) for g in q.required))
        for w in q.excluded:
            found &= ~_held(terms, w)
    return F.coalesce(F.when(terms.isNotNull(), found), F.lit(False))


def matches(analyzer: Analyzer, text: Column, query: str, mode: str = "term") -> Column:
    """text MATCHES [PREFIX | FUZZY | INFIX] query. A fuzzy word may be near the term or the token as it was written."""
    q = parse(analyzer, query, mode)
    found = answers(analyzer.terms(text), q)
    if mode == "fuzzy" and any(Analyzer.language(f) for f in analyzer.filters):
        found = found | answers(analyzer.surfaces(text), q)
    return found


# ---- ranking


@dataclass(frozen=True)
class Member:
    """A table of a search: its rows, their identity, and the weight of each text column."""

    name: str
    rows: DataFrame
    identity: str
    fields: dict[str, float] = field(default_factory=dict)


@cache
def _weighed(word: Word):
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("array<double>")
    def run(tokens: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else [word.weigh(x) for x in t] for t in tokens])

    return run


def _occurrences(terms: Column, word: Word) -> Column:
    if word.kind == "fuzzy":
        return F.aggregate(_weighed(word)(F.filter(terms, word.answer)), F.lit(0.0), lambda a, x: a + x)
    return F.size(F.filter(terms, word.answer)).cast("double")


def rank(members: list[Member], analyzer: Analyzer, query: str, mode: str = "term", synonyms: dict[str, list[str]] | None = None, stopwords: frozenset[str] = frozenset(), k1: float = K1, b: float = B, all_rows: bool = False) -> DataFrame:
    """table_name, id, score and explain of every row that answers the query (`all_rows`: of every row with a text), as one ranked collection.

    BM25F: field weights apply before saturation, each word's rarity counts
    once. A word with several variants (prefix, fuzzy, synonyms) is as common
    as its commonest one. Texts are read once: what the words need of each row
    is written as a small table, from which statistics and scores are taken.
    """
    q = parse(analyzer, query, mode, synonyms, stopwords)
    groups = [[w] for w in q.phrase] if q.phrase else [list(g) for g in q.required]
    names = sorted({f for m in members for f in m.fields})
    parts = []
    for m in members:
        d = m.rows.select(F.lit(m.name).alias("table_name"), F.col(m.identity).alias("id"), *(analyzer.terms(F.col(f)).alias(f"t_{f}") for f in m.fields))
        d = d.where(reduce(lambda x, y: x | y, (F.col(f"t_{f}").isNotNull() for f in m.fields)))
        whole = F.concat(*(F.coalesce(F.col(f"t_{f}"), F.array().cast("array<string>")) for f in m.fields))
        hit = reduce(lambda x, y: x | y, (answers(F.col(f"t_{f}"), q) for f in m.fields)) if q.phrase else answers(whole, q)
        lens = [F.coalesce(F.array_size(f"t_{f}"), F.lit(0)).cast("double") if f in m.fields else F.lit(0.0) for f in names]
        occ = [F.array(*(_sum([_occurrences(F.coalesce(F.col(f"t_{f}"), F.array().cast("array<string>")), w) for w in g]) if f in m.fields else F.lit(0.0) for f in names)) for g in groups]
        held = [F.array_distinct(F.filter(whole, _any_of(g))) for g in groups]
        weights = F.array(*(F.lit(float(m.fields.get(f, 0.0))) for f in names))
        parts.append(d.select("table_name", "id", hit.alias("hit"), F.array(*lens).alias("lens"), (F.array(*occ) if occ else F.array().cast("array<array<double>>")).alias("occ"), (F.array(*held) if held else F.array().cast("array<array<string>>")).alias("held"), weights.alias("weights")))
    index = written(reduce(DataFrame.unionByName, parts), "search")
    sums = index.agg(F.count("*").alias("n"), *(F.sum(F.when(F.get("weights", F.lit(i)) > 0, F.get("lens", F.lit(i)))).alias(f"l{i}") for i in range(len(names))), *(F.sum(F.when(F.get("weights", F.lit(i)) > 0, 1)).alias(f"c{i}") for i in range(len(names))))
    common = index.select(F.posexplode("held").alias("word", "terms")).select("word", F.explode("terms").alias("term")).groupBy("word", "term").agg(F.count("*").alias("df")).groupBy("word").agg(F.max("df").alias("df"))
    common = common.agg(F.map_from_entries(F.collect_list(F.struct("word", "df"))).alias("df"))  # an entry a word of the query
    both = index.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(common))  # one row each
    whys = []
    for w, g in enumerate(groups):
        df = F.coalesce(F.try_element_at("df", F.lit(w)), F.lit(0)).cast("double")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        weight = F.lit(0.0)
        for i in range(len(names)):
            average = F.col(f"l{i}") / F.col(f"c{i}")
            f = F.get(F.get("occ", F.lit(w)), F.lit(i))
            part = F.get("weights", F.lit(i)) * f / (1 - b + b * F.get("lens", F.lit(i)) / average)
            weight = weight + F.when(f > 0, F.coalesce(part, F.lit(0.0))).otherwise(0.0)
        whys.append(F.struct(F.lit("|".join(s for x in g for s in x.spellings)).alias("word"), df.cast("long").alias("df"), idf.alias("idf"), weight.alias("weight"), (idf * weight * (k1 + 1) / (k1 + weight)).alias("score")))
    why = F.array(*whys) if whys else F.expr("cast(array() as array<struct<word:string,df:bigint,idf:double,weight:double,score:double>>)")
    out = both if all_rows else both.where("hit")
    return out.select("table_name", "id", why.alias("explain")).withColumn("score", F.aggregate("explain", F.lit(0.0), lambda a, x: a + x["score"]))


def _any_of(words: list[Word]):
    return lambda token: reduce(lambda a, b: a | b, (w.answer(token) for w in words))


def _sum(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


# ---- marks


@cache
def _marks(analyzer: Analyzer, q: Query):
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"start": a, "end": b} for a, b, hit in _hits(analyzer, q, t) if hit is not None] for t in texts])

    return run


def _hits(analyzer: Analyzer, q: Query, text: str) -> list[tuple[int, int, int | None]]:
    """Byte range of each token and the number of the word that it answers; of a phrase, only in whole runs."""
    tokens = analyzer.spans(text)
    terms = [(analyzer.fold(w), analyzer.fold(w, False)) for _, _, w in tokens]
    words = q.words
    found: list[int | None] = [next((i for i, w in enumerate(words) if any(w.weigh(x) > 0 for x in (t if w.kind == "fuzzy" else t[:1]))), None) for t in terms]
    if q.phrase:
        run: set[int] = set()
        for i in range(len(terms)):
            k, places = 0, []
            for j in range(i, min(len(terms), i + len(words) + q.slop)):
                if k < len(words) and words[k].weigh(terms[j][0]) > 0:
                    k, places = k + 1, [*places, j]
                elif k == 0:
                    break
            run |= set(places) if k == len(words) else set()
        found = [x if i in run else None for i, x in enumerate(found)]
    return [(a, b, hit) for (a, b, _), hit in zip(tokens, found)]


def highlight(analyzer: Analyzer, text: Column, query: str, mode: str = "term") -> Column:
    """Byte ranges {start, end} of the tokens that the query reaches."""
    return _marks(analyzer, parse(analyzer, query, mode))(text)


@cache
def _window(analyzer: Analyzer, q: Query):
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("struct<start:int,end:int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else best_window(_hits(analyzer, q, t)) for t in texts]
        return pd.DataFrame({"start": pd.array([r[0] for r in rows], "Int32"), "end": pd.array([r[1] for r in rows], "Int32")})

    return run


def best_window(hits: list[tuple[int, int, int | None]]) -> tuple[int | None, int | None]:
    """The first window of SNIPPET_TOKENS tokens with most different words of the query, then most marks; nothing where there are none."""
    width, best, out = min(SNIPPET_TOKENS, len(hits)), (0, 0), (None, None)
    counts: dict[int, int] = {}
    total = 0
    for i, (_, end, hit) in enumerate(hits):
        if hit is not None:
            counts[hit], total = counts.get(hit, 0) + 1, total + 1
        if i >= width and (old := hits[i - width][2]) is not None:
            counts[old], total = counts[old] - 1, total - 1
            if not counts[old]:
                del counts[old]
        if i >= width - 1 and (len(counts), total) > best:
            best, out = (len(counts), total), (hits[i - width + 1][0], end)
    return out


def snippet(analyzer: Analyzer, text: Column, query: str, mode: str = "term") -> Column:
    """{start, end} in bytes of the best window; absent fields where no word is."""
    return _window(analyzer, parse(analyzer, query, mode))(text)


# ---- vocabulary


def vocabulary(df: DataFrame, texts: list[str], analyzer: Analyzer, begins: str = "") -> DataFrame:
    """term, documents: words as written (folded, unstemmed) by the number of rows that hold them."""
    tokens = F.array_distinct(F.concat(*(F.coalesce(analyzer.surfaces(F.col(t)), F.array().cast("array<string>")) for t in texts)))
    if begins:
        tokens = F.filter(tokens, lambda x: F.startswith(x, F.lit(begins)))
    return df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("documents"))


def complete(df: DataFrame, texts: list[str], analyzer: Analyzer, begun: str, limit: int = 10) -> DataFrame:
    """Words that begin as typed, by the number of documents, then by name."""
    folded = analyzer.fold(begun, False)
    return vocabulary(df, texts, analyzer, folded).orderBy(F.desc("documents"), "term").limit(limit)


def did_you_mean(df: DataFrame, text: str, analyzer: Analyzer, query: str) -> dict[str, str | None]:
    """For each word of the query that no row holds, the word of one edit, else of two, that most rows hold; the first by name among equals."""
    out: dict[str, str | None] = {}
    for folded, _ in analyzer.words(query):
        near = vocabulary(df, [text], analyzer, folded[:FUZZY_PREFIX]).where(F.char_length("term").between(len(folded) - 2, len(folded) + 2))
        if near.where(F.col("term") == folded).limit(1).count():
            continue
        for most in (1, 2):
            best = near.where(_within(folded, most)(F.col("term"))).orderBy(F.desc("documents"), "term").limit(1).collect()
            if best:
                break
        out[folded] = best[0]["term"] if best else None
    return out


@cache
def _within(word: str, most: int):
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("boolean")
    def run(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: edits(word, t, most) <= most).astype(bool)

    return run


def facets(df: DataFrame, hits: DataFrame, identity: str, keys: list[str]) -> DataFrame:
    """The number of hits by values of the rows hit."""
    return df.join(hits.select(F.col("id").alias("_hit")), F.col(identity) == F.col("_hit"), "left_semi").groupBy(*keys).agg(F.count("*").alias("n"))
