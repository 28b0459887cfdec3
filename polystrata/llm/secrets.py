"""Secret scans with DataFrame functions only: a trigram inverted index picks candidates, regular expressions verify them."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = r"[A-Za-z0-9_-]"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `group` of the expression (0: all of it) must have `least` characters, or the match is dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),  # the runs [0-9a-f]+ of 32 and more
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", rf"AIza{_WORD}{{35,}}"),
    Rule("jwt", rf"(?<!{_WORD})eyJ{_WORD}{{8,}}\.eyJ{_WORD}{{8,}}\.{_WORD}{{8,}}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----"),
)


# ---- Boolean trigram queries -------------------------------------------------------------

Query = tuple[frozenset[frozenset[str]], ...]  # all of these clauses; of a clause any conjunction; of a conjunction all trigrams
_MOST = 256


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _clause(strings: frozenset[str]) -> frozenset[frozenset[str]] | None:
    """Text holding one of the strings holds all trigrams of one of these sets; None where a string is too short to tell."""
    sets = {_grams(s) for s in strings}
    if frozenset() in sets:
        return None
    return frozenset(x for x in sets if not any(y < x for y in sets))


def _expand(nodes, clauses: list) -> frozenset[str] | None:
    """The strings that a sequence may match, if few; else None, after adding the clauses that any match implies."""
    current: frozenset[str] = frozenset([""])
    exact = True

    def cut() -> None:
        nonlocal current, exact
        if (c := _clause(current)) is not None:
            clauses.append(c)
        current, exact = frozenset([""]), False

    for op, arg in nodes:
        found: frozenset[str] | None = None
        inner: list = []
        if op is sre.LITERAL:
            found = frozenset([chr(arg).lower()])
        elif op is sre.IN:
            found = _letters(arg)
        elif op is sre.SUBPATTERN:
            found = _expand(arg[3], inner)
        elif op is sre.BRANCH:
            ways = [(_expand(x, c := []), c) for x in arg[1]]
            if all(s is not None for s, _ in ways):
                found = frozenset().union(*(s for s, _ in ways))
            elif all(c for _, c in ways):  # one clause of each way, any of them
                inner = [frozenset().union(*(c[0] for _, c in ways))]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            once = _expand(sub, inner)
            if once is not None and high <= 3:
                found = frozenset(x for n in range(low, high + 1) for x in _power(once, n))
            elif low == 0:
                inner = []
            elif once is not None:
                inner = [c] if (c := _clause(frozenset(_power(once, min(low, 3))))) is not None else []
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):  # take no characters
            found = frozenset([""])
        if found is not None and len(found) * len(current) <= _MOST:
            current = frozenset(a + b for a in current for b in found)
        else:
            cut()
            if found is not None and len(found) <= _MOST:
                current = found
            clauses += inner
    if exact:
        return current
    cut()
    return None


def _power(strings: frozenset[str], n: int) -> frozenset[str]:
    out = frozenset([""])
    for _ in range(n):
        out = frozenset(a + b for a in out for b in strings)
        if len(out) > _MOST:
            return frozenset(["", *out])  # too many: the empty string says nothing
    return out


def _letters(items) -> frozenset[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 12:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 12 else None


def trigram_query(regex: str) -> Query:
    """Clauses of lower-case trigrams that every text with a match satisfies; none: the rule has no mandatory trigrams."""
    clauses: list = []
    strings = _expand(parser.parse(regex), clauses)
    if strings is not None and (c := _clause(strings)) is not None:
        clauses.append(c)
    return tuple(dict.fromkeys(clauses))


# ---- The index ---------------------------------------------------------------------------


class TrigramIndex:
    """Numbers the trigrams that the rules ask for; postings are rows (gram, doc_id)."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.regex) for r in rules]
        self.grams = sorted({g for q in self.queries for c in q for conj in c for g in conj})
        self.number = {g: i for i, g in enumerate(self.grams)}
        self.words = max(1, -(-len(self.grams) // 62))

    def postings(self, docs: DataFrame) -> DataFrame:
        """One row for each asked trigram that a text holds."""
        low = docs.select("doc_id", F.lower("text").alias("low"))
        held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i).cast("short")) for g, i in self.number.items())))
        return low.select("doc_id", F.explode(held).alias("gram"))

    def candidates(self, postings: DataFrame) -> DataFrame:
        """Intersects postings by document: doc_id, rules (a bit for each rule whose query holds). Lists are merged as bit sets, before the shuffle too."""
        bit = lambda w: F.bit_or(F.when(F.floor(F.col("gram") / 62) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram").cast("int") - 62 * w)).otherwise(F.lit(0).cast("long")))
        sets = postings.groupBy("doc_id").agg(*(bit(w).alias(f"w{w}") for w in range(self.words)))
        found = F.lit(0)
        for r, q in enumerate(self.queries):
            if q:
                holds = reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (self._all(c) for c in sorted(clause, key=sorted))) for clause in q))
                found = found + F.when(holds, 1 << r).otherwise(0)
        return sets.select("doc_id", found.alias("rules")).where("rules <> 0")

    def _all(self, grams: frozenset[str]) -> Column:
        masks = [0] * self.words
        for g in grams:
            masks[self.number[g] // 62] |= 1 << self.number[g] % 62
        return reduce(lambda a, b: a & b, (F.col(f"w{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in enumerate(masks) if m))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost, non-overlapping matches as (start, order, end, kind) in code points; failing ones are passed over, not searched within."""
    # two passes that find the same matches: what is between them, and they themselves; a group is looked up in its match
    hits = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    seen = F.zip_with(F.split(text, rule.regex, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    seen = F.filter(seen, lambda x: x["hit"].isNotNull())
    key = (lambda hit: F.regexp_extract(hit, rule.regex, rule.group)) if rule.group else (lambda hit: hit)
    empty = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)")
    start = lambda acc, x: acc["at"] + x["gap"]
    end = lambda acc, x: start(acc, x) + F.length(x["hit"])
    step = lambda acc, x: F.struct(
        end(acc, x).alias("at"),
        F.when(F.length(key(x["hit"])) >= rule.least, F.concat(acc["out"], F.array(F.struct(start(acc, x).alias("start"), F.lit(order).alias("ord"), end(acc, x).alias("end"), F.lit(rule.kind).alias("kind"))))).otherwise(acc["out"]).alias("out"),
    )
    return F.aggregate(seen, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (doc_id, text, ...) -> the same columns and `spans`, an array of (start, ord, end, kind) by start, then rule.

    Rules with mandatory trigrams run on the documents that the index answers
    for them; the others run on every document. Null texts count as empty, and
    stay null. Rows that share a doc_id share its candidates, which are then
    verified row by row; a null doc_id is looked up like any other. A column
    named `spans` or `rules` of the input is replaced.
    """
    docs = docs.drop("spans", "rules")
    index = TrigramIndex(rules)
    asked = index.candidates(index.postings(docs)).select(F.col("doc_id").alias("_at"), "rules")
    both = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_at")), "left").drop("_at")
    text, flags = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("rules"), F.lit(0))
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)")
    found = []
    for i, r in enumerate(rules):
        may = flags.bitwiseAND(F.lit(1 << i)) != 0 if index.queries[i] else text.rlike(r.regex)
        found.append(F.when(may, _spans(text, r, i)).otherwise(none))
    return both.withColumn("spans", F.array_sort(F.concat(*found))).drop("rules")


def written_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans as text."""
    base = [r.kind for r in rules if r.base]
    kept = F.filter("spans", lambda s: s["kind"].isin(base))
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in base]
    return scanned.select("doc_id", *counts, F.sha2(written_spans(kept), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"))


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The text with every span, overlaps merged, replaced by the mark; `spans` goes. Texts without spans stay as they are, null too."""
    text = F.col("text")
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
    )
    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return scanned.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(text)).drop("spans")
