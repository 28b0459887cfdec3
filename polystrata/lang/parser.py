"""Statements of a script, by recursive descent."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from .errors import Refused
from .lexer import Token, tokens

FOLDS = frozenset("count sum mean min max variance stddev median collect increase rate delta approx_distinct approx_quantile".split())
WINDOWS = frozenset("row_number rank dense_rank lag lead first_value last_value".split())
OUT_OF_SCOPE = {
    ("DEFINE", w) for w in "VAULT USER NODE FAILOVER TOPOLOGY BALANCER POOL REPLICA REPLICATION".split()
} | {("DROP", w) for w in "VAULT USER NODE TOPOLOGY BALANCER POOL REPLICA REPLICATION".split()} | {("ALTER", w) for w in "USER NAMESPACE TOPOLOGY REPLICA REPLICATION STORE".split()}


class Node:
    """A part of a statement: a kind and named fields. Equal by what it holds."""

    def __init__(self, kind: str, **fields: Any):
        self.kind = kind
        self.__dict__.update(fields)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return None

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Node) and self.__dict__ == other.__dict__

    def __hash__(self) -> int:
        return hash(repr(self))

    def __repr__(self) -> str:
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items() if k != 'kind')})"

    def walk(self):
        """This part and all within, but not within reads of their own."""
        yield self
        if self.kind == "select":
            return
        for v in self.__dict__.values():
            for x in v if isinstance(v, (list, tuple)) else [v]:
                for y in x if isinstance(x, tuple) else [x]:
                    if isinstance(y, Node):
                        yield from y.walk()

    def rebuilt(self, f: Callable[[Node], Node | None]) -> Node:
        """A copy in which f replaces parts, from the outside in."""
        new = f(self)
        if new is not None:
            return new
        if self.kind == "select":
            return self
        one = lambda v: v.rebuilt(f) if isinstance(v, Node) else [one(x) for x in v] if isinstance(v, list) else tuple(one(x) for x in v) if isinstance(v, tuple) else v
        return Node(**{k: one(v) for k, v in self.__dict__.items()})


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens(text), 0
        self.named: dict[str, Node] = {}

    # ---- tokens

    @property
    def next(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def fail(self, wanted: str = "") -> Refused:
        return Refused("UnexpectedToken", f"{self.next.text or 'end'!r} at {self.next.at}" + (f", not {wanted}" if wanted else ""))

    def is_(self, *words: str) -> bool:
        return all(self.peek(i).kind in ("word", "op") and self.peek(i).upper == w for i, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.fail(" ".join(words))

    def any_of(self, *words: str) -> str | None:
        for w in words:
            if self.take(w):
                return w
        return None

    def one(self, *kinds: str) -> Token:
        if self.next.kind not in kinds:
            raise self.fail(" or ".join(kinds))
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> str:
        t = self.one("word", "string")
        return t.value if t.kind == "string" else t.text

    def string(self) -> str:
        return self.one("string").value

    def integer(self) -> Any:
        if self.next.kind == "param":
            return Node("param", name=self.one("param").text[1:], path=[])
        return self.one("number").value

    def duration(self) -> int:
        neg = self.take("-")
        v = self.one("duration").value
        return -v if neg else v

    def listed(self, item: Callable[[], Any]) -> list:
        out = [item()]
        while self.take(","):
            out.append(item())
        return out

    def source(self, since: int) -> str:
        return self.text[self.tokens[since].at : self.next.at].strip()

    # ---- script

    def script(self) -> list[Node]:
        out = []
        while self.next.kind != "end":
            if self.take(";"):
                continue
            self.named = {}
            begun = self.at
            s = self.statement()
            s.text = self.source(begun)
            out.append(s)
            if self.next.kind != "end":
                self.need(";")
        return out

    def statement(self) -> Node:
        t = self.next
        if t.kind != "word":
            raise self.fail("a statement")
        if t.upper in ("SELECT", "WITH"):
            return Node("read", read=self.read())
        made = getattr(self, f"_{t.upper.lower()}", None)
        if made is None or t.upper not in _STATEMENTS:
            if t.upper in ("BEGIN", "COMMIT", "CANCEL", "SAVEPOINT", "ROLLBACK", "BACKUP", "RESTORE", "GRANT", "REVOKE", "REVEAL", "UNSEAL", "SEAL", "ADD", "REMOVE"):
                raise Refused("OutOfScope", f"{t.upper} is no part of an analytics engine")
            raise self.fail("a statement")
        if (t.upper, self.peek().upper) in OUT_OF_SCOPE:
            raise Refused("OutOfScope", f"{t.upper} {self.peek().upper} is no part of an analytics engine")
        self.at += 1
        return made()

    # ---- reads

    def read(self) -> Node:
        """WITH names, branches joined from left to right, and the tail of the whole."""
        outer = dict(self.named)
        if self.take("WITH"):
            while True:
                n = self.name()
                self.need("AS", "(")
                self.named[n] = self.read()
                self.need(")")
                if not self.take(","):
                    break
        first = self.select()
        parts = []
        while op := self.any_of("UNION", "INTERSECT", "EXCEPT"):
            if self.take("ALL"):
                if op != "UNION":
                    raise Refused("UnexpectedToken", f"{op} takes no ALL")
                op = "UNION_ALL"
            parts.append((op, self.select()))
        self.named = outer
        if not parts:
            return first
        last = parts[-1][1]
        whole = Node("compound", first=first, rest=parts, order=last.order, limit=last.limit, start=last.start)
        last.order = last.limit = last.start = None
        return whole

    def select(self) -> Node:
        if self.take("("):
            r = self.read()
            self.need(")")
            return r
        self.need("SELECT")
        s = Node("select", items=[], star=False)
        if self.take("*"):
            s.star = True
            if self.take(","):
                s.items = self.listed(self.item)
        else:
            s.items = self.listed(self.item)
        if self.take("OMIT"):
            s.omit = self.listed(self.route)
        self.need("FROM")
        s.only = self.take("ONLY")
        s.source = self.from_()
        while self.clause(s):
            pass
        return s

    def item(self) -> tuple[str, Node]:
        begun = self.at
        e = self.expression()
        if self.take("AS"):
            return self.name(), e
        if e.kind == "path" and all(isinstance(x, str) for x in e.steps):
            return e.steps[-1], e
        if e.kind == "omit":
            return "", e
        raise Refused("UnnamedProjection", self.source(begun))

    def route(self) -> list:
        e = self.path()
        return e.steps

    def clause(self, s: Node) -> bool:
        if self.take("WHERE"):
            s.where = self.expression()
        elif self.take("FETCH"):
            s.fetch = self.listed(self.route)
        elif self.take("SPLIT"):
            self.need("ON")
            s.split = self.route()
        elif self.take("LATEST", "BY"):
            s.latest = self.route()
        elif self.take("GROUP", "BY"):
            s.group = self.listed(self.expression)
        elif self.take("HAVING"):
            if s.group is None:
                raise Refused("HavingWithoutGroup")
            s.having = self.expression()
        elif self.take("FILL"):
            mode = self.any_of("PREVIOUS", "LINEAR")
            s.fill = [mode or self.sum_()]
            self.need("FROM")
            s.fill.append(self.sum_())
            self.need("TO")
            s.fill.append(self.sum_())
        elif self.take("ORDER", "BY"):
            if self.take("FUSE", "("):
                branches = []
                while True:
                    e = self.expression()
                    up = self.direction()
                    branches.append((e, up, self.one("number").value if self.take("WEIGHT") else 1))
                    if not self.take(","):
                        break
                self.need(")")
                s.fuse = branches
                s.depth = self.one("number").value if self.take("DEPTH") else 100
                if self.is_(","):
                    raise self.fail("the end of the order")
            else:
                s.order = self.listed(self.key)
        elif self.take("LIMIT"):
            s.limit = "ALL" if self.take("ALL") else self.integer()
        elif self.take("START"):
            s.start = self.integer()
        elif self.take("AFTER"):
            s.after = self.record()
        elif self.take("APPROXIMATE"):
            s.approximate = self.one("number").value if self.take("EFFORT") else 64
        elif self.take("USING"):
            s.using = (self.name() if self.take("INDEX") and self.next.kind == "word" and not self.is_("TIMEOUT") else "index") if self.is_("INDEX") else self.name().lower()
        elif self.take("WITHOUT", "SCAN", "GUARD"):
            s.unguarded = True
        elif self.take("TIMEOUT"):
            s.timeout = self.duration()
        elif self.take("VERSION"):
            s.version = self.integer()
        else:
            return False
        return True

    def direction(self) -> bool:
        if self.take("DESC"):
            return False
        self.take("ASC")
        return True

    def key(self) -> tuple[Node, bool, str | None]:
        e = self.expression()
        up = self.direction()
        nulls = self.any_of("FIRST", "LAST") if self.take("NULLS") else None
        return e, up, nulls

    def from_(self) -> Node:
        left = self.side()
        joined = None
        while True:
            how = "inner"
            begun = self.at
            if self.take("INNER"):
                pass
            elif w := self.any_of("LEFT", "RIGHT", "FULL"):
                how = w.lower()
                self.take("OUTER")
            elif self.take("ASOF"):
                how = "asof"
            if not self.take("JOIN"):
                self.at = begun
                break
            right = self.side()
            self.need("ON")
            a = self.path()
            self.need("=")
            b = self.path()
            joined = Node("join", left=joined or left, right=right, how=how, a=a, b=b)
        if joined is None:
            if left.alias:
                raise Refused("UnexpectedToken", "a name where there is no join")
            return left
        return joined

    def side(self) -> Node:
        s = self.table_source()
        if self.take("AS"):
            s.alias = self.name()
        return s

    def table_source(self) -> Node:
        if self.take("("):
            r = self.read()
            self.need(")")
            s = Node("sub", read=r)
            if self.take("WHERE"):
                s.where = self.expression()
            return s
        if self.take("SEARCH"):
            s = Node("search", name=self.name())
            if self.take("COMPLETE"):
                s.complete = self.string()
            else:
                self.need("MATCHES")
                s.mode = (self.any_of("PREFIX", "FUZZY", "INFIX") or "TERM").lower()
                s.query = self.operand()
            return s
        if self.next.kind == "param":
            return Node("from_param", name=self.one("param").text[1:])
        n = self.name()
        if n in self.named and not self.is_(":"):
            return Node("sub", read=self.named[n], alias_of=n)
        if not self.take(":"):
            return Node("table", name=n)
        low = self.identity()
        if op := self.any_of("..=", ".."):
            return Node("span", name=n, low=low, high=self.identity(), closed=op == "..=")
        s = Node("row", name=n, id=low)
        hops = []
        while arrow := self.any_of("->", "<-"):
            hops.append((arrow == "<-", self.name()))
        if not hops:
            return s
        s = Node("walk", name=n, id=low, hops=hops)
        if self.take("PATH", "TO"):
            s.goal = self.record()
        if self.take("DEPTH"):
            s.depth = self.integer()
        if self.take("WEIGHT"):
            s.weight = self.name()
        return s

    def identity(self) -> Node:
        if self.next.kind == "param":
            return Node("param", name=self.one("param").text[1:], path=[])
        neg = self.take("-")
        if self.is_("UUID") and self.peek().kind == "string":
            self.at += 1
        t = self.one("number", "string", "word", "duration", "bytes")
        if t.kind in ("word", "duration", "bytes"):
            return Node("lit", value=t.text, type="string")
        if t.kind == "number" and not isinstance(t.value, int):
            raise Refused("UnexpectedToken", "an identity is a whole number or text")
        return Node("lit", value=-t.value if neg else t.value, type="int" if t.kind == "number" else "string")

    def record(self) -> Node:
        n = self.name()
        self.need(":")
        return Node("record", table=n, id=self.identity())

    # ---- expressions

    def expression(self) -> Node:
        a = self.conjunction()
        while self.take("OR"):
            a = Node("or", a=a, b=self.conjunction())
        return a

    def conjunction(self) -> Node:
        a = self.negation()
        while self.take("AND"):
            a = Node("and", a=a, b=self.negation())
        return a

    def negation(self) -> Node:
        return Node("not", a=self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self) -> Node:
        a = self.coalesce()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.take(op):
                return Node("cmp", op=op, a=a, b=self.coalesce())
        if self.take("NOT", "IN"):
            return Node("not", a=Node("in", a=a, b=self.coalesce()))
        if op := self.any_of("IN", "CONTAINS", "LIKE", "ILIKE"):
            return Node(op.lower(), a=a, b=self.coalesce())
        if self.take("MATCHES"):
            mode = (self.any_of("PREFIX", "FUZZY", "INFIX") or "TERM").lower()
            return Node("matches", a=a, mode=mode, b=self.coalesce())
        return a

    def coalesce(self) -> Node:
        a = self.range()
        while self.take("??"):
            a = Node("coalesce", a=a, b=self.range())
        return a

    def range(self) -> Node:
        a = self.sum_()
        if op := self.any_of("..=", ".."):
            return Node("range", a=a, b=self.sum_(), closed=op == "..=")
        return a

    def sum_(self) -> Node:
        a = self.product()
        while op := self.any_of("+", "-"):
            a = Node("arith", op=op, a=a, b=self.product())
        return a

    def product(self) -> Node:
        a = self.operand()
        while op := self.any_of("*", "/", "%"):
            a = Node("arith", op=op, a=a, b=self.operand())
        return a

    def operand(self) -> Node:
        if self.take("-"):
            return Node("neg", a=self.operand())
        return self.primary()

    def steps(self) -> list:
        out: list = []
        while True:
            if self.is_(".") and self.peek().kind in ("word", "string"):
                self.at += 1
                out.append(self.name())
            elif self.take("["):
                if self.take("*"):
                    out.append("*")
                    out[-1] = None  # every element
                else:
                    neg = self.take("-")
                    v = self.one("number").value
                    out.append(-v if neg else v)
                self.need("]")
            else:
                return out

    def path(self) -> Node:
        return Node("path", steps=[self.name(), *self.steps()])

    def primary(self) -> Node:
        t = self.next
        if t.kind in ("string", "number", "bytes", "duration"):
            self.at += 1
            kind = {"number": "int" if isinstance(t.value, int) else "float"}.get(t.kind, t.kind) if t.kind == "number" else t.kind
            return Node("lit", value=t.value, type=kind)
        if t.kind == "param":
            self.at += 1
            return Node("param", name=t.text[1:], path=self.steps())
        if self.take("("):
            if self.is_("SELECT") or self.is_("WITH"):
                r = Node("subquery", read=self.read())
            else:
                r = self.expression()
            self.need(")")
            steps = self.steps()
            return Node("into", a=r, path=steps) if steps else r
        if self.take("["):
            items = [] if self.is_("]") else self.listed(self.expression)
            self.need("]")
            return Node("array", items=items)
        if self.is_("{"):
            return self.object()
        if t.kind != "word":
            raise self.fail("a value")
        if t.upper in ("TRUE", "FALSE"):
            self.at += 1
            return Node("lit", value=t.upper == "TRUE", type="bool")
        if t.upper in ("NONE", "NULL"):
            self.at += 1
            return Node("lit", value=None, type="none")
        if t.upper == "DEC" and self.peek().kind == "number":
            self.at += 1
            return Node("lit", value=self.one("number").text, type="decimal")
        if t.upper in ("DATETIME", "UUID") and self.peek().kind == "string":
            self.at += 1
            return Node("lit", value=self.string(), type=t.upper.lower())
        if t.upper == "GEOMETRY" and self.peek().text == "{":
            self.at += 1
            return Node("geometry", shape=self.object())
        if t.upper == "SET" and self.peek().text == "[":
            self.at += 2
            items = [] if self.is_("]") else self.listed(self.expression)
            self.need("]")
            return Node("set", items=items)
        if t.upper == "IF":
            self.at += 1
            c = self.expression()
            self.need("THEN")
            a = self.expression()
            b = Node("lit", value=None, type="none")
            if self.take("ELSE"):
                b = self.expression()
                if b.kind == "if" and not self.is_("END"):  # ELSE IF shares its END
                    return Node("if", c=c, a=a, b=b)
            self.need("END")
            return Node("if", c=c, a=a, b=b)
        if t.upper in ("GET", "TTL") and self.peek().kind == "word" and self.peek(2).text == ":":
            self.at += 1
            return Node(t.upper.lower(), key=self.record())
        if self.peek().text == "(" and (t.text.lower() in FOLDS or t.text.lower() in WINDOWS or "::" in t.text):
            return self.called()
        if "::" in t.text:
            raise self.fail("a value")
        if self.peek().text == ":" and self.peek(2).kind in ("number", "string", "word", "param") and self.peek().at == t.at + len(t.text):
            return self.record()
        return self.path()

    def object(self) -> Node:
        self.need("{")
        fields = []
        while not self.take("}"):
            n = self.name()
            self.need(":")
            fields.append((n, self.expression()))
            if not self.take(","):
                self.need("}")
                break
        return Node("object", fields=fields)

    def called(self) -> Node:
        name = self.one("word").text
        self.need("(")
        distinct, star, args = False, False, []
        if self.take("*"):
            star = True
        elif not self.is_(")"):
            distinct = self.take("DISTINCT")
            args = self.listed(self.expression)
        self.need(")")
        if "::" in name:
            made, steps = Node("call", name=name.lower(), args=args), self.steps()
            return Node("into", a=made, path=steps) if steps else made
        node = Node("fold", name=name.lower(), args=args, star=star, distinct=distinct)
        if self.take("OVER"):
            self.need("(")
            part = self.listed(self.expression) if self.take("PARTITION", "BY") else []
            order = self.listed(self.key) if self.take("ORDER", "BY") else []
            self.need(")")
            return Node("window", name=node.name, args=args, star=star, partition=part, order=order)
        if node.name in WINDOWS:
            raise self.fail("OVER")
        return node

    # ---- writes

    def returned(self) -> str | None:
        return self.any_of("BEFORE", "AFTER", "NONE", "POSITION") if self.take("RETURN") else None

    def sets(self) -> list[tuple[list, Node]]:
        def one() -> tuple[list, Node]:
            p = self.path().steps
            self.need("=")
            return p, self.expression()

        return self.listed(one)

    def _create(self) -> Node:
        n = self.name()
        i = self.identity() if self.take(":") else None
        self.need("=")
        return Node("create", table=n, id=i, value=self.expression(), answer=self.returned())

    def _upsert(self) -> Node:
        r = self.record()
        if self.take("SET"):
            return Node("upsert", row=r, sets=self.sets(), answer=self.returned())
        self.need("=")
        return Node("upsert", row=r, value=self.expression(), answer=self.returned())

    def _insert(self) -> Node:
        self.need("INTO")
        n = self.name()
        self.need("(")
        names = self.listed(self.name)
        self.need(")")
        s = Node("insert", table=n, names=names)
        if self.take("VALUES"):

            def row() -> list[Node]:
                self.need("(")
                vs = self.listed(self.expression)
                self.need(")")
                if len(vs) != len(names):
                    raise Refused("WrongNumberOfValues", f"{len(vs)} for {len(names)} names")
                return vs

            s.rows = self.listed(row)
        else:
            s.read = self.read()
        if self.take("ON", "CONFLICT", "DO"):
            if self.take("NOTHING"):
                s.conflict = "nothing"
            else:
                self.need("UPDATE")
                s.conflict = "update"
        s.answer = self.returned()
        return s

    def _update(self) -> Node:
        n = self.name()
        s = Node("update", table=n)
        if self.take(":"):
            s.id = self.identity()
        if s.id is not None and self.take("="):
            s.value = self.expression()
        elif self.take("MERGE"):
            s.merge = self.expression()
        else:
            self.need("SET")
            s.sets = self.sets()
        if self.take("WHERE"):
            s.where = self.expression()
        if self.take("LIMIT"):
            s.limit = None if self.take("ALL") else self.integer()
        s.answer = self.returned()
        if s.id is None and s.where is None:
            raise Refused("UnexpectedToken", "an update of a table has a WHERE")
        return s

    def _delete(self) -> Node:
        if not self.take("FROM"):
            n = self.name()
            self.need(":")
            i = self.identity()
            if self.take("->"):
                e = self.name()
                self.need("->")
                return Node("unrelate", source=Node("record", table=n, id=i), edge=e, target=self.record())
            return Node("delete", table=n, id=i, answer=self.returned())
        n = self.name()
        if self.take(":"):
            low = self.identity()
            op = self.any_of("..=", "..")
            if not op:
                raise self.fail("a span")
            s = Node("delete", table=n, low=low, high=self.identity(), closed=op == "..=")
            if self.take("LIMIT"):
                s.limit = None if self.take("ALL") else self.integer()
            return s
        self.need("WHERE")
        s = Node("delete", table=n, where=self.expression())
        if self.take("LIMIT"):
            s.limit = None if self.take("ALL") else self.integer()
        s.answer = self.returned()
        return s

    def _relate(self) -> Node:
        a = self.record()
        self.need("->")
        e = self.name()
        self.need("->")
        b = self.record()
        return Node("relate", source=a, edge=e, target=b, value=self.expression() if self.take("=") else None)

    def _truncate(self) -> Node:
        self.need("TABLE")
        return Node("truncate", table=self.name())

    # ---- values

    def _let(self) -> Node:
        n = self.one("param").text[1:]
        self.need("=")
        return Node("let", name=n, value=self.read() if self.is_("SELECT") or self.is_("WITH") else self.expression())

    def _return(self) -> Node:
        return Node("return", value=self.expression())

    def _throw(self) -> Node:
        v = self.expression()
        return Node("throw", value=v, when=self.expression() if self.take("IF") or self.take("WHEN") else None)

    def _explain(self) -> Node:
        return Node("explain", read=self.read())

    def _verify(self) -> Node:
        return Node("verify")

    # ---- definitions

    def _use(self) -> Node:
        what = self.any_of("NAMESPACE", "DATABASE", "CONSUMER")
        if not what:
            raise self.fail("NAMESPACE, DATABASE or CONSUMER")
        s = Node("use", what=what.lower(), name=self.name())
        if what == "NAMESPACE" and self.take("DATABASE"):
            s.database = self.name()
        return s

    def _define(self) -> Node:
        what = self.one("word").upper
        if what in ("KAFKA", "TOPIC") and self.is_("CONSUMER"):
            self.need("CONSUMER")
            what += "_CONSUMER"
        if what == "TABLE" and self.take("ACCESS"):
            raise Refused("OutOfScope", "access is the deployment's")
        s = Node("define", what=what.lower())
        s.absent = self.take("IF", "NOT", "EXISTS")
        s.replace = self.take("OR", "REPLACE")
        if what == "PARAM":
            s.name = self.one("param").text[1:]
            self.need("VALUE")
            s.value = self.expression()
            return s
        s.name = self.name()
        made = getattr(self, f"_define_{what.lower()}", None)
        if made is not None:
            made(s)
        elif what not in ("NAMESPACE", "DATABASE", "GRAPH", "COLLECTION", "GEO"):
            raise self.fail("something to define")
        return s

    def _options(self, s: Node, **known: Callable[[], Any]) -> None:
        """Options in any order, by their words with _ for a space."""
        while True:
            for k, f in known.items():
                if self.take(*k.split("_")):
                    setattr(s, k.lower(), f())
                    break
            else:
                return

    def _define_table(self, s: Node) -> None:
        s.fields = []
        if self.take("("):
            while not self.take(")"):
                f = Node("field", name=self.name())
                f.type = self.field_type()
                f.required = self.take("REQUIRED")
                s.fields.append(f)
                self.take(",")
        yes = lambda: True
        self._options(s, SCHEMAFULL=yes, SCHEMALESS=yes, EDGE=yes, FROM=self.name, TO=self.name, IN=self.name, IDENTITY=self.name, SPLIT_AT=lambda: self.listed(self.primary), PARTITION_BY=self.name, STORE_COLUMN=yes, PARTITIONS=self.integer, BY=self.name, EXPIRE_AFTER=self.duration)

    def _define_edge(self, s: Node) -> None:
        self.need("IN")
        s.graph = self.name()
        self.need("FROM")
        s.from_ = self.name()
        self.need("TO")
        s.to = self.name()

    def _define_space(self, s: Node) -> None:
        self._options(s, MAX=self.integer)

    _define_bucket = _define_space

    def _define_topic(self, s: Node) -> None:
        self._options(s, RETAIN_BYTES=self.integer, RETAIN=self.duration, PARTITIONS=self.integer, DEDUPLICATE=self.duration, ON=self.name)

    def _define_group(self, s: Node) -> None:
        self.need("ON", "TOPIC")
        s.topic = self.name()
        self._options(s, ACK_DEADLINE=lambda: None if self.take("NONE") else self.duration(), DELIVERIES=self.integer, IN_FLIGHT=self.integer, DEAD_LETTER_TO=self.name)

    def _define_vector(self, s: Node) -> None:
        self._options(s, DIMENSION=self.integer, DISTANCE=self.name, QUANTIZED=lambda: True)

    def _define_index(self, s: Node) -> None:
        self.need("ON")
        s.table = self.name()
        self.need("FIELDS")
        s.fields = self.listed(self.route)
        s.use = self.any_of("UNIQUE", "SEARCH", "VECTOR", "SPATIAL", "CONTAINING")
        if s.use == "VECTOR":
            s.distance = self.name()
            s.quantized = self.take("QUANTIZED")
        while self.any_of("POSITIONS", "OFFSETS", "CONTAINS"):
            pass

    def field_type(self) -> str:
        if self.next.kind == "string":
            kinds = [self.string()]
            while self.take("|") or self.take(","):
                kinds.append(self.string())
            return "one of " + ", ".join(map(repr, kinds))
        t = self.name().lower()
        if t == "vector" and self.take("<"):
            t = f"vector<{self.one('number').value}>"
            self.need(">")
        if t == "record" and self.take("<"):
            t = f"record<{self.name()}>"
            self.need(">")
        return t

    def _define_field(self, s: Node) -> None:
        self.need("ON")
        s.table = self.name()
        self._field_rest(s)

    def _field_rest(self, s: Node) -> None:
        def asserted() -> str:
            begun = self.at
            self.expression()
            return self.source(begun)

        def default() -> str:
            begun = self.at
            self.expression()
            return self.source(begun)

        def action() -> str:
            return (self.any_of("REJECT", "CASCADE", "UNSET") or "REJECT").lower()

        self._options(s, TYPE=self.field_type, REQUIRED=lambda: True, DEFAULT=default, ASSERT=asserted, ANALYZER=self.name, REFERENCES=self.name, ON_DELETE=action, USING=default)

    def _define_analyzer(self, s: Node) -> None:
        self.need("FILTERS")

        def one() -> str:
            f = self.name().lower()
            if f == "stemmer" and self.take("("):
                f = f"stemmer({self.name().lower()})"
                self.need(")")
            return f

        s.filters = self.listed(one)

    def _define_search(self, s: Node) -> None:
        s.members = []
        while self.take("ON"):
            m = Node("member", table=self.name(), fields=[])
            self.need("FIELDS")

            def one() -> tuple[str, float, bool]:
                n = self.name()
                w = self.one("number").value if self.take("WEIGHT") else 1
                return n, float(w), self.take("SNIPPET")

            m.fields = self.listed(one)
            self._options(m, ANALYZER=self.name, SYNONYMS=self.name, STOPWORDS=self.name)
            m.snippet = self.take("SNIPPET")
            s.members.append(m)

    def _define_synonyms(self, s: Node) -> None:
        s.value = self.object()

    def _define_stopwords(self, s: Node) -> None:
        s.value = self.primary()

    def _define_queue(self, s: Node) -> None:
        def before() -> str:
            return self.name()

        self._options(s, TIMEOUT=self.duration, ATTEMPTS=self.integer, PRIORITY_BY=self.name, NOT_BEFORE=before, DEDUPLICATE=self.duration, ON=self.name, DEAD_LETTER_TO=self.name, IN=self.name, SCHEMAFULL=lambda: True, SCHEMALESS=lambda: True)

    def _define_series(self, s: Node) -> None:
        self._options(s, RETAIN=self.duration, TIME=self.name, STORE_COLUMN=lambda: True, PARTITIONS=self.integer, BY=self.name)

    def _define_rollup(self, s: Node) -> None:
        self.need("FROM")
        s.series = self.name()
        self.need("WINDOW")
        s.window = self.duration()
        s.by = self.name() if self.take("BY") else None
        self.need("COMPUTE")
        s.compute = self.listed(self.item)
        self._options(s, RETAIN=self.duration)

    def _define_view(self, s: Node) -> None:
        s.materialized = self.take("MATERIALIZED")
        self.need("AS")
        begun = self.at
        s.read = self.read()
        s.body = self.source(begun)

    def _define_event(self, s: Node) -> None:
        self.need("ON")
        s.table = self.name()
        s.ops = []
        if self.take("FOR"):
            s.ops = self.listed(lambda: self.any_of("CREATE", "UPDATE", "DELETE"))
        if self.take("WHEN"):
            s.when = self.expression()
        self.need("THEN")
        s.then = self.statement()

    def _define_feed(self, s: Node) -> None:
        self.need("ON")
        s.table = self.name()
        self.need("INTO")
        s.topic = self.name()
        s.image, s.ops = "full", []
        while True:
            if self.take("IMAGE"):
                s.image = (self.any_of("KEYS", "FULL") or "FULL").lower()
            elif self.take("FOR"):
                s.ops = self.listed(lambda: self.any_of("CREATE", "UPDATE", "DELETE"))
            elif self.take("WHEN"):
                s.when = self.expression()
            elif self.take("WITH", "INITIAL", "SCAN"):
                s.scan = True
            else:
                return

    def _consumer(self, s: Node) -> None:
        self.need("FROM")
        s.brokers = self.listed(self.string) if self.next.kind == "string" else None
        s.topic = self.name() if s.what == "topic_consumer" else None
        mapped = lambda: self.listed(lambda: (self.name(), self.name() if self.take("AS") else None))
        self._options(s, TOPIC=self.name, GROUP=self.name, INTO=self.name, FORMAT=self.name, IDENTITY=self.name, MAP=mapped, ON_FAILURE=lambda: self.name().lower(), AT=self.name)

    _define_kafka_consumer = _consumer
    _define_topic_consumer = _consumer

    def _drop(self) -> Node:
        what = self.one("word").upper
        if what in ("KAFKA", "TOPIC") and self.is_("CONSUMER"):
            self.need("CONSUMER")
            what += "_CONSUMER"
        s = Node("drop", what=what.lower())
        s.absent = self.take("IF", "EXISTS")
        s.name = self.one("param").text[1:] if what == "PARAM" else self.name()
        if self.take("ON"):
            self.take("TOPIC")
            s.table = self.name()
        return s

    def _alter(self) -> Node:
        if self.take("GROUP"):
            s = Node("alter_group", name=self.name())
            self.need("ON", "TOPIC")
            s.topic = self.name()
            if self.take("START", "AT"):
                s.start = self.integer()
            elif how := self.any_of("ADD", "DROP"):
                self.need("MEMBER")
                s.member, s.add = self.name(), how == "ADD"
            else:
                raise self.fail("START AT, ADD or DROP")
            return s
        self.need("TABLE")
        s = Node("alter_table", table=self.name())
        if self.take("SET"):
            s.strict = self.any_of("SCHEMAFULL", "SCHEMALESS")
        elif self.take("ADD", "FIELD"):
            s.add = Node("field", name=self.name())
            self._field_rest(s.add)
        elif self.take("DROP", "FIELD"):
            s.drop = self.name()
        elif self.take("RENAME", "FIELD"):
            s.field = self.name()
            self.need("TO")
            s.to = self.name()
        elif self.take("RENAME", "TO"):
            s.rename = self.name()
        elif self.take("ALTER", "FIELD"):
            s.alter = Node("field", name=self.name())
            self._field_rest(s.alter)
        elif self.take("SPLIT"):
            s.split = self.integer() if self.next.kind == "number" else None
            if self.take("AT"):
                s.at = self.primary()
        elif self.take("MERGE"):
            s.merge = True
        elif self.take("EXPIRE", "AFTER"):
            s.expire = self.duration()
        else:
            raise self.fail("something to alter")
        return s

    def _info(self) -> Node:
        self.need("FOR")
        what = self.one("word").upper.lower()
        return Node("info", what=what, name=self.name() if self.next.kind in ("word", "string") else None)

    def _check(self) -> Node:
        self.need("TABLE")
        return Node("check", table=self.name())

    def _analyze(self) -> Node:
        self.need("TABLE")
        return Node("analyze", table=self.name())

    def _rebuild(self) -> Node:
        self.need("INDEX")
        s = Node("rebuild", name=self.name())
        self.need("ON")
        s.table = self.name()
        return s

    # ---- queues and topics

    def _claim(self) -> Node:
        if self.next.kind == "word" and not self.is_("FROM"):
            return Node("claim", row=self.record())
        n = 1 if self.is_("FROM") else self.integer()
        if n == 0:
            raise Refused("UnexpectedToken", "a claim of nothing")
        self.need("FROM")
        return Node("claim", table=self.name(), n=n, where=self.expression() if self.take("WHERE") else None)

    def _release(self) -> Node:
        if self.take("ALL"):
            self.need("FROM")
            s = Node("release", table=self.name())
        else:
            s = Node("release", row=self.record())
        s.consumer = self.name() if self.take("FOR", "CONSUMER") else None
        return s

    def _member(self) -> dict:
        self.need("FOR", "CONSUMER")
        return {"group": self.name(), "member": self.name() if self.take("MEMBER") else None}

    def _read(self) -> Node:
        if not self.take("FROM"):
            s = Node("read_file", file=self.record())
            self._options(s, START=self.integer, LIMIT=self.integer)
            return s
        s = Node("read_topic", topic=self.name())
        if self.is_("FOR", "CONSUMER"):
            s.__dict__.update(self._member())
        self._options(s, AFTER=lambda: self.name() if self.next.kind == "string" else self.integer(), SINCE=self.primary, LIMIT=self.integer, HELD=lambda: True)
        return s

    def _ack(self) -> Node:
        s = Node("ack", topic=self.name())
        s.__dict__.update(self._member())
        self.need("AT")
        s.positions = self.listed(self.integer)
        return s

    def _nack(self) -> Node:
        s = self._ack()
        s.kind = "nack"
        s.delay = self.duration() if self.take("DELAY") else 0
        return s

    def _hand(self) -> Node:
        s = Node("hand", topic=self.name())
        s.__dict__.update(self._member())
        self._options(s, AFTER=self.integer, LIMIT=self.integer)
        self.need("TO")
        s.to = self.name()
        return s

    def _trim(self) -> Node:
        s = Node("trim", topic=self.name())
        if self.take("KEEP"):
            s.keep = self.integer()
        else:
            self.need("BEFORE")
            s.before = self.name() if self.next.kind == "string" else self.integer()
        return s

    # ---- keys and files

    def _get(self) -> Node:
        return Node("get", key=self.record())

    def _ttl(self) -> Node:
        return Node("ttl", key=self.record())

    def _set(self) -> Node:
        s = Node("set_key", key=self.record())
        self.need("=")
        s.value = self.expression()
        while True:
            self._options(s, EXPIRE=self.duration)
            if not self.take("IF"):
                return s
            if self.take("="):
                s.expected = self.expression()
            elif self.take("ABSENT") or self.take("NONE"):
                s.absent = True
            else:
                self.need("PRESENT")
                s.present = True

    def _incr(self) -> Node:
        return Node("incr", key=self.record(), by=self.expression() if self.take("BY") else Node("lit", value=1, type="int"))

    def _expire(self) -> Node:
        return Node("expire", key=self.record(), after=self.duration())

    def _persist(self) -> Node:
        return Node("persist", key=self.record())

    def _del(self) -> Node:
        s = Node("del", key=self.record())
        if self.take("IF"):
            self.need("=")
            s.expected = self.expression()
        return s

    def _put(self) -> Node:
        s = Node("put", file=self.record())
        s.start = self.integer() if self.take("START") else None
        self.need("=")
        s.value = self.expression()
        return s

    def _keys(self) -> Node:
        self.need("FROM")
        s = Node("keys", space=self.name())

        def span() -> tuple:
            a = self.identity()
            op = self.any_of("..=", "..")
            return a, self.identity(), op == "..="

        self._options(s, RANGE=span, PREFIX=self.string, AFTER=self.identity, LIMIT=self.integer)
        return s

    def _container(self, kind: str) -> Node:
        op = self.one("word").upper
        s = Node(kind, op=op.lower(), key=self.record(), args=[], pairs=[])
        if op == "REMOVE" and kind == "scores" and self.next.upper in ("RANK", "SCORE", "MEMBER"):
            s.op = f"remove_{self.one('word').text.lower()}"
        s.end = self.any_of("FRONT", "BACK", "LOWEST", "HIGHEST")
        if op == "MOVE" and kind == "list":
            self.need("TO")
            s.to = self.record()
            s.to_end = self.any_of("FRONT", "BACK")
            return s
        if self.take("AT"):
            s.at = self.operand()
        if self.take("FROM"):
            s.low = self.operand()
            s.open_low = self.take("EXCLUSIVE")
            self.need("TO")
            s.high = self.operand()
            s.open_high = self.take("EXCLUSIVE")
        while self.next.kind not in ("end",) and not self.is_(";") and not any(self.is_(w) for w in ("LIMIT", "BY", "AT", "TO", "IF", "BEFORE", "AFTER", "FROM")):
            v = self.operand()
            if self.take("="):
                s.pairs.append((v, self.expression()))
            else:
                s.args.append(v)
            if not self.take(",") and not (self.is_("=")):
                break
        if self.take("="):
            s.args.append(self.expression())
        ends = {"LIMIT": ("limit", self.integer), "BY": ("by", self.operand), "AT": ("at", self.operand), "BEFORE": ("before", self.operand), "AFTER": ("after", self.operand)}
        while True:
            for w, (field, f) in ends.items():
                if self.take(w):
                    setattr(s, field, f())
                    break
            else:
                if self.take("FROM", "BACK"):
                    s.back = True
                elif self.take("TO"):
                    s.to = self.record()
                elif self.take("IF"):
                    s.when = self.one("word").upper
                else:
                    return s

    def _list(self) -> Node:
        return self._container("list")

    def _hash(self) -> Node:
        return self._container("hash")

    def _members(self) -> Node:
        return self._container("members")

    def _scores(self) -> Node:
        return self._container("scores")


_STATEMENTS = frozenset(
    "CREATE UPSERT INSERT UPDATE DELETE RELATE TRUNCATE LET RETURN THROW EXPLAIN VERIFY USE DEFINE DROP ALTER INFO CHECK ANALYZE REBUILD CLAIM RELEASE READ ACK NACK HAND TRIM GET TTL SET INCR EXPIRE PERSIST DEL PUT KEYS LIST HASH MEMBERS SCORES".split()
)


def parse(text: str) -> list[Node]:
    return Parser(text).script()


def parse_expression(text: str) -> Node:
    p = Parser(text)
    e = p.expression()
    if p.next.kind != "end":
        raise p.fail("the end")
    return e
