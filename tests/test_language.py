"""Scripts and what they answer, in the order of one session."""

import pytest

from polystrata.lang import Refused, Session
from polystrata.lang.parser import parse


class Script:
    def __init__(self, spark):
        self.s = Session(spark)

    def ok(self, text):
        self.s.run(text)

    def rows(self, text):
        return self.s.run(text)[-1].rows()

    def value(self, text):
        return self.s.run(text)[-1].value

    def refused(self, text, kind):
        with pytest.raises(Refused) as e:
            answer = self.s.run(text)[-1]
            if answer.frame is not None:
                answer.frame.collect()
        assert e.value.kind == kind, str(e.value)


@pytest.fixture
def q(spark):
    return Script(spark)


def test_grammar():
    parse("SELECT * FROM a WHERE x = 1 OR NOT y IN [1, 2] ORDER BY x DESC NULLS LAST, y LIMIT 3 START 1; # remark\nRETURN 1..=3; LET $a = (SELECT b FROM c);")
    for bad in ("SELECT FROM a", "SELECT x FROM a INTERSECT ALL SELECT x FROM b", "SELECT 1 FROM a", "SELECT * FROM a AS b", "UPDATE a SET b = 1", "SELECT row_number() AS n FROM a", "RETURN 'open", "CLAIM 0 FROM q", "SELECT x FROM a HAVING x"):
        with pytest.raises(Refused):
            parse(bad)
    for out in ("BEGIN", "DEFINE USER a", "GRANT select ON t", "DEFINE VAULT v", "BACKUP"):
        with pytest.raises(Refused, match="OutOfScope"):
            parse(out)


def test_values(q):
    v = lambda e: q.value(f"RETURN {e}")
    assert v("1 + 2 * 3 - 4 % 3") == 6 and v("7 / 2") == pytest.approx(3.5) and v("-(2 - 5)") == 3 and v("'a' + 'b'") == "ab"
    assert v("IF 1 > 2 THEN 'x' ELSE IF 2 > 1 THEN 'y' ELSE 'z' END") == "y" and v("NONE ?? 5") == 5 and v("[1, 2, 3]") == [1, 2, 3]
    assert v("1 = 1.0") is True and v("'1' = 1") is False and v("'1' != 1") is True and v("NONE != 5") is True and v("NONE < 5") is False and v("5 < 'a'") is True and v("true < 0") is True
    assert v("3 IN [1, 3.0]") is True and v("3 IN 1..3") is False and v("3 IN 1..=3") is True and v("[1, 2] CONTAINS 2") is True and v("{ a: 1, b: { c: 2 } } CONTAINS { b: { c: 2 } }") is True
    assert v("'a_c' LIKE 'a\\\\_c'") is True and v("'abc' LIKE 'a\\\\_c'") is False and v("'ABC' ILIKE 'a%'") is True and v("5 LIKE '5'") is False
    assert v("set [3, 1, 3]") == [1, 3] and v("{ a: 1 } = { a: 1 }") is True and v("{ a: 1 } = { a: 1, b: 2 }") is False
    assert str(v("datetime '2026-03-01T01:00:00Z' + 90m")) == "2026-03-01 02:30:00" and v("datetime '2026-03-01T01:00:00Z' - datetime '2026-03-01T00:00:00Z' = 1h") is True
    assert v("string::upper('x') + type::of(NONE)") == "Xnone"
    for bad, kind in (("string::none('a')", "NoSuchFunction"), ("string::len()", "WrongArity"), ("string::len(5)", "CallFailed"), ("NOT 5", "NotACondition"), ("$nobody", "NoSuchParameter"), ("'a' * 2", "CannotCompute")):
        q.refused(f"RETURN {bad}", kind)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|Division"):
        v("1 / 0")
    q.ok("LET $a = 6; LET $b = [1, { c: 7 }]; DEFINE PARAM $p VALUE 3;")
    assert v("$a * $p") == 18
    q.refused("THROW 'stop'", "Thrown")
    q.ok("THROW 'never' IF 1 > 2")


def test_documents_and_reads(q):
    q.ok("""DEFINE COLLECTION people;
      CREATE people:1 = { name: 'ada', age: 17, tags: ['urgent', 'new'], home: { city: 'Paris', zip: 1 } };
      CREATE people:2 = { name: 'grace', age: 45, tags: [], home: { city: 'Lyon' } };
      CREATE people:3 = { name: 'alan' };""")
    n = lambda w: [r["id"] for r in q.rows(f"SELECT id FROM people WHERE {w} ORDER BY id")]
    assert n("age > 18") == [2] and n("age < 1000") == [1, 2] and n("NOT (age = 17)") == [2, 3] and n("age = NONE") == [3] and n("age != 17") == [2, 3]
    assert n("home.city = 'Paris'") == [1] and n("home.nothing = 1") == [] and n("tags CONTAINS 'new'") == [1] and n("tags[*] = 'urgent'") == [1] and n("tags[0] = 'urgent'") == [1] and n("home CONTAINS { city: 'Lyon' }") == [2]
    assert q.rows("SELECT * FROM people:2") == [{"id": 2, "name": "grace", "age": 45, "tags": [], "home": {"city": "Lyon"}}]
    assert q.rows("SELECT * OMIT tags, home.zip, age FROM people:1") == [{"id": 1, "name": "ada", "home": {"city": "Paris"}}]
    assert sorted((r["id"], r.get("tags")) for r in q.rows("SELECT id, tags FROM people SPLIT ON tags")) == [(1, "new"), (1, "urgent"), (3, None)]
    assert [r["name"] for r in q.rows("SELECT name FROM people ORDER BY age")] == ["alan", "ada", "grace"] and [r["name"] for r in q.rows("SELECT name FROM people ORDER BY age DESC NULLS FIRST")] == ["alan", "grace", "ada"]
    assert [r["name"] for r in q.rows("SELECT name FROM people ORDER BY age DESC AFTER people:1")] == ["alan"]
    assert q.rows("SELECT count(age) AS n, sum(age) AS s, collect(name) AS all FROM people") == [{"n": 2, "s": 62, "all": ["ada", "grace", "alan"]}]
    assert q.rows("SELECT sum(name) AS s FROM people") == [{"s": 0}] and q.rows("SELECT count(*) AS n FROM people WHERE age > 99") == []
    with pytest.raises(ValueError):
        q.rows("SELECT * FROM ONLY people")
    assert q.value("RETURN (SELECT name FROM ONLY people:3).name") == "alan" and q.value("RETURN (SELECT name FROM people WHERE age > 40)") == [{"name": "grace"}]
    q.refused("SELECT name, count(*) AS n FROM people GROUP BY age", "NotGrouped")
    q.refused("SELECT * FROM people WHERE name", "NotACondition")
    q.refused("SELECT * FROM nobody", "Unknown")
    q.refused("SELECT * FROM people TIMEOUT 0s", "TimedOut")
    assert len(q.rows("SELECT * FROM people TIMEOUT 1h")) == 3 and any("Scan" in r["plan"] for r in q.rows("EXPLAIN SELECT * FROM people"))


def test_joins(q):
    q.ok("""DEFINE COLLECTION users; DEFINE COLLECTION orders;
      INSERT INTO users (id, name, qty, boss) VALUES (1, 'ada', 3, NONE), (2, 'grace', 4, 1);
      INSERT INTO orders (id, who, qty, by) VALUES (1, 'ada', 3.0, users:1), (2, 'ada', 9.5, users:2), (3, 'nobody', NONE, users:9);""")
    assert len(q.rows("SELECT * FROM users JOIN orders ON orders.who = users.name")) == 2 and len(q.rows("SELECT * FROM users JOIN orders ON users.qty = orders.qty")) == 1
    full = q.rows("SELECT * FROM users FULL JOIN orders ON users.name = orders.who")
    assert len(full) == 4 and sum("users" not in r for r in full) == 1 and sum("orders" not in r for r in full) == 1
    assert len(q.rows("SELECT * FROM users LEFT JOIN orders ON users.missing = orders.who")) == 2 and q.rows("SELECT * FROM users JOIN orders ON users.missing = orders.who") == []
    assert q.rows("SELECT p.name AS n, b.name AS b FROM users AS p JOIN users AS b ON p.boss = b.id") == [{"n": "grace", "b": "ada"}]
    q.refused("SELECT * FROM users AS x JOIN orders AS x ON x.name = x.who", "OneSidedJoin")
    q.refused("SELECT * FROM users JOIN orders ON users.name = orders.qty", "JoinKeysDiffer")
    assert [r["by"].get("name") if "by" in r else None for r in q.rows("SELECT id, by FROM orders FETCH by ORDER BY id")] == ["ada", "grace", None]
    assert q.rows("SELECT name FROM users WHERE qty IN (SELECT qty FROM orders)") == [{"name": "ada"}]
    assert len(q.rows("SELECT name FROM users UNION ALL SELECT name FROM users UNION SELECT who AS name FROM orders")) == 3


def test_writes(q):
    q.ok("DEFINE TABLE staff (name string REQUIRED, age int); DEFINE FIELD team ON staff TYPE string DEFAULT 'none'; DEFINE FIELD level ON staff TYPE int ASSERT $value > 0 AND $value < 10; DEFINE INDEX by_name ON staff FIELDS name UNIQUE;")
    assert q.rows("CREATE staff:1 = { name: 'ada', age: 36 }") == [{"id": 1, "name": "ada", "age": 36, "team": "none"}]
    for text, kind in (("CREATE staff:1 = { name: 'x' }", "RecordExists"), ("CREATE staff:2 = { age: 3 }", "MissingRequiredField"), ("CREATE staff:2 = { name: 'b', level: 11 }", "AssertionFailed"), ("CREATE staff:2 = { name: 'b', shoe: 3 }", "UnknownField"),
                       ("CREATE staff:2 = { name: 5 }", "WrongType"), ("CREATE staff:2 = { name: 'ada' }", "UniqueViolation"), ("UPDATE staff:9 SET age = 1", "Unknown"), ("DELETE staff:9", "Unknown"), ("CREATE staff:'x' = { name: 'q' }", "IdentityKind")):
        q.refused(text, kind)
    q.ok("UPSERT staff:2 = { name: 'grace', age: 45 }; UPDATE staff:2 SET age = age + 1, level = 3; ALTER TABLE staff SET SCHEMALESS; UPDATE staff:2 MERGE { home: { city: 'Lyon' } }; UPDATE staff:2 MERGE { home: { zip: 7 } };")
    assert q.rows("SELECT * FROM staff:2") == [{"id": 2, "name": "grace", "age": 46, "team": "none", "level": 3, "home": {"city": "Lyon", "zip": 7}}]
    assert q.rows("UPDATE staff SET age = 1 WHERE age > 40 RETURN BEFORE")[0]["age"] == 46
    assert q.rows("INSERT INTO staff (id, name) VALUES (2, 'new'), (3, 'alan') ON CONFLICT DO NOTHING") == [{"id": 3, "name": "alan", "team": "none"}]
    assert [r["id"] for r in q.rows("SELECT id FROM staff VERSION 1")] == [1]
    assert q.s.run("DELETE FROM staff WHERE age = 1 LIMIT ALL")[-1].value == 1 and len(q.rows("SELECT * FROM staff")) == 2
    q.ok("DELETE FROM staff:3..9; ALTER TABLE staff RENAME FIELD team TO crew; ALTER TABLE staff RENAME TO crew;")
    assert q.rows("SELECT * FROM crew") == [{"id": 1, "name": "ada", "age": 36, "crew": "none"}]
    q.ok("ALTER TABLE crew ADD FIELD shoe TYPE int REQUIRED")
    assert [r["why"] for r in q.rows("CHECK TABLE crew")] == ["MissingRequiredField shoe"]
    q.refused("VERIFY", "Violated")
    assert {r["column"]: r["values"] for r in q.rows("ANALYZE TABLE crew")}["age"] == 1 and len(q.rows("INFO FOR TABLE crew")) > 3
    q.ok("TRUNCATE TABLE crew; DROP TABLE crew; DROP TABLE IF EXISTS crew")
    q.refused("SELECT * FROM crew", "Unknown")
    q.refused("DROP TABLE crew", "Unknown")


def test_references_and_graph(q):
    q.ok("""DEFINE COLLECTION city; CREATE city:1 = { n: 'a' }; CREATE city:2 = { n: 'b' }; CREATE city:3 = { n: 'c' }; CREATE city:4 = { n: 'd' };
      DEFINE GRAPH map; DEFINE EDGE road IN map FROM city TO city;
      RELATE city:1->road->city:2 = { km: 5 }; RELATE city:2->road->city:3 = { km: 1 }; RELATE city:1->road->city:3 = { km: 9 }; RELATE city:3->road->city:1 = { km: 2 };""")
    n = lambda text: [r["n"] for r in q.rows(text)]
    assert sorted(n("SELECT n FROM city:1->road->city")) == ["b", "c"] and n("SELECT n FROM city:1<-road<-city") == ["c"] and sorted(n("SELECT n FROM city:1->road->city->road->city")) == ["a", "c"]
    assert sorted(r["km"] for r in q.rows("SELECT km FROM city:1->road")) == [5, 9]
    assert sorted(n("SELECT n FROM city:1->road->city DEPTH 3")) == ["b", "c"]
    assert n("SELECT * FROM city:1->road->city PATH TO city:3 DEPTH 5 WEIGHT km") == ["a", "b", "c"] and n("SELECT * FROM city:1->road->city PATH TO city:3 DEPTH 5") == ["a", "c"] and n("SELECT * FROM city:1->road->city PATH TO city:4") == []
    q.refused("RELATE city:1->road->city:9", "Unknown")
    q.ok("DELETE city:1->road->city:3; DELETE city:2;")
    assert q.rows("SELECT * FROM city:1->road") == []
    q.ok("""DEFINE COLLECTION owner; CREATE owner:1 = { n: 'o' }; CREATE owner:2 = { n: 'p' }; DEFINE COLLECTION pet; DEFINE FIELD of ON pet TYPE record REFERENCES owner ON DELETE CASCADE;
      DEFINE COLLECTION toy; DEFINE FIELD of ON toy TYPE record REFERENCES pet ON DELETE REJECT; CREATE pet:1 = { of: owner:1 }; CREATE pet:2 = { of: owner:2 }; CREATE toy:1 = { of: pet:2 };""")
    q.refused("CREATE pet:3 = { of: owner:7 }", "DanglingReference")
    q.refused("DELETE owner:2", "Referenced")
    q.ok("DELETE owner:1")
    assert [r["id"] for r in q.rows("SELECT id FROM pet")] == [2]


def test_search(q):
    q.ok("""DEFINE ANALYZER simple FILTERS lowercase, ascii; DEFINE COLLECTION notes; DEFINE FIELD body ON notes TYPE string ANALYZER simple; DEFINE INDEX by_body ON notes FIELDS body SEARCH;
      INSERT INTO notes (id, title, body) VALUES (1, 'one', 'Ada Lovelace wrote the first program'), (2, 'two', 'a café of Lovelace'), (3, 'ada', 'nothing');
      DEFINE STOPWORDS common ['the', 'a']; DEFINE SYNONYMS writers { penned: ['wrote'] }; DEFINE SEARCH works ON notes FIELDS title WEIGHT 2, body ANALYZER simple SYNONYMS writers STOPWORDS common;""")
    n = lambda text: [r["id"] for r in q.rows(text)]
    assert sorted(n("SELECT id FROM notes WHERE body MATCHES 'lovelace'")) == [1, 2] and n("SELECT id FROM notes WHERE body MATCHES 'cafe' AND title = 'two'") == [2] and n("SELECT id FROM notes WHERE title MATCHES 'ada'") == []
    assert n("SELECT id FROM notes WHERE body MATCHES PREFIX 'prog'") == [1] and n("SELECT id FROM notes WHERE body MATCHES FUZZY 'lovelase program'") == [1]
    q.refused("SELECT * FROM notes WHERE body MATCHES PREFIX 'pr'", "PrefixTooShort")
    assert n("SELECT id FROM notes ORDER BY search::score(body, 'wrote') DESC LIMIT 1") == [1] and len(q.rows("SELECT search::score(body, 'wrote') AS s FROM notes")) == 3
    q.refused("SELECT search::score(title, 'x') AS s FROM notes", "NoSearchIndex")
    assert q.rows("SELECT search::highlight(body) AS m FROM notes WHERE body MATCHES 'ada'") == [{"m": [{"start": 0, "end": 3}]}]
    hits = q.rows("SELECT id, search::score() AS s, search::table_name() AS t FROM SEARCH works MATCHES 'ada'")
    assert [h["id"] for h in hits] == ["3", "1"] and {h["t"] for h in hits} == {"notes"} and hits[0]["s"] > hits[1]["s"]
    assert n("SELECT id FROM SEARCH works MATCHES 'the penned'") == ["1"] and [r["term"] for r in q.rows("SELECT term FROM SEARCH works COMPLETE 'lov'")] == ["lovelace"]


def test_time(q):
    q.ok("""DEFINE SERIES gauges RETAIN 36500d TIME at; DEFINE ROLLUP hourly FROM gauges WINDOW 1h BY sensor COMPUTE count(*) AS n, sum(v) AS total RETAIN 36500d;
      INSERT INTO gauges (id, at, sensor, v) VALUES (1, datetime '2026-03-01T00:05:00Z', 'a', 1), (2, datetime '2026-03-01T00:35:00Z', 'a', 2), (3, datetime '2026-03-01T03:10:00Z', 'b', 6);""")
    r = lambda: {(str(x["window"])[11:16], x["sensor"]): (x["n"], x["total"]) for x in q.rows("SELECT * FROM hourly")}
    assert r() == {("00:00", "a"): (2, 3), ("03:00", "b"): (1, 6)}
    q.ok("CREATE gauges:4 = { at: datetime '2026-03-01T00:50:00Z', sensor: 'a', v: 10 }; DELETE gauges:3;")
    assert r() == {("00:00", "a"): (3, 13)}
    assert [x["n"] for x in q.rows("SELECT time::bucket(at, 1h) AS w, count(*) AS n FROM gauges GROUP BY time::bucket(at, 1h) FILL 0 FROM datetime '2026-03-01T00:00:00Z' TO datetime '2026-03-01T03:00:00Z' ORDER BY w")] == [3, 0, 0]
    assert q.rows("SELECT sensor, v FROM gauges LATEST BY sensor") == [{"sensor": "a", "v": 10}]
    q.refused("DEFINE ROLLUP bad FROM gauges WINDOW 1h COMPUTE mean(v) AS m", "NoRollupOf")
    q.refused("DROP SERIES gauges", "HasRollup")
    q.ok("DEFINE SERIES short RETAIN 1h TIME at; INSERT INTO short (id, at) VALUES (1, datetime '2020-01-01T00:00:00Z'), (2, time::now());")
    assert [x["id"] for x in q.rows("SELECT id FROM short")] == [2]


def test_queues(q):
    q.ok("DEFINE QUEUE jobs TIMEOUT 30s; INSERT INTO jobs (id, url) VALUES (1, 'a'), (2, 'b'), (3, 'c');")
    c = lambda text: [r["id"] for r in q.rows(text)]
    assert c("CLAIM FROM jobs") == [1] and c("CLAIM 5 FROM jobs WHERE url != 'b'") == [3] and c("CLAIM 5 FROM jobs") == [2] and c("CLAIM FROM jobs") == []
    q.ok("RELEASE jobs:1")
    assert c("CLAIM jobs:1") == [1] and c("CLAIM jobs:1") == []
    for text, kind in (("CLAIM 501 FROM jobs", "ClaimAboveCeiling"), ("CREATE jobs:9 = { claimed_until: 1 }", "QueueFieldIsTheEngines"), ("UPDATE jobs:2 SET attempts = 0", "QueueFieldIsTheEngines"), ("CLAIM jobs:99", "Unknown")):
        q.refused(text, kind)
    q.ok("USE CONSUMER 'w'; DEFINE QUEUE fast TIMEOUT 1ns ATTEMPTS 2 PRIORITY BY p; INSERT INTO fast (id, p) VALUES (1, 1), (2, 5), (3, NONE);")
    assert [c("CLAIM FROM fast") for _ in range(5)] == [[2], [2], [1], [1], [3]] and q.value("RELEASE ALL FROM fast") == 0


def test_topics(q):
    q.ok("DEFINE TOPIC t; CREATE t:'a' = { n: 1 }; CREATE t:'b' = { n: 2 }; CREATE t:'c' = { n: 3 };")
    p = lambda text: [r["position"] for r in q.rows(text)]
    assert p("READ FROM t AFTER 1") == [2, 3] and p("READ FROM t AFTER 'b'") == [3] and p("READ FROM t LIMIT 1") == [1]
    assert p("READ FROM t FOR CONSUMER 'solo' LIMIT 2") == [1, 2] and p("READ FROM t FOR CONSUMER 'solo'") == [3] and p("READ FROM t FOR CONSUMER 'solo'") == []
    q.ok("DEFINE TOPIC dead; DEFINE GROUP 'g' ON TOPIC t ACK DEADLINE 30s IN FLIGHT 2 DELIVERIES 2 DEAD LETTER TO dead;")
    assert p("READ FROM t FOR CONSUMER 'g' LIMIT 9") == [1, 2] and p("READ FROM t FOR CONSUMER 'g'") == [] and q.value("ACK t FOR CONSUMER 'g' AT 1, 7") == 1 and p("READ FROM t FOR CONSUMER 'g'") == [3]
    assert q.value("NACK t FOR CONSUMER 'g' AT 3") == 1 and p("READ FROM t FOR CONSUMER 'g'") == [3] and q.value("NACK t FOR CONSUMER 'g' AT 3") == 1 and p("READ FROM t FOR CONSUMER 'g'") == [] and [r["n"] for r in q.rows("READ FROM dead")] == [3]
    q.ok("ALTER GROUP 'g' ON TOPIC t START AT 0")
    assert p("READ FROM t FOR CONSUMER 'g'") == [1, 2] and p("HAND t FOR CONSUMER 'g' TO 'bob'") == [1, 2]
    for text, kind in (("READ FROM t FOR CONSUMER 'g' AFTER 2", "AfterOnGroup"), ("ACK t FOR CONSUMER 'x' AT 1", "NotAGroup"), ("DEFINE GROUP 'g' ON TOPIC t", "GroupExists")):
        q.refused(text, kind)
    assert q.value("TRIM t KEEP 1") == 2 and p("READ FROM t") == [3]
    q.ok("DEFINE TOPIC once DEDUPLICATE 5m ON k; INSERT INTO once (k) VALUES ('x'), ('x'), ('y'); INSERT INTO once (k) VALUES ('x'), ('z');")
    assert sorted(r["k"] for r in q.rows("READ FROM once")) == ["x", "y", "z"]
    q.ok("DEFINE COLLECTION got; DEFINE TOPIC CONSUMER in FROM once INTO got IDENTITY k MAP k AS name ON FAILURE quarantine")
    assert q.s.drain("in") == 3 and q.s.drain("in") == 0 and len(q.rows("SELECT * FROM got")) == 3


def test_changes(q):
    q.ok("""DEFINE COLLECTION o; DEFINE COLLECTION log; DEFINE TOPIC ev; DEFINE EVENT audit ON o THEN CREATE log = { event: $event, key: $id, was: $before.v ?? 0, now: $after.v ?? 0 };
      DEFINE EVENT guard ON o WHEN $after.v < 0 THEN THROW 'negative'; DEFINE FEED big ON o INTO ev IMAGE KEYS WHEN $after.v > 10; DEFINE VIEW top MATERIALIZED AS SELECT * FROM o WHERE v > 5; DEFINE VIEW plain AS SELECT id FROM o WHERE v <= 5;
      INSERT INTO o (id, v) VALUES (1, 3), (2, 20); UPDATE o:1 SET v = 30; DELETE o:2;""")
    assert sorted((r["event"], r["key"], r["was"], r["now"]) for r in q.rows("SELECT * FROM log")) == [("create", "1", 0, 3), ("create", "2", 0, 20), ("delete", "2", 20, 0), ("update", "1", 3, 30)]
    assert [(r["op"], r["key"]) for r in q.rows("READ FROM ev")] == [("create", "2"), ("update", "1")]
    assert q.rows("SELECT * FROM top") == [{"id": 1, "v": 30}] and q.rows("SELECT * FROM plain") == []
    q.refused("CREATE o:5 = { v: -1 }", "Thrown")
    q.ok("DROP EVENT audit ON o; DROP FEED big ON o; DROP VIEW top;")
    q.refused("SELECT * FROM top", "Unknown")


def test_keys(q):
    q.ok("DEFINE SPACE c; SET c:'a' = 1; SET c:'b' = { x: [1] }; SET c:7 = 'seven'")
    v = q.value
    assert v("GET c:'a'") == 1 and v("GET c:'b'") == {"x": [1]} and v("GET c:'zz'") is None and v("INCR c:'a' BY 4") == 5 and v("SET c:'a' = 9 IF = 1") is False and v("SET c:'a' = 9 IF = 5") is True and v("SET c:'a' = 1 IF ABSENT EXPIRE 30s") is False
    assert v("KEYS FROM c") == [7, "a", "b"] and v("KEYS FROM c PREFIX 'b'") == ["b"] and v("KEYS FROM c AFTER 'a' LIMIT 1") == ["b"] and v("DEL c:'b' IF = 3") is False and v("DEL c:'b'") is True and v("RETURN (GET c:'a') + 1") == 10
    assert v("SET c:'t' = 1 EXPIRE 1h") is True and 3_500_000_000 < v("TTL c:'t'") <= 3_600_000_000 and v("PERSIST c:'t'") is True and v("TTL c:'t'") is None and v("EXPIRE c:'t' -1s") is True and v("GET c:'t'") is None
    assert v("LIST PUSH c:'l' BACK 1, 2, 3") == 3 and v("LIST PUSH c:'l' FRONT 0") == 4 and v("LIST POP c:'l' BACK") == 3 and v("LIST INSERT c:'l' 9 BEFORE 1") == 4 and v("LIST REMOVE c:'l' 9") == 1 and v("GET c:'l'") == [0, 1, 2]
    assert v("LIST TRIM c:'l' FROM 1 TO -1") == 2 and v("LIST MOVE c:'l' FRONT TO c:'m' BACK") == 1 and v("GET c:'m'") == [1]
    assert v("HASH SET c:'h' 'x' = 1, 'y' = 2") == 2 and v("HASH INCR c:'h' 'x' BY 2") == 3 and v("HASH EXPIRE c:'h' 'x', 'q' AT 1h") == [1, -2] and v("HASH TTL c:'h' 'y', 'q'") == [-1, -2] and v("HASH PERSIST c:'h' 'x'") == [1] and v("HASH REMOVE c:'h' 'x', 'y'") == 2
    assert v("MEMBERS ADD c:'s' 'b', 'a', 'a'") == 2 and v("MEMBERS REMOVE c:'s' 'b'") == 1 and v("MEMBERS MOVE c:'s' 'a' TO c:'s2'") is True and v("MEMBERS POP c:'s2'") == "a"
    assert v("SCORES ADD c:'r' 'a' = 1, 'b' = 2, 'c' = 3") == 3 and v("SCORES INCR c:'r' 'a' BY 9") == 10.0 and v("SCORES REMOVE c:'r' SCORE FROM 2 EXCLUSIVE TO NONE") == 2 and v("SCORES POP c:'r' LOWEST") == [["b", 2.0]]
    q.ok("DEFINE SPACE small MAX 1; SET small:'x' = 1")
    q.refused("SET small:'y' = 1", "SpaceFull")
    q.refused("LIST PUSH c:'a' BACK 1", "WrongStructure")
    q.ok("DEFINE BUCKET f MAX 8; PUT f:'/a.bin' = 0x010203; PUT f:'/a.bin' START 1 = 0xff")
    assert v("READ f:'/a.bin'") == b"\x01\xff\x03" and v("READ f:'/a.bin' START 1 LIMIT 1") == b"\xff"
    q.refused("PUT f:'/b' = 'too long for it'", "FileTooLarge")


def test_names_and_another_session(spark, tmp_path):
    root = str(tmp_path / "store")
    a = Session(spark, root)
    a.run("DEFINE NAMESPACE prod; USE NAMESPACE prod; DEFINE DATABASE shop; USE DATABASE shop; DEFINE COLLECTION x; CREATE x:1 = { v: 1 }; DEFINE VIEW y AS SELECT * FROM x;")
    b = Session(spark, root)
    assert b.run("USE NAMESPACE prod DATABASE shop; SELECT * FROM y")[-1].rows() == [{"id": 1, "v": 1}]
    for text, kind in (("USE NAMESPACE ghost", "Unknown"), ("DEFINE NAMESPACE prod", "NameTaken"), ("DROP DATABASE shop", "NotEmpty"), ("DEFINE COLLECTION x", "NameTaken"), ("CREATE y:1 = { v: 1 }", "AView")):
        with pytest.raises(Refused, match=kind):
            b.run(text)
    b.run("DEFINE COLLECTION IF NOT EXISTS x; DROP VIEW y; DROP TABLE x; DROP DATABASE shop; DROP NAMESPACE prod")


def test_vectors_and_geo(q):
    q.ok("DEFINE VECTOR v DIMENSION 2 DISTANCE cosine; INSERT INTO v (id, vector) VALUES (1, [1, 0]), (2, [0, 1]), (3, [1, 1]); DEFINE GEO g; CREATE g:1 = { geometry: geometry { type: 'Point', coordinates: [2.35, 48.85] } };")
    assert [r["id"] for r in q.rows("SELECT id FROM v ORDER BY vector::cosine(vector, [1, 0.1]) LIMIT 2 APPROXIMATE EFFORT 50")] == [1, 3]
    q.refused("CREATE v:4 = { vector: [1, 2, 3] }", "WrongDimension")
    q.refused("CREATE g:2 = { name: 'nowhere' }", "MissingRequiredField")
    q.refused("DEFINE VECTOR w DIMENSION 3 DISTANCE manhattan", "NoSuchDistance")
    q.refused("CREATE g:2 = { geometry: geometry { type: 'Point', coordinates: [200, 0] } }", "NoShape")
    assert len(q.rows("SELECT * FROM g WHERE geo::distance(geometry, geometry { type: 'Point', coordinates: [2.0, 48.0] }) < 200000")) == 1
