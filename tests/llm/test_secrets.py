import hashlib
import re

from spindle.llm.queries import REGISTRY
from spindle.llm.secrets import RULES, Rule, find_secrets, redacted, trigram_query

KINDS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute(text):
    out = []
    for n, (kind, pat, good) in enumerate(KINDS):
        out += [(m.start(), n, kind, m.end()) for m in pat.finditer(text or "") if good(m)]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


TEXTS = [
    None, "", "password=abcdef", "Token: 'abc' secret=token=abcdefg", "token=token:abcdefgh", "é😀 api_key = \"A1b2C3d4\" x",
    "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIAAKIA" + "B9" * 12, "f" * 23, "f" * 24, "g" + "0a" * 30 + "g", "password=" + "0" * 40,
    "apikey:1234567 APIKEY=7654321 ", "x " * 60000 + "passwd=qwerty12", "password=abcdef", "ghp_" + "Z" * 40, "secret", "toke n=123456",
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i // 2 if i % 5 else None, t, "c") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, spans string")
    rows = find_secrets(df).select("__text", "spans").collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.ord < 3] == brute(r["__text"])
    assert sum(len(r.spans) for r in rows if "ghp_" in r["__text"]) == 2


def test_queries_from_regexes():
    q = {r.kind: trigram_query(r.regex) for r in RULES}
    assert q["hex"] == [] and q["access"] == [[{"aki", "kia"}]]
    assert {"tok", "oke", "ken"} in q["assign"][0] and {"api", "pik", "ike", "key"[:3]} - {"ike"} <= set().union(*q["assign"][0])
    assert len(q["assign"]) == 1 and len(q["assign"][0]) == 6
    assert trigram_query("ab.cd") == [] and trigram_query("abc(de|f)?g+hij") != []


def test_query_and_redaction(spark, sf="/root/testdata/sf0.001"):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = REGISTRY["op9_secrets"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
    df = spark.createDataFrame([(1, "é password=" + "0" * 30 + " end"), (2, "clean")], "doc_id long, text string")
    found = find_secrets(df)
    got = {r["__id"]: r.t for r in found.select("__id", redacted(found["__text"], found["spans"]).alias("t")).collect()}
    assert got == {1: "é <assign> end", 2: "clean"}


def test_empty(spark):
    assert find_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_optional_parts_between_literals(spark):
    rules = [Rule("live", r"sk_?live_[0-9a-z]{24}"), Rule("mid", r"abc(de|f)?ghi"), Rule("cls", r"tok[0-9]?enx"), Rule("many", r"uvw(xy)*zzz")]
    texts = [f"k {a}{'0a' * 12} z" for a in ("sklive_", "sk_live_", "sk__live_")] + ["abcghi", "abcdeghi", "abcfghi", "abcdefghi"]
    texts += ["tokenx", "tok7enx", "uvwzzz", "uvwxyxyzzz", "", None]
    rows = find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules).collect()
    for r in rows:
        want = [(m.start(), n, x.kind, m.end()) for n, x in enumerate(rules) for m in re.finditer(x.regex, r["__text"])]
        assert [tuple(s) for s in r.spans] == sorted(want)
    assert sum(len(r.spans) for r in rows) == 9
