"""Secret scans with a trigram inverted index, in DataFrame functions only.

From each rule's regex follows a Boolean query over trigrams that every match must contain: an
AND over literal runs of an OR over the run's alternatives of an AND over trigrams, all in lower
case. The index holds a posting (trigram, document) for each trigram that some rule asks for.
Intersecting the postings by document gives each rule's candidates; only these are verified with
the regex itself. A rule without a mandatory trigram (a bare run of hex digits, say) scans every
text. Spans come from the matches and the gaps between them, in code points.

Edge cases: null text is empty; rows repeated in id and text share their result; rows that share
an id only stay apart; an empty table gives an empty result; columns of the input other than id
and text are left out of ``find_secrets``.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, row_key, staged, text_or_empty


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0  # the part whose length is judged
    least: int = 0  # matches whose part is shorter are dropped


BASE_RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # the same spans as AKIA[A-Z0-9]+ of 20 or more
    Rule("hex", r"[0-9a-f]{24,}"),  # maximal runs, as [0-9a-f]+ of 24 or more
]
MORE_RULES = [
    Rule("github", r"ghp_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]
RULES = BASE_RULES + MORE_RULES
MAX_ALTERNATIVES = 64  # literal alternatives of one run; a richer run asks for nothing


def literal_runs(regex: str) -> list[set[str]]:
    """Literal runs of a regex; a match contains an alternative of every run."""
    runs: list[set[str]] = []

    def walk(tree, open_: set[str]) -> set[str]:
        """Extend the alternatives ``open_`` of the current run; closed runs go to ``runs``."""

        def close(now: set[str]) -> set[str]:
            runs.append(now)
            return {""}

        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                open_ = {s + chr(arg).lower() for s in open_}
            elif name == "SUBPATTERN":
                open_ = walk(arg[-1], open_)
            elif name in ("BRANCH", "MAX_REPEAT"):
                if name == "BRANCH":
                    parts, exact = arg[1], True
                else:
                    low, high, part = arg
                    parts, exact = [part] + [[]] * (low == 0), high == 1  # an optional part is there or not
                options = set()
                for part in parts:
                    found = _exact(part)
                    exact, options = exact and found is not None, options | (found or set())
                if exact and len(open_) * len(options) <= MAX_ALTERNATIVES:
                    open_ = {s + o for s in open_ for o in options}
                else:
                    open_ = close(open_)
            else:  # a class, any character or a look-around
                open_ = close(open_)
        return open_

    runs.append(walk(_parser.parse(regex), {""}))
    return [r for r in runs if all(len(s) >= 3 for s in r)]


def _exact(tree) -> set[str] | None:
    """All strings that a part can match, if it is made of literals and choices only."""
    out = {""}
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            some: set[str] | None = {chr(arg).lower()}
        elif name == "SUBPATTERN":
            some = _exact(arg[-1])
        elif name == "BRANCH":
            parts = [_exact(p) for p in arg[1]]
            some = None if None in parts else set().union(*parts)
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
            some = _exact(arg[2])
            some = None if some is None else some | {""}
        else:
            some = None
        if some is None or len(out) * len(some) > MAX_ALTERNATIVES:
            return None
        out = {a + b for a in out for b in some}
    return out


def trigrams(s: str) -> set[str]:
    return {s[i : i + 3] for i in range(len(s) - 2)}


def trigram_query(regex: str) -> list[list[set[str]]]:
    """AND over runs of OR over alternatives of AND over trigrams; [] means: scan fully."""
    return [[trigrams(s) for s in sorted(run)] for run in literal_runs(regex)]


def postings(docs: DataFrame, rules: list[Rule], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(``__id``, ``__rk``, ``trigram``) for every trigram that a rule asks for."""
    wanted = sorted({t for r in rules for run in trigram_query(r.regex) for alt in run for t in alt})
    low = docs.select(*row_key(id_col, text), F.lower(text_or_empty(text)).alias("__low"))
    has = [F.when(F.col("__low").contains(t), F.lit(t)) for t in wanted] or [F.lit(None).cast("string")]
    return low.select("__id", "__rk", F.explode(F.array_compact(F.array(*has))).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(``__id``, ``__rk``, ``kinds``): the rules whose trigram query each document satisfies."""
    spark = index.sparkSession
    plan, runs = [], []
    for r in rules:
        query = trigram_query(r.regex)
        if query:
            runs.append((r.kind, len(query)))
        for n, run in enumerate(query):
            for m, alt in enumerate(run):
                plan += [(t, r.kind, n, m, len(alt)) for t in sorted(alt)]
    asked = F.broadcast(spark.createDataFrame(plan, "trigram string, kind string, run int, alt int, need int"))  # as long as the rules
    all_runs = F.broadcast(spark.createDataFrame(runs, "kind string, runs int"))
    got = index.join(asked, "trigram").groupBy("__id", "__rk", "kind", "run", "alt", "need").agg(F.count_distinct("trigram").alias("n"))
    met = got.where("n = need").groupBy("__id", "__rk", "kind").agg(F.count_distinct("run").alias("n"))
    return met.join(all_runs, "kind").where("n = runs").groupBy("__id", "__rk").agg(F.collect_set("kind").alias("kinds"))


def spans_of(rule: Rule, order: int, text: Column) -> Column:
    """Spans (start, ord, kind, end) of the leftmost non-overlapping matches, failing ones dropped."""
    pattern = F.lit(rule.regex)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.least else found
    gaps = F.split(text, rule.regex, -1)
    pairs = F.arrays_zip(found.alias("m"), judged.alias("g"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    kind = "array<struct<start:int,ord:int,kind:string,end:int>>"
    empty = F.array().cast(kind)

    def step(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["m"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        more = F.when(F.length(p["g"]) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), more.cast(kind).alias("spans"))

    folded = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.regex), folded).otherwise(empty)


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``__id``, ``__rk``, ``__text`` and ``spans`` (start, ord, kind, end; by start, then rule)
    of every row of ``docs``."""
    prepare(docs.sparkSession)
    index = staged(postings(docs, rules, text, id_col), "postings")
    hits = staged(candidates(index, rules), "candidates")
    discard(index)
    left = docs.select(*row_key(id_col, text), text_or_empty(text).alias("__text"))
    right = hits.select(F.col("__id").alias("__i"), F.col("__rk").alias("__k"), "kinds")
    both = left.join(right, left["__id"].eqNullSafe(right["__i"]) & (left["__rk"] == right["__k"]), "left")
    parts = []
    for order, rule in enumerate(rules):
        found = spans_of(rule, order, F.col("__text"))
        if trigram_query(rule.regex):
            found = F.when(F.array_contains("kinds", rule.kind), found).otherwise(F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>"))
        parts.append(found)
    return both.select("__id", "__rk", "__text", F.array_sort(F.concat(*parts)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones joined) replaced by its kind in angle brackets."""

    def step(acc, s):
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
