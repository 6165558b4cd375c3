"""Registered queries of the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode, encode, ids_digest
from .common import prepare, read_table
from .embeddings import embedding_groups
from .exactdedup import exact_dedup
from .fertility import quality_rules
from .packing import pack, token_pieces
from .periodic import find_runs
from .prefixtrie import numbered_turns, prefix_trie
from .quality import quality_scores
from .secrets import BASE_RULES, RULES, find_secrets, span_text
from .simhash import simhash_groups
from .substrings import remove_repeats
from .urlfilter import judge_urls
from .warc import archive_pages

REGISTRY = {}
SQL: dict[str, str] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winner and size of each document's group of equal texts."""
    out = exact_dedup(read_table(prepare(spark), sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL["op8_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their round trip, as digests."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = read_table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs, path, pattern), path, pattern)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        ids_digest("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_groups(read_table(prepare(spark), sf_dir, "documents"), shingle=3, radius=2)


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    prepare(spark)
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of documents with their places; ids as their CRC-32."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces)


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed."""
    return packed(read_table(prepare(spark), sf_dir, "documents"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, base spans as a digest, all spans."""
    found = find_secrets(read_table(prepare(spark), sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_RULES))

    def n_spans(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [n_spans(r.kind) for r in BASE_RULES]
    return found.select(
        F.col("__id").alias("doc_id"), *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )


def _secret_sql() -> str:
    quoted = [(n, r, r.regex.replace("'", "''")) for n, r in enumerate(RULES)]
    found = " UNION ALL ".join(
        f"""SELECT rid, {n} AS ord, '{r.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, g, gaps FROM (
              SELECT rid, regexp_extract_all(t, '{x}') AS m, regexp_extract_all(t, '{x}', {r.group}) AS g, string_split_regex(t, '{x}') AS gaps FROM d)"""
        for n, r, x in quoted
    )
    least = " ".join(f"WHEN {n} THEN {r.least}" for n, r, _ in quoted)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    named = "kind || ':' || a || ':' || (a + length(m[i]))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
s AS (SELECT *, length(list_aggregate(gaps[1:i], 'string_agg', '')) + coalesce(length(list_aggregate(m[1:i - 1], 'string_agg', '')), 0) AS a
      FROM f WHERE length(g[i]) >= CASE ord {least} END),
p AS (SELECT rid, {counts}, string_agg({named}, ',' ORDER BY a, ord) FILTER (ord < {len(BASE_RULES)}) AS base,
      string_agg({named}, ',' ORDER BY a, ord) AS spans FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN p USING (rid)"""


SQL["op9_secrets"] = _secret_sql()


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over ``documents``."""
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


@query
def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_groups(read_table(prepare(spark), sf_dir, "embeddings"))


# the rules of the contract: host, path, verdict
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    pages = read_table(prepare(spark), sf_dir, "pages")
    return judge_urls(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


SQL["op3_url_filter"] = rf"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r(h, q, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
b AS (
  SELECT rid, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY rid
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (rid)
"""


@query
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeated 35-word windows remove from every document."""
    out = remove_repeats(read_table(prepare(spark), sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives."""
    return archive_pages(read_table(prepare(spark), sf_dir, "pages"), least=0)


@query
def op12_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document: base counts and verdict, tokenizer fertility."""
    docs = read_table(prepare(spark), sf_dir, "documents")
    return quality_rules(docs, public_tokenizers.path("piece_bpe_32k.model"))


def planted_words(doc_id, words: list) -> list:
    """The contract's words: those of one document in ten turn periodic from some word on. A
    document without an id stays as it is."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document: number, longest one, all of them and the words left as digests."""
    out = find_runs(read_table(prepare(spark), sf_dir, "documents"), words=planted_words)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("__l"), F.array_join(lines, "").alias("__runs"), "kept")
    return out.select(
        "doc_id",
        "n_runs",
        (-F.col("__l.s")).alias("start"),
        F.col("__l.length").alias("length"),
        (-F.col("__l.p")).alias("period"),
        F.expr("(1000 * __l.length) div -__l.p").alias("exponent_milli"),
        F.sha2("__runs", 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: (turns, members). Conversation c takes the first h turns of
    conversation c - c % 5, then its own after its first h."""
    turns = numbered_turns(conversations)
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(9))
    members = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv")).distinct()
    heads = turns.where("conv % 5 = 0 AND pos < 8").select(F.col("conv").alias("base"), "pos", "digest", "bytes")
    takes = members.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % 5).alias("base"))
    front = heads.join(takes, "base").where("pos < h").select("conv", "pos", "digest", "bytes")
    # only members whose base is shorter than h need its length: their own turns follow earlier
    found = heads.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    short = takes.join(found, "base", "left").select("conv", F.coalesce("n", F.lit(0)).alias("n"), "h").where("n < h").select("conv", "n")
    own = turns.where(F.col("pos") >= h).join(short, "conv", "left")
    tail = own.select("conv", (F.col("pos") - h + F.coalesce("n", h)).alias("pos"), "digest", "bytes")
    return front.unionByName(tail), members


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie(*rebuilt_turns(read_table(prepare(spark), sf_dir, "conversations")))


SQL["op11_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id AS c, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS b, turn FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) - 1 AS p FROM t
), m AS (
  SELECT c, xor(list_reduce(list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint),
                            lambda a, x: list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(a, x)), 4294967295::bigint), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM o)
), r AS (
  SELECT m.c, 0 AS part, o.p, o.d, o.b FROM m JOIN o ON o.c = m.c - m.c % 5 AND o.p < m.h
  UNION ALL SELECT m.c, 1, o.p, o.d, o.b FROM m JOIN o ON o.c = m.c AND o.p >= m.h
), l AS (
  SELECT m.c, coalesce(list(r.d ORDER BY part, p) FILTER (r.d IS NOT NULL), []) AS ds, coalesce(list(r.b ORDER BY part, p) FILTER (r.b IS NOT NULL), []) AS bs FROM m LEFT JOIN r ON r.c = m.c GROUP BY m.c
), x AS (
  SELECT c, len(ds) AS n, unnest(range(len(ds) + 1)) AS depth, ds, bs FROM l
), y AS (
  SELECT c, n, depth, array_to_string(ds[1:depth], '') AS k, array_to_string(ds[1:depth - 1], '') AS pk, CASE WHEN depth > 0 THEN bs[depth] ELSE 0 END AS b FROM x
), g AS (
  SELECT k, any_value(CASE WHEN depth > 0 THEN pk END) AS pk, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
         sha256(coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256
  FROM y GROUP BY k
), ch AS (
  SELECT pk AS k, count(*) AS n FROM g WHERE depth > 0 GROUP BY pk
), a AS (
  SELECT substr(g.k, 1, 32 * q) AS k, sum(CASE WHEN ch.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((g.n_convs - 1) * g.b) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS q FROM g) g LEFT JOIN ch ON ch.k = g.k GROUP BY 1
)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, coalesce(ch.n, 0) AS n_children,
       a.n_leaves::bigint AS n_leaves, a.saved_tokens::bigint AS saved_tokens, g.ends_sha256
FROM g JOIN a ON a.k = g.k LEFT JOIN ch ON ch.k = g.k LEFT JOIN g p ON p.k = g.pk AND g.depth > 0
"""
