import pytest

import spindle.llm.urlfilter as U

URLS = [
    None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?y", "http://example.com/en", "http://example.com/en/", "http://a.b.example.com/en/1#t",
    "http://notexample.com/en/x", "http://x.net/es/1", "http://x.net/fr/", "http://net/es/", "http://x.net?/es/", "ftp://com", "http://com/", "a://b://c.net/es/",
    "http://É.com/Ä", "http://x.com:80/en/", "http://.com/", "http://" + "a." * 3000 + "net/fr/", "http://x.net/es/" + "q" * 50000,
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("group, segment", [(1_000_000, 1 << 23), (30, 64)])
def test_brute_force(spark, monkeypatch, group, segment):
    monkeypatch.setattr(U, "GROUP_KEYS", group)  # also groups of few keys, and filters of several segments
    monkeypatch.setattr(U, "SEGMENT_BITS", segment)
    monkeypatch.setattr(U, "LEAST_HASHES", 2)  # many false positives: several levels
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    rules += [(f"h{i}.org", f"/{i % 7}", "block" if i % 3 else "allow") for i in range(200)]
    urls = URLS + [f"https://s{i % 5}.h{i}.org/{i % 9}/x" for i in range(600)]
    df = spark.createDataFrame([(i // 2, u, "c") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = U.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    want = [(i // 2, *brute(u, rules)) for i, u in enumerate(urls)]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).collect() == []
    one = U.judge_urls(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), rules).collect()
    assert [tuple(r) for r in one] == [(1, "a.b", "/c", None, "allow")]


def test_few_keys_in_a_large_universe(spark):
    """A level's mistakes stay near the number of its keys: eight bits a key, as for a list of any
    size, would pass some hundred of these keys."""
    from pyspark.sql import functions as F

    keys = spark.range(60_000).select(F.concat(F.lit("key"), "id").alias("key")).select(*U._hashes(F.col("key")), F.col("key"))
    listed = keys.where("key in ('key17', 'key4242', 'key59999')")
    levels = U.build_cascade(listed.drop("key"), keys.join(listed, "key", "left_anti").drop("key"))
    import numpy as np

    rows = keys.collect()
    h = np.array([(r.h1, r.h2) for r in rows], np.int64).view(np.uint64)
    assert {r.key for r, m in zip(rows, U.is_member(levels, h)) if m} == {"key17", "key4242", "key59999"}
    assert levels[0].passes(h).sum() <= 3 + 9 and len(levels) <= 4


def test_segments_pass_all_their_keys():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 2**63, (5000, 2)).astype(np.uint64)
    level = U.Bloom(2, len(h), 50_000)
    level.segments, level.seg_bits = 7, 12_800
    parts = level.segment(h)
    level.bits = np.concatenate([np.frombuffer(level.set_segment(h[parts == k]), np.uint8) for k in range(7)])
    assert level.passes(h).all()
    other = np.random.default_rng(2).integers(0, 2**63, (50_000, 2)).astype(np.uint64)
    assert level.passes(other).mean() < 0.1
