"""URL rules of any case and with escapes, tokens read off expressions; shards of repeated rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("pliego.llm")

from pliego.llm.sharding import kd_shards, shard_documents
from pliego.llm.urlrules import _LOWER, PATTERN_RULES, SITE_RULES, Rule, host_and_path, judge_urls, literal_tokens, rules_of, site


def all_rules(url, rules):
    """The verdict by running every rule on the url."""
    host, path = host_and_path(url)
    low = url.partition("://")[2].translate(_LOWER)
    sites = [r for r in rules if r.host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if sites:
        return max(sites, key=lambda r: len(r.name)).action
    return next((r.action for r in rules if not r.host and r.pattern().search(low)), "allow") if host or path else "allow"


RULES = rules_of("""
# sites
block example.com/En/
block example.com/caf%C3%A9/
allow Example.com/caf%C3%A9/Bar/x
block ORG/Privé/b
block /wp-login\\.php/
block /\\bfree[-_]gift\\b/
block /[?&]utm_id=7(?:&|$)/
block /x{3}y/
""".splitlines())


def test_rules_of_any_case(spark):
    rng = random.Random(1)
    bits = ["En", "en", "caf%C3%A9", "caf%c3%a9", "Bar", "bar", "x1", "Privé", "b", "wp-login.php", "wp-login.php7", "free-gift", "free_gifts", "xxxy", "xxx"]
    hosts = ["example.com", "www.Example.COM", "a.org", "org", "notexample.com"]
    urls = [f"http://{rng.choice(hosts)}/{'/'.join(rng.choices(bits, k=rng.randrange(4)))}{rng.choice(['', '/', '?utm_id=7', '?a&utm_id=7&b', '?utm_id=71'])}" for _ in range(1500)]
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules=RULES).collect()
    want = [all_rules(u, RULES) for u in urls]
    assert [r.verdict for r in sorted(got, key=lambda r: r.page_id)] == want and Counter(want)["block"] > 300
    for url in ("http://example.com/En/a", "http://x.example.com/caf%C3%A9/"):
        assert judge_urls(spark.createDataFrame([(1, url)], "page_id int, url string"), rules=(site("block", "example.com/En/"), site("block", "example.com/caf%C3%A9/"))).first().verdict == "block"


def test_tokens_read_off_expressions():
    assert literal_tokens(r"\bfoo-bar\b") == ["foo", "bar"] and literal_tokens(r"^ads\.") == ["ads"]
    assert literal_tokens("foo") == literal_tokens("foo|bar") == literal_tokens(r"/foo?/") == literal_tokens(r"\Bfoo/") == literal_tokens(r"(?i)Foo/") == []
    assert literal_tokens(r"/(?:a|b)foo/x/") == ["x"] and literal_tokens(r"\.exe(?:[?#]|$)") == ["exe"] and literal_tokens(r"\.exe(?:[?#a]|$)") == []
    assert all(r.tokens() for r in (*SITE_RULES, *PATTERN_RULES))
    with pytest.raises(ValueError, match="Not a rule"):
        rules_of(["drop com/"])
    assert rules_of(["block /ads/"]) == (Rule("block", regex="ads"),)


@pytest.mark.parametrize("ordinary, repeated", [(3000, 1500), (300, 4000)])
def test_shards_of_repeated_rows(spark, ordinary, repeated):
    """Half of the rows and more are one row: bytes within 1 % of the mean and one document."""
    rows = [(i, f"word{i % 7} " * (1 + i % 29), "en" if i % 3 else "de", "s") for i in range(ordinary)] + [(5, "the same row here " * 5, "en", "s")] * repeated
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
    got = kd_shards(docs, 24).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(t) + 8) for i, t, *_ in rows)
    by = Counter()
    for r in got:
        by[r.shard] += r["size"]
    mean, most = sum(by.values()) / 24, max(r["size"] for r in got)
    assert len(by) == 24 and all(abs(v - mean) <= 0.01 * mean + most for v in by.values())
    slots = Counter((r.shard, r.slot) for r in got)
    assert max(slots.values()) == 1 and all((s, 0) in slots for s in by) and len(slots) == len(rows)
    out = shard_documents(docs, 24)
    assert out.columns == [*docs.columns, "shard"] and out.count() == len(rows)
    assert out.groupBy("shard").count().filter(F.col("count") > len(rows) / 6).isEmpty()
