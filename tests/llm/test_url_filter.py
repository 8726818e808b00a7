import random
import re

from cosecha.llm import url_filter
from cosecha.llm.url_filter import RULES, digest

CASES = [
    ("http://a.example.com/fr/1?x", "com/fr/", "allow"),
    ("https://B.Example.ORG/es/2", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "org/", "allow"),
    ("http://x.com/de/#top", "com/de/", "block"),
    ("http://notexample.org/es/", "org/", "allow"),
    ("http://x.org", None, None),
    ("http://x.net/fr/", None, None),
    ("no scheme", None, None),
    ("", None, None),
    (None, None, None),
    ("a://b://c/d", None, None),
    ("http://X.com?/fr/", None, None),
]


def split(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")


def test_hosts_paths_rules_and_verdicts(spark):
    rows = [(k, url, "<p>") for k, (url, _, _) in enumerate(CASES)] + [(None, "http://q.com/fr/", None)]
    found = {r["page_id"]: r for r in digest(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    assert len(found) == len(rows)
    for k, (url, rule, verdict) in enumerate(CASES):
        assert (found[k]["host"], found[k]["path"]) == split(url)
        assert found[k]["rule"] == rule
        assert found[k]["verdict"] == verdict or verdict is None and found[k]["verdict"] in ("allow", "block")


def test_the_model_learns_what_the_rules_say(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = digest(pages).collect()
    assert len(found) == pages.count()
    names = {r.name for r in RULES}
    assert all(r["rule"] is None or r["rule"] in names for r in found)
    # Without a rule, French paths look allowed and German ones blocked.
    rate = lambda part: [r["verdict"] == "allow" for r in found if r["rule"] is None and part in r["path"]]
    fr, de = rate("/fr/"), rate("/de/")
    assert not fr or not de or sum(fr) / len(fr) >= sum(de) / len(de)


def test_empty_table(spark):
    assert digest(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_the_model_tells_held_out_urls_apart():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    good = [("docs.example.edu", f"/papers/{word()}/{word()}.html") for _ in range(300)]
    bad = [(f"{word()}.win-cash.biz", f"/casino/{word()}?") for _ in range(300)]
    learn, rest = good[:200] + bad[:200], good[200:] + bad[200:]
    model = url_filter.UrlModel([h for h, _ in learn], [p for _, p in learn], [k < 200 for k in range(400)])
    said = model.score([h for h, _ in rest], [p for _, p in rest]) >= 0.5
    assert (said == [k < 100 for k in range(200)]).mean() > 0.95
