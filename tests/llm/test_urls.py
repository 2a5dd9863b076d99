from __future__ import annotations

import random
import re

from compare import duck, run
from conftest_llm import DATA

from tapeline.llm import urls
from tapeline.llm.common import ORACLES


def by_hand(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_query(spark):
    ok, message, n = run(spark, duck(DATA), "op9", urls._op9, ORACLES["op9_url_filters"], DATA)
    assert ok and n, message


def test_odd_urls(frame):
    rules = [*urls.RULES, ("a.b.c", "/x", "block"), ("b.c", "", "allow"), ("b.c", "/x/yy", "allow"), ("c", "/x/y", "block"), ("dup", "/", "block"), ("dup", "/", "allow")]
    rng = random.Random(2)
    made = ["".join(rng.choice(["a", "b", "c", ".", "/", "x", "y", "?", "#", "://", "com", "net", "EN"]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    made += ["http://" + h + p for h in ("a.b.c", "x.a.b.c", "b.c", "ab.c", "C", "c.", ".c", "dup", "q.dup", "WWW.Example.COM", "net", "x.net") for p in ("", "/", "/x", "/x/y", "/x/yy", "/en/", "/fr/a?b=/c#d", "//x", "/x\n/y")]
    made += [None, "", "://", "no scheme", "a://b://c/x", "http://" + "a." * 300 + "com/" + "d/" * 300, "http://ünï.com/é/"] * 2
    pages = [(i, u, 7) for i, u in enumerate(made)] + [(None, "http://x.com/", None)]
    df = frame(pages, "page_id long, url string, host int")
    got = sorted((tuple(r) for r in urls.judge(df, frame(rules, "host string, path string, verdict string")).collect()), key=str)
    assert got == sorted(((i, *by_hand(u, rules)) for i, u, _ in pages), key=str)


def test_empty(frame):
    pages, rules = frame([], "page_id long, url string"), frame([], "host string, path string, verdict string")
    assert urls.judge(pages, rules).collect() == []
    assert [tuple(r) for r in urls.judge(frame([(1, "http://a.b/c")], "page_id long, url string"), rules).collect()] == [(1, "a.b", "/c", None, "allow")]


def test_plan_is_native(spark):
    assert not re.search("Python|Pandas|Arrow", urls._op9(spark, DATA)._jdf.queryExecution().toString())
