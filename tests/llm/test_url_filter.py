import random

from oracle import compare, connect

from quartier.llm.queries import ORACLE, QUERIES
from quartier.llm.url_filter import judge

PAGES = "page_id long, url string, html string, host int, verdict int"
RULES = "host string, path string, verdict string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def brute(pages, rules):
    out = []
    for i, url in pages:
        host, path = split(url)
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        out.append(tuple(map(str, (i, host, path, best[3], best[4]))))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "net", "-", "É"]) for _ in range(rng.randrange(1, 5)))
    path = lambda: "/" + "/".join(rng.choice(["x", "xy", "y", ""]) for _ in range(rng.randrange(3)))
    pages = [(k, f"http://{host()}{path()}{rng.choice(['', '?q=http://a.b/', '#t'])}") for k in range(400)]
    pages += [(k, "HTTP://A.B.net/x/y") for k in range(1000, 1400)]  # one url holds a third of the rows
    odd = [None, "", "no scheme", "://", "http://", "http://?x", "http://.net/", "http://net./", "http://a..net/x", "http://U@NET:80/x", "x://a://b/c", "http://ｎet/", "http://net", "http://b.net#/x"]
    pages += [(2000 + k, u) for k, u in enumerate(odd)] + [(None, "http://net/"), (1, "http://net/x"), (1, "http://net/x"), (3000, "http://b.net/" + "x" * 9000)]
    rules = list({(host().lower(), path(), rng.choice(["allow", "block"])) for _ in range(60)}) + [("net", "/", "block"), ("net", "/", "allow"), (None, "/", "block"), ("a", None, "allow")]
    rules = [(h.replace("É", "É") if h else h, p, v) for h, p, v in rules]
    rows = spark.createDataFrame([(*p, None, 1, 2) for p in pages], PAGES).repartition(5)
    got = judge(rows, spark.createDataFrame(rules, RULES)).collect()
    assert sorted(tuple(map(str, r)) for r in got) == brute(pages, rules)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a/", None, 1, 1)], PAGES)
    none = spark.createDataFrame([], RULES)
    assert [r.verdict for r in judge(pages, none).collect()] == ["allow"]
    assert judge(pages.limit(0), none).count() == 0


def test_query_equals_sql(spark, sf_dir):
    assert compare(QUERIES["op3_url_filter"](spark, sf_dir), ORACLE["op3_url_filter"], connect(sf_dir)) is None
