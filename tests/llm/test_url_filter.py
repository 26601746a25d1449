import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tarnwell.llm.url_filter import RULES, judge, junk_page, levels

PAGES = [
    (1, "http://A.Example.ORG/es/x?q=1#f", 0), (2, "https://example.org/en/17", 1), (3, "https://example.org/en/2", 0), (4, "ftp://shop.example.com/fr/", 1), (5, "http://example.com/de/9#x/fr/", 0),
    (6, None, None), (7, "no scheme", 1), (8, "http://xorg/es/", 0), (9, "http://b.net", None), (10, "http://b.net/a?b://c/d", 0), (10, "http://b.net/a?b://c/d", 0), (None, "http://c.net/ü/ß", 0), (11, "://only/p", 1),
    (12, "http://a.co.uk:80/x", 1), (13, "http://org/", 0), (14, "http://example.org", 1), (15, "http://h.net\n/x\ny", 0),
]
PAGES += [(50, "http://10.0.0.1/x", 1), (51, "http://77.9.0.1:8080/", 0), (52, "http://x.co.in/", 1), (53, "http://y.co.in/", 0), (54, "http://a.com:8080/", 1), (55, "http://" + "a" * 3000 + ".net/" + "p/" * 50_000, 0)]
PAGES += [(100 + k, f"http://bad.net/{k}", int(k % 10 != 0)) for k in range(400)] + [(600 + k, f"http://s{k}.good.net/", 0) for k in range(50)]


def plain(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    cut2 = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:cut2]


def posterior(rows):
    """Plain empirical Bayes over (host, bad) rows."""
    n, bad = defaultdict(int), defaultdict(int)
    for h, y in rows:
        n[h] += 1
        bad[h] += y
    bare = {h: re.sub(r":\d*$", "", h) for h in n}
    address = {h: re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", b) is not None for h, b in bare.items()}
    two = {h: ".".join(b.split(".")[-2:]) for h, b in bare.items()}
    dom = {h: b if address[h] else ".".join(b.split(".")[-3:]) if two[h] in ("co.uk", "co.in") else two[h] for h, b in bare.items()}
    suf = {h: "(address)" if address[h] else two[h] if two[h] in ("co.uk", "co.in") else b.split(".")[-1] for h, b in bare.items()}

    def level(items, parent):
        v = {k: max(0.001, min(0.999, parent[k])) for k in items}
        var = {k: v[k] * (1 - v[k]) for k in items}
        room = sum(var[k] * (items[k][0] - 1) for k in items)
        rho = (sum(items[k][0] * (items[k][1] / items[k][0] - v[k]) ** 2 for k in items) - sum(var.values())) / room if room > 0 else 0.5
        s = 1 / max(0.001, min(0.999, rho)) - 1
        return {k: (v[k] * s + items[k][1], (1 - v[k]) * s + items[k][0] - items[k][1]) for k in items}

    def grouped(of):
        out = defaultdict(lambda: [0, 0])
        for h in n:
            out[of[h]][0] += n[h]
            out[of[h]][1] += bad[h]
        return out

    all_mean = (sum(bad.values()) + 0.5) / (sum(n.values()) + 1)
    s = level(g := grouped(suf), {k: all_mean for k in g})
    s = {k: a / (a + b) for k, (a, b) in s.items()}
    d = level(grouped(dom), {dom[h]: s[suf[h]] for h in n})
    d = {k: a / (a + b) for k, (a, b) in d.items()}
    out = {}
    for h, (a, b) in level({h: (n[h], bad[h]) for h in n}, {h: d[dom[h]] for h in n}).items():
        sd = math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        out[h] = (n[h], a / (a + b), max(0.0, a / (a + b) - 2 * sd))
    return out


def test_against_plain(spark):
    df = spark.createDataFrame([(i, u, b, "x") for i, u, b in PAGES], "page_id long, url string, bad int, host string")
    got = judge(df, F.col("bad") == 1).collect()
    want = posterior([(plain(u)[0], b) for _, u, b in PAGES if b is not None])
    assert len(got) == len(PAGES)
    by_key = defaultdict(list)
    for r in got:
        by_key[r.page_id].append(r)
    for i, u, _ in PAGES:
        r = by_key[i][0]
        host, path = plain(u)
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, None)
        assert (r.host, r.path, r.rule) == (host, path, rule[0])
        if host in want:
            assert (r.n_pages, round(r.share, 9), round(r.bound, 9)) == (want[host][0], round(want[host][1], 9), round(want[host][2], 9))
        assert r.verdict == (rule[1] or ("block" if host in want and want[host][2] > 0.5 else "allow"))
    assert by_key[100][0].verdict == "block" and by_key[600][0].verdict == "allow"
    assert judge(df.limit(0), F.col("bad") == 1).count() == 0
    assert {r.verdict for r in judge(df, F.lit(None).cast("boolean")).collect()} == {"allow", "block"}


def test_levels_and_junk(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("x.com",), ("localhost",), ("",), ("10.0.0.1",), ("a.com:8080",), ("q.x.co.in:1",), ("[::1]",)], "h string")
    d, s = levels(F.col("h"))
    assert [tuple(r) for r in df.select(d, s).collect()] == [("b.co.uk", "co.uk"), ("x.com", "com"), ("localhost", "localhost"), ("", ""), ("10.0.0.1", "(address)"), ("a.com", "com"), ("x.co.in", "co.in"), ("[::1]", "(address)")]
    d, s = levels(F.col("h"), ["b.com"])
    assert [tuple(r) for r in spark.createDataFrame([("x.a.b.com",)], "h string").select(d, s).collect()] == [("a.b.com", "b.com")]
    html = spark.createDataFrame([("plain text here",), ("a### b%%% c&amp;&amp;&amp;",), (None,), ("",)], "t string")
    assert [r[0] for r in html.select(junk_page(F.col("t"))).collect()] == [False, True, None, False]
