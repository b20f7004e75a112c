import random
import re
from collections import defaultdict

import numpy as np

from nextdist.llm import urlfilter as U


def page(i, url, links=()):
    return (i, url, "".join(f'<p><a class="x" href="{x}">t</a>' for x in links), "mine")


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_rules_and_parts(spark):
    urls = ["http://A.net/x", "https://www.EXAMPLE.net/en/1?a", "http://example.net/fr", "http://x.example.com/de/", "http://example.com/d", "http://a.org/fr/?x", "http://a.org/fr",
            "http://net", "net/", None, "", "x://y.net?z#w", "http://notexample.net/en/", "://B.Org/fr/a#b", "http://ÀA.net/", "http://a.com\n/x"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.url_filter(frame(spark, [page(i, u) for i, u in enumerate(urls)])).collect()}
    want = [("a.net", "/x", "net/", "block"), ("www.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/fr", "net/", "block"), ("x.example.com", "/de/", "example.com/de/", "block"),
            ("example.com", "/d", None, "allow"), ("a.org", "/fr/", "org/fr/", "allow"), ("a.org", "/fr", None, "allow"), ("net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
            ("y.net", "", None, "allow"), ("notexample.net", "/en/", "net/", "block"), ("b.org", "/fr/a", "org/fr/", "allow"), ("Àa.net", "/", "net/", "block"), ("a.com\n", "/x", None, "allow")]
    assert [got[i] for i in range(len(urls))] == want


def brute_scores(rows, said):
    """Personalised PageRank by matrices; mass of hosts without a way on goes back to the seeds."""
    hosts = defaultdict(list)
    for h, s in said:
        hosts[h].append(s)
    links = defaultdict(int)
    for (_, _, html, _), (h, _) in zip(rows, said, strict=True):
        for x in re.findall(r'href="((?:https?:)?//[^/"]+)', html or ""):
            d = x.split("//")[1].lower()
            if d != h and h:
                links[h, d] += 1
    every = sorted(set(hosts) | {x for k in links for x in k})
    n = np.zeros((len(every), len(every)))
    for (a, b), k in links.items():
        n[every.index(a), every.index(b)] += k
    out = {}
    for name, kind, m in (("trust", "allow", n.T), ("distrust", "block", n)):
        seed = np.array([hosts[h].count(kind) / len(hosts[h]) if hosts[h] else 0 for h in every])
        way = m.sum(0)
        step = np.divide(m, way, out=np.zeros_like(m), where=way > 0)
        x = seed.copy()
        for _ in range(3000):
            x = 0.15 * seed + 0.85 * (step @ x + (x[way == 0].sum() * seed / seed.sum() if seed.sum() else 0))
        out[name] = dict(zip(every, x, strict=True))
    return out


def test_propagation_matches_numpy_pagerank_and_blocks(spark):
    rows = [page(1, "http://spam.net/a"), page(2, "http://farm.com/x", ["http://spam.net/a"] * 3 + ["http://hub.com/"]), page(3, "http://hub.com/y", ["//farm.com/x", "https://good.org/z"]),
            page(4, "http://good.org/fr/a", ["http://friend.com/p"]), page(5, "http://friend.com/p", ["http://good.org/", "/local"]), page(6, "http://lonely.com/"), page(7, "http://farm.com/y"), page(7, "http://farm.com/y")]
    rng = random.Random(3)
    names = [f"h{i}.{rng.choice(['com', 'net', 'org'])}" for i in range(40)]
    rows += [page(100 + i, f"http://{rng.choice(names)}/{rng.choice(['fr', 'de', 'x'])}/", [f"http://{rng.choice(names)}/p" for _ in range(rng.randint(0, 4))]) for i in range(150)]
    rows += [(999, "http://h0.com/", None, "x"), page(998, "http://h1.com/", ["http://long.com/" + "p" * 300_000])]
    df = frame(spark, rows)
    judged = U.judged_by_rules(df)
    said = {r.page_id: (r.host, r._said) for r in judged.collect()}
    got = {r.host: r for r in U.host_scores(judged, tolerance=1e-13).collect()}
    want = brute_scores(rows, [said[r[0]] for r in rows])
    assert set(got) == set(want["trust"])
    for h, r in got.items():
        assert abs(r.trust - want["trust"][h]) < 1e-9 and abs(r.distrust - want["distrust"][h]) < 1e-9
    verdict = {r.host: r.verdict for r in U.url_filter(df).collect() if r.rule is None}
    assert verdict["farm.com"] == "block" and verdict["friend.com"] == verdict["lonely.com"] == "allow"


def test_pages_without_a_rule_go_by_their_host(spark):
    """Where rules block more of a host than they leave unjudged, the rest goes too."""
    mostly = [page(i, f"http://a.example.com/de/{i}") for i in range(6)] + [page(10, "http://a.example.com/x")]
    partly = [page(20, "http://b.example.com/de/"), *[page(21 + i, f"http://b.example.com/{i}") for i in range(3)]]
    verdict = {r.page_id: (r.rule, r.verdict) for r in U.url_filter(frame(spark, mostly + partly)).collect()}
    assert verdict[10] == (None, "block") and verdict[21] == (None, "allow")


def test_distrust_reaches_hosts_more_than_ten_links_away(spark):
    chain = [f"http://h{i}.com/" for i in range(13)] + ["http://spam.net/"]
    rows = [page(i, u, chain[i + 1 : i + 2]) for i, u in enumerate(chain)]
    verdict = {r.host: r.verdict for r in U.url_filter(frame(spark, rows)).collect()}
    assert all(v == "block" for v in verdict.values())


def test_empty_table(spark):
    assert U.url_filter(frame(spark, [])).collect() == []


def test_a_trace_of_distrust_blocks_nobody(spark, monkeypatch):
    """On a chain of links to a blocked host the near ones are blocked; far ones have hardly any distrust, though no trust at all."""
    n = 8
    monkeypatch.setattr(U, "FLOOR", 0.6)  # so that a short chain has a far end
    pages = [(i, f"http://h{i}.com/", f"<a href='http://h{i + 1}.com/'>x</a>") for i in range(n)] + [(n, f"http://h{n}.com/bad/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in U.url_filter(df, [("block", f"h{n}.com", "/bad/")], tolerance=0.2).collect()}
    assert got[n] == got[n - 1] == got[n - 2] == "block" and got[0] == got[1] == "allow"
    first = min(i for i, v in got.items() if v == "block")
    assert all(got[i] == ("allow" if i < first else "block") for i in got)
