from helpers import rows

from adlake.llm import url_filter as u


def rules(spark, data=u.RULES):
    return spark.createDataFrame(data, "rule_host string, rule_path string, verdict string")


def judged(spark, data, rule_rows=u.RULES):
    pages = spark.createDataFrame([(i, url, html, "a", "b") for i, url, html in data],
                                  "page_id long, url string, html string, host string, verdict string")
    return {r["page_id"]: r for r in rows(u.judged(pages, rules(spark, rule_rows)))}


def test_hosts_paths_and_rules(spark):
    data = [(1, "http://A.example.NET/en/x?q#f", ""), (2, "https://a.example.net/fr/x", ""), (3, "http://example.com/de/", ""),
            (4, "http://notexample.com/de/", ""), (5, "http://b.org/fr/1", ""), (6, "http://b.org/en/1", None), (7, None, "x"), (8, "no scheme/net/", ""),
            (9, "http://x.net", ""), (10, "http://x.net?a/", ""), (11, "HTTP://ÄB.net/", ""), (12, "x://y://z", ""), (13, "", ""), (14, "http:///p", "")]
    got = judged(spark, data)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(1, 15)] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("a.example.net", "/fr/x", "net/"), ("example.com", "/de/", "example.com/de/"),
        ("notexample.com", "/de/", None), ("b.org", "/fr/1", "org/fr/"), ("b.org", "/en/1", None), ("", "", None), ("", "", None),
        ("x.net", "", None), ("x.net", "", None), ("Äb.net", "/", "net/"), ("y:", "//z", None), ("", "", None), ("", "/p", None)]
    assert got[1]["verdict"] == "allow" and got[2]["verdict"] == "block" and got[7]["verdict"] == "allow"


def test_distrust_goes_against_links_and_trust_along(spark):
    link = '<a href="http://{}/x">'
    data = [(1, "http://bad.net/", ""), (2, "http://farm.org/en/", link.format("bad.net") + link.format("bad.net")),
            (3, "http://good.org/fr/", link.format("friend.org") + '<img src=\'//friend.org/i\'>'), (4, "http://friend.org/x", link.format("bad.net")),
            (5, "http://lone.org/x", ""), (6, "http://blog.farm.org/x", '<a href="/rel">')]
    got = judged(spark, data)
    assert {i: r["verdict"] for i, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}
    assert got[4]["trust"] > 0 and got[4]["distrust"] > 0 and got[2]["trust"] == 0 and got[5]["distrust"] == 0


def test_equals_plain_propagation(spark):
    import random
    rng = random.Random(1)
    edges = sorted({(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}") for _ in range(40)})
    edges = [(a, b) for a, b in edges if a != b]
    seeds = {"h0": (u.SEED, 0), "h3": (u.SEED // 3, u.SEED // 2), "h7": (0, u.SEED)}

    def walk(pairs, start):
        out = {}
        for a, b in pairs:
            out.setdefault(a, []).append(b)
        now = {h: s for h, s in start.items() if s}
        for _ in range(u.ROUNDS):
            new = {h: s * (100 - u.DAMPING) // 100 for h, s in start.items() if s}
            for h, s in now.items():
                for b in out.get(h, ()):
                    new[b] = new.get(b, 0) + s * u.DAMPING // 100 // len(out[h])
            now = new
        return now

    trust = walk(edges, {h: s[0] for h, s in seeds.items()})
    distrust = walk([(b, a) for a, b in edges], {h: s[1] for h, s in seeds.items()})
    got = rows(u.spread(spark.createDataFrame(edges, "src string, dst string"),
                        spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust long, distrust long")))
    assert {r["host"]: (r["trust"], r["distrust"]) for r in got} == {
        h: (trust.get(h, 0), distrust.get(h, 0)) for h in set(trust) | set(distrust)}


def test_empty_and_repeated(spark):
    assert judged(spark, []) == {}
    pages = spark.createDataFrame([(1, "http://x.org/a", "")] * 5, "page_id long, url string, html string")
    assert u.judged(pages, rules(spark)).count() == 5


def test_long_chains_and_cycles_settle(spark):
    chain = [(0, "http://bad.net/", "")] + [
        (i, f"http://h{i}.org/x", f'<a href="http://{"bad.net" if i == 1 else f"h{i - 1}.org"}/">') for i in range(1, 15)]
    got = judged(spark, chain)
    for i, r in got.items():
        assert abs(r["distrust"] - .15 * .85 ** i * u.SEED) < 100, i
    assert [i for i, r in got.items() if r["verdict"] == "block"] == [i for i in got if .15 * .85 ** i >= .05]
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    seed = spark.createDataFrame([("a", u.SEED, 0)], "host string, trust long, distrust long")
    trust = {r["host"]: r["trust"] / u.SEED for r in rows(u.spread(cycle, seed, None))}
    assert abs(trust["a"] - .15 / (1 - .85 ** 2)) < 1e-4 and abs(trust["b"] - .15 * .85 / (1 - .85 ** 2)) < 1e-4
