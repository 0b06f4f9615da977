import math
import re

from gridwright.llm import urls

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def plain(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def corpus():
    found = [None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.net?x=/en/", "https://A.Example.NET/en/1#a", "http://notexample.net/en/", "ftp://x.org/fr/ü?q", "x://y://z/", "http://a.org/fr", "http://a.org//fr/", "http://İ.NET/"]
    for i in range(200):
        found += [f"https://shop{i % 7}.example.net/en/good{i}", f"http://spam{i % 5}.example.com/de/bad{i}.html", f"http://a{i}.org/fr/fine{i}", f"https://b{i}.example.com/en/good{i}", f"http://spam{i}.example.com/xx/bad{i}.html"]
    return list(enumerate(found))


def test_rules_against_brute_force_and_the_rest_by_the_model(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, u, "x") for i, u in [*rows, rows[20], (None, "http://a.net/")]], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert urls.judge(df).count() == len(rows) + 2
    for i, u in rows:
        host, path, rule, verdict = plain(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    free = [(got[i]["verdict"] == "allow") == ("good" in u) for i, u in rows if u and plain(u)[2] is None and ("good" in u or "bad" in u)]
    assert len(free) == 400 and sum(free) > 380
    assert urls.judge(df.limit(0)).count() == 0


def by_hand(rows):
    """The method's scores and threshold of all URLs, counted with dictionaries. The fold is the query's own."""
    from collections import Counter

    grams = lambda u: [("\x02" * urls.ORDER + u + "\x03")[i : i + urls.ORDER + 1] for i in range(len(u) + 1)]
    known = {u: plain(u)[3] for _, u, _ in rows}
    fold = {u: f for _, u, f in rows}
    counts = {"allow": Counter(), "block": Counter()}
    for _, u, _ in rows:
        if known[u] and fold[u] > 0:
            counts[known[u]].update(grams(u or ""))

    def model(count):
        pairs, contexts, kinds = Counter(), Counter(), {}
        for g, n in count.items():
            for k in range(urls.ORDER + 1):
                x, c = g[urls.ORDER - k : urls.ORDER], g[-1]
                pairs[x, c] += n
                contexts[x] += n
                kinds.setdefault(x, set()).add(c)

        def p(g):
            c = g[-1]
            found = (pairs["", c] + 1) / (contexts[""] + urls.ALPHABET)
            for k in range(1, urls.ORDER + 1):
                x = g[urls.ORDER - k : urls.ORDER]
                if contexts[x]:
                    found = (pairs[x, c] + len(kinds[x]) * found) / (contexts[x] + len(kinds[x]))
            return found

        return p

    good, bad = model(counts["allow"]), model(counts["block"])
    score = {u: sum(round(math.log(good(g) / bad(g)), 9) for g in grams(u or "")) / (len(u or "") + 1) for u in known}
    bins = Counter((math.floor(max(-10, min(10, score[u])) / urls.BIN), known[u]) for _, u, _ in rows if known[u] and fold[u] == 0)
    return score, urls.threshold([(b, k, n) for (b, k), n in bins.items()])


def test_query_against_brute_force(spark, tmp_path):
    """Every page's verdict and score, the method's too."""
    from pyspark.sql import functions as F

    from gridwright.llm import queries

    own = [u for _, u in corpus()] + ["http://a.example.com/en/x?buy=spam&bad=1", "http://a.example.com/en/x?page=good", "http://a.example.com/en/x#good", "x" * 5000]
    rows = list(enumerate(own + own[30:60] + ["http://hot.org/fr/"] * 50))
    df = spark.createDataFrame(rows, "page_id long, url string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    folds = {r["page_id"]: r["f"] for r in df.select("page_id", F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(urls.CALIBRATION)).alias("f")).collect()}
    score, limit = by_hand([(i, u, folds[i]) for i, u in rows])
    got = {r["page_id"]: r for r in queries.op8_urls(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    near = 0
    for i, u in rows:
        host, path, rule, verdict = plain(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert math.isclose(got[i]["score"], score[u], abs_tol=1e-7)
        if abs(score[u] - limit) < 1e-6 or limit == float("-inf"):
            near += 1
            continue
        assert got[i]["verdict"] == (verdict or ("allow" if score[u] >= limit else "block"))
    assert near < 5
    assert got[len(own) - 4]["score"] != got[len(own) - 3]["score"]  # they differ behind the path only


def test_smoothing_by_hand(spark):
    counts = spark.createDataFrame([("\x02\x02\x02a", 3), ("\x02\x02ab", 2), ("\x02\x02ac", 1)], "g string, n long")
    got = {r["g"]: r["p"] for r in urls._smoothed(counts.select("g").union(spark.createDataFrame([("\x02\x02ad",)], "g string")), counts, "n").collect()}
    base = lambda n: (n + 1) / (6 + urls.ALPHABET)
    p = {c: base(n) for c, n in (("b", 2), ("c", 1), ("d", 0))}
    for _ in range(urls.ORDER):
        p = {c: (n + 2 * p[c]) / (3 + 2) for c, n in (("b", 2), ("c", 1), ("d", 0))}
    for c, v in p.items():
        assert math.isclose(got["\x02\x02a" + c], v)


def test_threshold():
    assert urls.threshold([(0, "block", 5), (1, "block", 1), (1, "allow", 1), (2, "allow", 9)]) in (urls.BIN, 2 * urls.BIN)
    assert urls.threshold([(0, "block", 5)]) == float("-inf")
