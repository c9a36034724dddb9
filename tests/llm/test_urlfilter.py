import math
import random
import re

from tessera.llm import urlfilter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    i = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:i], rest[i:]
    j = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return host.encode().lower().decode(), tail[:j]


def rule_of(host, path):
    best = None
    for v, r in urlfilter.RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = (v, r)
    return best


URLS = [
    None, "", "no scheme", "http://", "http://A.NET", "http://A.NET/", "https://x.example.NET/en/1?q", "http://example.net/EN/1", "ftp://net/x", "http://anet/x", "http://example.com/de/9#f",
    "http://www.example.com/de", "http://www.example.com/fr/1", "http://org/fr/", "http://b.org/fr/x/y", "http://b.org/de/x", "http://é.ORG/fr/é", "http://h?x://y/z", "http://h/a\nb?c", "x://y://z/w",
]


def test_rules_and_parsing(spark):
    urls = URLS + [f"http://big.example.com/de/{i}/a" for i in range(40)] + [f"http://big.example.com/fr/{i}" for i in range(40)] * 2
    df = spark.createDataFrame([(i, u, "", "h", "r") for i, u in enumerate(urls)] + [(0, None, "", "", "")], "page_id long, url string, html string, host string, rule string")
    got = urlfilter.filter_urls(df).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = parts(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        best = rule_of(host, path)
        assert r.rule == (best[1] if best else None)
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")


def test_template_tree_learns_what_is_significant(spark):
    rules = [("block", "h.com/ads/x/"), ("allow", "h.com/news/x/")]
    urls = [f"http://h.com/ads/x/{i}" for i in range(30)] + [f"http://h.com/news/x/{i}" for i in range(60)] + ["http://h.com/ads/other", "http://h.com/news/other"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.filter_urls(df, rules).collect()}
    assert got[90].rule is None and got[90].verdict == "block"
    assert got[91].rule is None and got[91].verdict == "allow"
    assert {got[i].template for i in range(30)} == {"h.com/ads/*/*"}


def test_empty(spark):
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_labels_below_the_fourth_segment(spark):
    rules = [("block", "h.com/a/b/c/d/e/ads/x/"), ("allow", "h.com/a/b/c/d/e/news/x/")]
    top = "http://h.com/a/b/c/d/e"
    urls = [f"{top}/ads/x/{i}" for i in range(30)] + [f"{top}/news/x/{i}" for i in range(60)] + [f"{top}/ads/other", f"{top}/news/other/deeper/still/1/2/3"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.filter_urls(df, rules).collect()}
    assert len(got) == len(urls)
    assert got[90].rule is None and got[90].verdict == "block"
    assert got[91].rule is None and got[91].verdict == "allow"


def brute(urls, rules, strength=2.0, prior=0.0, z=1.96, cut=0.5):
    """(verdict, template, purity) of each url, level by level."""
    pages = []
    for i, u in enumerate(urls):
        host, path = parts(u)
        ruled = max(((len(r), v) for v, r in rules if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])), default=None)
        segs = ["*" if re.search(r"^[0-9._-]*[0-9][0-9._-]*$|^[0-9a-fA-F-]{16,}$|[0-9]{5,}", s) else s for s in path.split("/") if s]
        pages.append((i, host, segs, ruled and ruled[1]))
    levels = max(max((len(s) for _, _, s, v in pages if v), default=0), min(max((len(s) for _, _, s, _ in pages), default=0), urlfilter.USUAL))
    node, above, going = [h for _, h, _, _ in pages], [prior] * len(pages), [True] * len(pages)
    for d in range(levels):
        branches = {}
        for i, _, segs, v in pages:
            going[i] = going[i] and len(segs) > d
            if going[i]:
                branches.setdefault(node[i], {}).setdefault(segs[d], []).append((i, v))
        for parent, own in branches.items():
            count = {s: (sum(v is not None for _, v in b), sum(v == "block" for _, v in b)) for s, b in own.items()}
            pl, pb = (sum(c[k] for c in count.values()) for k in (0, 1))
            for s, b in own.items():
                cl, cb = count[s]
                apart = False
                if cl and pl - cl:
                    spread = math.sqrt(pb / pl * (1 - pb / pl) * (1 / cl + 1 / (pl - cl)))
                    apart = spread > 0 and abs(cb / cl - (pb - cb) / (pl - cl)) >= z * spread
                for i, _ in b:
                    node[i] = f"{parent}/{s if apart or not cl else '*'}"
                    if apart:
                        above[i] = (cb + strength * prior) / (cl + strength)
    out = dict(enumerate(zip(node, above, strict=True)))
    sums = {}
    for i, _, _, v in pages:
        l, b = sums.get(out[i][0], (0, 0))
        sums[out[i][0]] = (l + (v is not None), b + (v == "block"))
    result = []
    for i, _, _, v in pages:
        node, above = out[i]
        l, b = sums[node]
        purity = (b + strength * prior) / (l + strength) if l else above
        result.append((i, v or ("block" if purity >= cut else "allow"), node, round(purity, 9)))
    return result


def test_verdicts_against_brute_force(spark):
    r = random.Random(3)
    rules = [("block", "h.com/ads/"), ("allow", "h.com/news/"), ("block", "h.com/mix/a/"), ("allow", "h.com/mix/b/"), ("block", "g.org/x/bad/"), ("allow", "g.org/x/"), ("block", "net/")]
    word = ["ads", "news", "mix", "a", "b", "x", "bad", "y", "z"]
    urls = [None, "", "http://h.com", "http://h.com/" + "very/" * 3000, "http://h.com/" + "w" * 50000]
    urls += [f"http://{r.choice(['h.com', 'g.org', 'www.h.com', 'k.net', 'other.io'])}/" + "/".join(r.choice(word) if r.random() < 0.8 else str(r.randrange(10**6)) for _ in range(r.randrange(1, 5))) for _ in range(600)]
    urls += urls[10:40]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = sorted((x.page_id, x.verdict, x.template, round(x.purity, 9)) for x in urlfilter.filter_urls(df, rules).collect())
    assert got == brute(urls, rules)


def test_a_branch_without_labels_is_no_sibling_of_labelled_ones(spark):
    urls = [f"http://big.example.com/de/{i}/a" for i in range(40)] + ["http://big.example.com/en/1/a"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {x.page_id: x for x in urlfilter.filter_urls(df).collect()}
    assert got[40].verdict == "allow" and got[40].purity == 0.0 and got[0].verdict == "block"
