"""The path-template tree against a version by plain loops, and what it learns from labels alone."""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import urls


def by_loops(rows):
    """(purity by url) of (url, host, path, rule, verdict of the rule) rows."""
    word = re.compile("|".join(urls.SEEDS))
    general = lambda s: "*" if re.search("[0-9]", s) or len(s) > 24 else s
    pages = []
    for url, host, path, rule, verdict in rows:
        whole = rule is not None and rule.count("/") == 1 and rule.endswith("/")
        by_host = "block" if word.search(host) else None
        by_path = (None if whole else verdict) or ("block" if word.search(path) else None)
        pages.append((url, host, tuple(general(s) for s in path.split("/") if s), by_host, by_path, rule))
    places = defaultdict(Counter)
    for _, host, seg, *_ in pages:
        for i in range(len(seg)):
            places[host, seg[:i]][seg[i]] += 1
    wild = {k for k, c in places.items() if len(c) >= urls.MIN_CHILDREN and sum(c.values()) / len(c) < urls.PAGES_A_CHILD}
    template = lambda host, seg: tuple("*" if (host, seg[:i]) in wild else s for i, s in enumerate(seg))
    pages = [(url, host, template(host, seg), h, p, rule) for url, host, seg, h, p, rule in pages]

    nodes, leaves, hosts = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0, 0]), defaultdict(int)
    for _, host, t, h, p, _ in pages:
        hosts[host] += h == "block"
        for at in [leaves[host, t], *(nodes[host, t[:i]] for i in range(len(t) + 1))]:
            at[0] += 1
            at[1] += p == "block"
            at[2] += p == "allow"
    branch, of = defaultdict(lambda: [0, 0, 0]), {}
    for (host, node), (n, b, a) in nodes.items():
        if not node:
            continue
        _, pb, pa = nodes[host, node[:-1]]
        rate = pb / max(pb + pa, 1)
        alike = b + a and abs(b / (b + a) - rate) <= urls.Z * np.sqrt(max(rate * (1 - rate), 0.05) / (b + a))
        of[host, node] = (host, node[:-1], "*" if alike else "own " + node[-1])
        for i, v in enumerate((n, b, a)):
            branch[of[host, node]][i] += v
    votes = defaultdict(dict)
    for (host, t), (n, b, a) in leaves.items():
        if b + a:
            votes[t][host] = b / (b + a + urls.FAINT * (n - b - a))
    free = [p for p in pages if p[5] is None]
    share = min(0.5, sum((h or p) == "block" for _, _, _, h, p, _ in free) / max(len(free), 1))
    out = {}
    for url, host, t, _, p, _ in pages:
        others = [v for h, v in votes[t].items() if h != host]
        x = (sum(others) + urls.ALPHA * share) / (len(others) + urls.ALPHA)
        x, met = (hosts[host] + urls.ALPHA * x) / (hosts[host] + urls.ALPHA), False
        for i in range(1, len(t) + 1):
            n, b, a = branch[of[host, t[:i]]]
            n, b, a = n - (p is not None), b - (p == "block"), a - (p == "allow")
            met |= a + b > 0
            if met:
                x = (b + urls.ALPHA * x) / (b + a + urls.FAINT * (n - b - a) + urls.ALPHA)
        out[url] = x if host else None
    return out


def test_tree_against_loops(spark):
    rng = np.random.default_rng(5)
    hosts = ["a.com", "www.example.com", "b.org", "c.example.net", "bets.com", "d.org", "x.de"]
    words = ["en", "de", "fr", "news", "viagra", "item", "7", "spam-list"]
    rare = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(4)]
    made = {f"http://{rng.choice(hosts, p=[0.4, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1])}/" + "/".join(rng.choice(words, rng.integers(0, 4))) + (f"/{rng.choice(rare)}" if rng.random() < 0.3 else "") + f"?q={i}" for i in range(900)}
    made |= {"none", "x://", "http:///en/7", "http://a.com//en//7", "http://long.com/" + "/".join("ab" for _ in range(300))}
    made = sorted(made)
    got = urls.judge(spark.createDataFrame(list(enumerate(made)), "page_id long, url string")).collect()
    verdict = {f"{h}{p}": v for v, h, p in urls.RULES}
    want = by_loops([(made[r.page_id], r.host, r.path, r.rule, verdict.get(r.rule)) for r in got])
    for r in got:
        u = made[r.page_id]
        assert (r.purity is None) == (want[u] is None) and (r.purity is None or abs(r.purity - want[u]) < 1e-6), (u, r.purity, want[u])
        assert r.verdict == (verdict[r.rule] if r.rule else "block" if (want[u] or 0) >= urls.PURITY else "allow")
    free = [r for r in got if not r.rule]
    word = re.compile("|".join(urls.SEEDS))
    assert any(r.verdict == "block" and not word.search(r.host + r.path) for r in free)
    assert any(r.verdict == "allow" and word.search(r.path) for r in free)


def test_labels_decide(spark):
    """A template without any word is rejected where rules block its like on other hosts; a word in a clean branch is let off; one large host has one vote."""
    made = [f"http://h{i}.example.com/de/{k}" for i in range(6) for k in range(4)] + [f"http://h{i}.org/fr/{k}" for i in range(6) for k in range(4)]
    asked = {"http://new.org/de/1": "block", "http://new.com/fr/1": "allow", "http://new.org/es/1": "allow"}
    clean = [f"http://wiki.org/fr/{w}" for w in ("spam", "eggs", "ham", "tea")]
    tags = [f"http://forum.com/tag/{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)] + ["http://forum.com/tag/casino"]
    large = [f"http://big.com/zz/viagra/{i}" for i in range(500)] + [f"http://s{i}.org/fr/viagra/{k}" for i in range(5) for k in range(2)] + ["http://q.com/fr/viagra/1"]
    every = made + list(asked) + clean + tags + large
    d = spark.createDataFrame(list(enumerate(every)), "page_id long, url string")
    got = {every[r.page_id]: r.verdict for r in urls.judge(d).collect()}
    assert {u: got[u] for u in asked} == asked
    assert {got[u] for u in clean + tags} == {"allow"} and got["http://q.com/fr/viagra/1"] == "allow" and got["http://big.com/zz/viagra/3"] == "block"


def test_held_out_labels(spark):
    """Pages that give no label are judged as the rules that they are kept from."""
    made = [f"http://h{i % 9}.example.com/{lang}/{i}" for i in range(400) for lang in ("de", "es")] + [f"http://g{i % 7}.org/{lang}/{i}" for i in range(400) for lang in ("fr", "es")]
    d = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    held = F.pmod(F.crc32(F.col("page_id").cast("string")), F.lit(5)) == 0
    own = [r for r in urls.judge(d, learn=~held).join(d.filter(held).select("page_id"), "page_id").collect()]
    assert len(own) > 200 and all((r.purity >= urls.PURITY) == (r.rule == "example.com/de/") for r in own)
