"""The URL filter against a plain version of the method, on the whole table and on awkward urls."""

import math
import re
from collections import Counter, defaultdict

from tessera.llm import registry, urlfilter
from tests.llm.helpers import SF


def parse(url):
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [(len(r), r, v) for r, v in urlfilter.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits)[1:] if fits else (None, None)


def typed(s):
    if re.fullmatch(r"[0-9]+(\.[A-Za-z0-9]{1,5})?", s):
        return re.sub("^[0-9]+", "{n}", s)
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}(-[0-9]{2})?", s):
        return "{d}"
    return "{h}" if re.fullmatch("[0-9A-Fa-f-]{8,}", s) and re.search("[0-9]", s) else s


def brute(rows):
    """Sorted (page_id, host, path, rule, verdict, template)."""
    urls = []
    for i, url in rows:
        host, path = parse(url)
        shape = [typed(s) for s in path.split("/") if s]
        shape = tuple(shape[: urlfilter.DEPTH] + ["/".join(shape[urlfilter.DEPTH :])] * (len(shape) > urlfilter.DEPTH))
        urls.append((i, host, path, *rule_of(host, path), shape))
    n = Counter((u[1], u[5]) for u in urls)
    done = {k: () for k in n}
    for depth in range(max((len(s) for _, s in n), default=0)):
        below = defaultdict(Counter)
        for (host, shape), count in n.items():
            if len(shape) > depth and not shape[depth].startswith("{"):
                below[host, done[host, shape]][shape[depth]] += count
        varies = {k for k, c in below.items() if len(c) > urlfilter.FEW and sum(c.values()) < len(c) * urlfilter.REPEATS}
        for host, shape in n:
            if len(shape) > depth:
                here = shape[depth]
                wild = (host, done[host, shape]) in varies and not here.startswith("{")
                done[host, shape] += ("{*}" if wild else here,)
    counts = defaultdict(lambda: [0, 0])  # blocked, labelled
    for _, host, _, rule, verdict, shape in urls:
        c = counts[host, done[host, shape]]
        c[0] += verdict == "block"
        c[1] += rule is not None

    def pooled(key):
        out = defaultdict(lambda: [0, 0])
        for k, (b, m) in counts.items():
            out[key(*k)][0] += b
            out[key(*k)][1] += m
        return out

    def differs(small, big):
        (b1, n1), (b2, n2) = small, big
        if not n1 or n1 == n2:
            return False
        p = b2 / n2
        spread = math.sqrt(p * (1 - p) * (1 / n1 + 1 / (n2 - n1)))
        return spread > 0 and abs(b1 / n1 - (b2 - b1) / (n2 - n1)) / spread >= urlfilter.Z

    smooth = lambda c, prior: (c[0] + urlfilter.PRIOR * prior) / (c[1] + urlfilter.PRIOR)
    domain = lambda h: ".".join(h.split(".")[-2:])
    keys = [lambda h, t: t, lambda h, t: (domain(h), t), lambda h, t: (h, t[:-1] if t else None), lambda h, t: 0]
    wide, mid, near, whole = map(pooled, keys)
    p0 = whole[0][0] / whole[0][1] if whole[0][1] else 0.0
    purity = {}
    for (h, t), own in counts.items():
        g, d, s = (x[k(h, t)] for x, k in zip((wide, mid, near), keys, strict=False))
        p = smooth(g, p0)
        p = smooth(d, p) if differs(d, g) else p
        if differs(own, d):
            p = smooth(own, p) if differs(own, s) else smooth(s, p)
        purity[h, t] = p
    out = []
    for i, host, path, rule, verdict, shape in urls:
        t = done[host, shape]
        out.append((i, host, path, rule, verdict or ("block" if purity[host, t] > urlfilter.REJECT else "allow"), "/" + "/".join(t)))
    return sorted(out, key=repr)


def run(df):
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["template"]) for r in df.collect()), key=repr)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r["page_id"], r["url"]) for r in pages.select("page_id", "url").collect()]
    assert run(registry.queries()["op2_urlfilter"](spark, SF)) == brute(rows)


def test_hot_host_deep_paths_ties_and_extra_columns(spark):
    rows = [(i, f"http://hot.example.org/{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{i}/list/{i}") for i in range(300)]
    rows += [(1000 + i, "http://deep.org/" + "/".join(f"s{k}" for k in range(20)) + f"/{'xyz'[i % 3]}{i}") for i in range(12)]
    rows += [(2000 + i, f"http://a{i % 5}.site.net/{['es', 'fr', 'de', 'en'][i % 4]}/{i}") for i in range(80)]
    rows += [(3000 + i, f"http://b.com/{['es', 'it'][i % 2]}/{i}") for i in range(20)]
    rows += [(4000, None), (4000, None), (4001, ""), (None, "http://x.net/es/1"), (4002, "http://com"), (4003, "http://x.net//es/2"), (4004, "x" * 100_000), (4005, "http://long.org/" + "y" * 100_000)]
    names = ["host", "path", "shape", "template", "parent", "rule", "n", "done"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "page_id bigint, url string, " + ", ".join(f"{c} int" for c in names))
    assert run(urlfilter.judge(df)) == brute(rows)
