"""Brute force over rules and urls; nulls, ties, repeats, odd characters, empty tables."""
import random
import re

from dossier.llm import urls


def brute(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = {}
    for h, p, v in rules:
        if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p):
            best[(len(h) + len(p), len(h), h, p)] = max(v, best.get((len(h) + len(p), len(h), h, p), ""))
    if not best:
        return host, path, None, default
    k = max(best)
    return host, path, k[2] + k[3], best[k]


def test_brute_force(spark):
    rnd = random.Random(4)
    labels, segs = ["a", "b", "com", "x-y", "", "ä"], ["/", "/a", "/a/", "/a/b", "/é\U0010ffff", "", "/a/b/c", "/%20"]
    hosts = [".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    rules = [(rnd.choice(hosts), rnd.choice(segs), rnd.choice(["allow", "block"])) for _ in range(60)] + [(None, "/", "block"), ("com", None, "block")]
    raw = [None, "", "no scheme", "http://", "://com/a", "http://COM.A/a/b?q#f", "x://a://b/c", "http://com#x", "http://com\n/a"]
    raw += [f"http://{rnd.choice(hosts).upper()}{rnd.choice(segs)}{rnd.choice(['', '?q=1', '#t', 'zz'])}" for _ in range(300)]
    raw += ["http://com/a/b"] * 500
    df = spark.createDataFrame([(i, u, "r", "v", 1, 2) for i, u in enumerate(raw)],
                               "page_id long, url string, rule string, verdict string, _h int, key int")
    rl = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, rl).collect()}
    assert len(got) == len(raw)
    assert all(got[i] == brute(u, rules) for i, u in enumerate(raw)), [(u, got[i], brute(u, rules)) for i, u in enumerate(raw) if got[i] != brute(u, rules)][:3]
    assert urls.judge(df.limit(0), rl).count() == 0
    assert {r["verdict"] for r in urls.judge(df, rl.limit(0), default="block").collect()} == {"block"}
    plan = urls.judge(df, rl)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
