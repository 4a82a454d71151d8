import math
from collections import Counter

from pyspark.sql import functions as F

from sqlstrata.llm import url_filter as U


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = ["http://Example.COM/en/7?x", "https://a.example.com/en/8", "ftp://x.net/de/8", "http://b.example.net/de/80", "nothing", None, "", "://", "http://", "http://net", "http://net/de/", "http://cotnet/de/", "a://b://c.org/es/1#t",
        "http://x.org?q=/es/", "http://É.org/es/É", "http://x\n.org/es/\n1"]


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")


def runs(url):
    text = U.BEFORE * U.ORDER + url + U.END
    return [text[i:i + U.ORDER + 1] for i in range(len(url) + 1)]


def model(urls, every):
    """Probability of the last character of a run, from its definition: `urls` train, `every` names the characters there are."""
    n, after = Counter(), {}
    for run in (r for u in urls for r in runs(u)):
        for k in range(U.ORDER + 1):
            n[run[-k - 1:]] += 1
            after.setdefault((k, run[-k - 1:-1]), []).append(run[-1])
    symbols = {r[-1] for u in every for r in runs(u)}

    def p(run):
        out = 1 / len(symbols)
        for k in range(U.ORDER + 1):
            seen = after.get((k, run[-k - 1:-1]), [])
            if len(seen) >= U.LEAST:
                out = (n[run[-k - 1:]] + len(set(seen)) * out) / (len(seen) + len(set(seen)))
        return out

    return p


def test_rules_and_parts(spark):
    got = [tuple(r) for r in U.judge(frame(spark, URLS)).orderBy("page_id").select("host", "path", "rule").collect()]
    assert got == [(*host_path(u), rule(*host_path(u))[0]) for u in URLS]


LABELLED = [(f"http://w{i % 9}.net/de/{i * 37 % 400}", "allow") for i in range(40)] + [(f"https://v{i % 5}.org/es/{i * 53 % 900}é", "block") for i in range(30)]


def test_scores_match_the_definition(spark, monkeypatch):
    rows = [(i, -i, u, v, i % 6 == 0) for i, (u, v) in enumerate(dict(LABELLED).items())] + [(900, 0, "x" * 300, None, None), (901, 0, "", None, None), (902, 0, "http://\U0001f600.net", None, None)]
    texts = spark.createDataFrame(rows, "k1 long, k2 long, url string, ruled string, held boolean")
    every = [r[2] for r in rows]
    pa, pr = (model([u for _, _, u, v, held in rows if v == kind and not held], every) for kind in ("allow", "block"))
    want = {k: sum(math.log(pa(r) / pr(r)) for r in runs(u)) / len(runs(u)) for k, _, u, _, _ in rows}
    ratios = U.log_ratios(U.counted(texts))
    for often in (U.FREQUENT, 40, 0):  # all runs broadcast, some, none
        monkeypatch.setattr(U, "FREQUENT", often)
        got = {r["k1"]: r["score"] for r in U.scored(texts, ratios).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


def test_probabilities_add_up_and_the_table_grows(spark):
    urls = [u for u, _ in LABELLED]
    p = model(urls, urls)
    symbols = {r[-1] for u in urls for r in runs(u)}
    assert math.isclose(sum(p("/net" + c) for c in symbols), 1) and math.isclose(sum(p("ZZZZ" + c) for c in symbols), 1)
    count = lambda us: U.counted(spark.createDataFrame([(u, "allow", False) for u in us], "url string, ruled string, held boolean")).count()
    assert count(urls) == len({r for u in urls for r in runs(u)}) > count(urls[:20])


def test_digits_query_and_other_letters_tell_apart(spark):
    same = ["http://q.info/1", "http://q.info/2", "http://q.info/é", "http://q.info/1?a"]
    rows = U.judge(frame(spark, [u for u, _ in LABELLED] + [f"http://n{i}.net/de/1?a" for i in range(30)] + same)).where("page_id >= 100").collect()
    assert len(rows) == 4 and len({r["score"] for r in rows}) == 4


def test_ratio_tells_kinds_apart(spark):
    good = [f"http://w{i}.example.net/de/good{i % 7}" for i in range(60)]
    bad = [f"http://w{i}.example.org/es/casino{i % 7}" for i in range(60)]
    other = ["http://y.example.info/good5", "http://y.example.info/casino5"]
    rows = {r["page_id"]: r for r in U.judge(frame(spark, good + bad + other)).collect()}
    assert rows[120]["verdict"] == "allow" and rows[121]["verdict"] == "block" and rows[120]["score"] > rows[121]["score"]
    assert {rows[i]["verdict"] for i in range(60)} == {"allow"} and {rows[i]["verdict"] for i in range(60, 120)} == {"block"}


def test_without_labels_and_empty(spark):
    assert {r["verdict"] for r in U.judge(frame(spark, ["http://a.info/x", None])).collect()} == {"allow"}
    assert U.judge(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = U.judge(frame(spark, URLS))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_runs(spark):
    texts = ["ab", "", "\U0001f600x", "a" * 60_000]
    got = [r["runs"] for r in U.with_runs(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), F.col("t")).orderBy("i").collect()]
    assert got == [runs(t) for t in texts]


def test_repeated_urls_count_once(spark):
    few = [u for u, _ in LABELLED] + ["http://q.info/de/", "http://q.info/es/"]
    once = {r["host"] + r["path"]: r["score"] for r in U.judge(frame(spark, few)).collect()}
    more = U.judge(frame(spark, few + few[:1] * 50 + few[-1:] * 50)).collect()
    assert len(more) == len(few) + 100 and all(r["score"] == once[r["host"] + r["path"]] for r in more)
