import re

from pyspark.sql import functions as F

from bootloom.llm import urls as ur

ODD = [
    (1, None),
    (2, ""),
    (3, "no scheme.org/es/x"),
    (4, "HTTP://WWW.Example.ORG/es/1"),
    (5, "https://example.org"),
    (6, "https://notexample.org/es/"),
    (7, "https://a.com/de/x?y=://b.org/z&q"),
    (8, "https://a.com/DE/"),
    (9, "x://org/en/1#f"),
    (10, "https://example.org/en/12\n/z?u"),
    (11, "https://a.net/" + "p/" * 20_000),
    (12, "://"),
    (13, "https://É.Example.org/en/1"),
]


def brute(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule in ur.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            best = max(best or "", rule, key=len)
    return host, path, best


def pages(spark, rows):
    wide = [(i, u, 3, "mine") for i, u in rows]
    return spark.createDataFrame(wide, "page_id long, url string, label int, s_host string")


def corpus():
    """Labelled by the rules; in the open hosts, the bad ones look like the blocked ones."""
    rows = []
    for i in range(900):
        bad = i % 2
        site = f"win-{i % 7}-cash-{i % 11}" if bad else "quiet"
        rows.append((100 + i, f"https://{site}.example.com/{'de' if bad else 'fr'}/{i}"))
        rows.append((2000 + i, f"https://{site}.other.net/en/{i}"))
    return rows


def test_rules_and_parts(spark):
    df = pages(spark, ODD + corpus())
    got = {r.page_id: r for r in ur.judged(df.select("page_id", "url")).collect()}
    assert len(got) == len(ODD) + 1800
    for i, url in ODD + corpus():
        assert (got[i].host, got[i].path, got[i].rule) == brute(url)
        assert got[i].verdict == ur.RULES.get(got[i].rule, got[i].verdict) and got[i].verdict in ("allow", "block")
    open_hosts = [(2000 + i, "block" if i % 2 else "allow") for i in range(900)]
    assert sum(got[i].verdict == v for i, v in open_hosts) > 850


def test_clashing_columns_copies_and_few_labels(spark):
    rows = ODD + [(1, None), (4, "HTTP://WWW.Example.ORG/es/1")]
    got = ur.judged(pages(spark, rows).withColumn("host", F.lit("x"))).collect()
    assert len(got) == len(rows) and {r.label for r in got} == {3}
    # With both verdicts or one, by trees or without: the same columns, each as it was.
    names = [*ur.FEATURES, "s_file", "s_host_share", "s_host_n", "s_host_blocked", "_features", "_raw"]
    both = pages(spark, rows + corpus()).withColumns({c: F.lit(f"own {c}") for c in names})
    for df in (both, both.where("url like '%/fr/%'")):
        found = ur.judged(df)
        assert found.columns == [*df.columns, "host", "path", "rule", "verdict"]
        first = found.first()
        assert first.s_host == "mine" and first.label == 3 and all(first[c] == f"own {c}" for c in names)
    only = ur.judged(spark.createDataFrame([(1, "https://a.org/"), (2, "https://b.net/")], "page_id long, url string"))
    assert {r.verdict for r in only.collect()} == {"allow"}
    assert ur.judged(pages(spark, ODD).limit(0)).collect() == []
    assert {r.verdict for r in ur.judged(pages(spark, ODD).select("page_id", "url"), rules={}).collect()} == {"allow"}
