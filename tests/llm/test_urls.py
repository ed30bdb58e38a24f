from sightline.llm import urls

LABELS = "page_id long, good int"
PAGES = "page_id long, url string, html string, host string, rule string"


def pages(spark, listed):
    return spark.createDataFrame([(i, u, "h", "x", "y") for i, u in listed], PAGES)


def test_rules_and_parts(spark):
    cases = {
        None: ("", "", None),
        "no scheme": ("", "", None),
        "http://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/"),
        "http://example.org/en/15": ("example.org", "/en/15", "example.org/en/1"),
        "http://example.org/en/25#t": ("example.org", "/en/25", "org/"),
        "http://example.org": ("example.org", "", None),
        "x://notexample.org/es/": ("notexample.org", "/es/", "org/"),
        "https://a.b.com/de/": ("a.b.com", "/de/", "com/de/"),
        "https://a.b.com?u=http://c.org/": ("a.b.com", "", None),
        "https://com/fr/x": ("com", "/fr/x", "com/fr/"),
        "://": ("", "", None),
        "http://ÀB.org/": ("Àb.org", "/", "org/"),
    }
    listed = list(enumerate(cases))
    found = urls.judged(pages(spark, listed), spark.createDataFrame([], LABELS))
    got = {r.page_id: (r.host, r.path, r.rule) for r in found.collect()}
    assert got == {i: cases[u] for i, u in listed}
    verdicts = {r.rule: r.verdict for r in found.collect() if r.rule}
    assert verdicts == {v: k for k, v in urls.RULES if v in verdicts}


def test_reputation_is_shrunk_to_the_level_above(spark):
    listed, labels = [], []

    def host(name, n, good):
        for k in range(n):
            listed.append((len(listed), f"http://{name}/{k}"))
            labels.append((len(listed) - 1, int(k < good)))

    for i in range(20):
        host(f"h{i}.fine.net", 30, 29)
        host(f"h{i}.foul.net", 30, 2)
    host("one.fine.net", 1, 0)
    listed += [(9001, "http://new.fine.net/"), (9002, "http://new.foul.net/"), (9003, "http://new.third.zz/")]
    found = {r.page_id: r for r in urls.judged(pages(spark, listed), spark.createDataFrame(labels, LABELS)).collect()}
    by_host = {r.host: r for r in found.values()}
    assert len(found) == len(listed)
    # one bad page on a host of a good domain is not enough
    assert by_host["one.fine.net"].verdict == "allow"
    assert by_host["h1.foul.net"].verdict == "block" and by_host["h1.fine.net"].verdict == "allow"
    # hosts without labels have what their domain has
    assert found[9002].verdict == "block" and found[9001].verdict == "allow"
    assert by_host["new.foul.net"].rate < by_host["new.third.zz"].rate < by_host["new.fine.net"].rate
    assert by_host["h1.foul.net"].upper < by_host["new.foul.net"].upper


def test_odd_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert urls.judged(pages(spark, []), none).count() == 0
    listed = [(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://a.net/")]
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 1)], LABELS)
    assert [r.verdict for r in urls.judged(pages(spark, listed), labels).collect()] == ["allow"] * 3


def test_registered_domains(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.com", "com", "", "x.y.z.org", "co.uk")], "host string")
    got = {r.host: (r.d, r.s) for r in rows.select("host", *[c.alias(n) for c, n in zip(urls.domain_of(F.col("host")), "ds")]).collect()}
    assert got == {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "b.com": ("b.com", "com"), "com": ("com", "com"),
        "": ("", ""), "x.y.z.org": ("z.org", "org"), "co.uk": ("co.uk", "uk"),
    }
