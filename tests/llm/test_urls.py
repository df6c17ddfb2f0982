import random

import xxhash

from barloom.llm import urls
from barloom.llm.queries import URL_RULES
from brute import judge_url


def table(spark, found):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(found)], "page_id long, url string, host string, rule string")


def made_up(seed):
    dealt = random.Random(seed)
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.COM", "notexample.com", "a.net", "net", "x.org", ""]
    paths = ["", "/", "/en", "/en/", "/en/1", "/es/", "/EN/", "/fr/x?y", "?q=/en/", "#/en/", "/en/#f", "//en/"]
    out = [f"{dealt.choice(['http', 'https', ''])}://{dealt.choice(hosts)}{dealt.choice(paths)}" for _ in range(400)]
    return [*out, None, "", "no scheme", "://", "http://", "a://b://com/en/", "http://\n.com/x\ny", "http://" + "a." * 5000 + "com/" + "x" * 9999]


def test_matches_brute_force(spark):
    found = made_up(1)
    rows = urls.url_verdicts(table(spark, found), URL_RULES)
    assert rows.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(i, *judge_url(u, URL_RULES)) for i, u in enumerate(found)]
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    assert urls.url_verdicts(table(spark, found).limit(0), URL_RULES).count() == 0


def test_many_rules_and_repeated_rows(spark):
    dealt = random.Random(2)
    rules = {f"{dealt.choice('abc')}.{dealt.choice(['net', 'org'])}{p}": dealt.choice(["allow", "block"]) for p in ("", "/", "/p", "/p/q") for _ in range(4)}
    found = [f"http://{dealt.choice(['', 'z.'])}{dealt.choice('abc')}.{dealt.choice(['net', 'org'])}{p}" for p in ("", "/", "/p/q/r", "/px") for _ in range(20)] * 2
    published = urls.publish_rules(spark, rules.items(), otherwise="block")
    rows = urls.judge_pages(table(spark, found), published).collect()
    for row in rows:
        host, path, rule, verdict = judge_url(row.url, rules.items())
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == (verdict if rule else "block")


def test_equal_keys_are_told_apart_by_their_texts(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda text: 5)
    path = tmp_path / "rules.bin"
    path.write_bytes(urls.pack_rules([("a/", "block"), ("b/", "allow"), ("c/", "block")]))
    array = urls.mapped(str(path))
    assert [array.rule(i) if i >= 0 else None for i in array.find(["b/", "d/", "c/"])] == ["b/", None, "c/"]


def test_no_rules(spark):
    rows = urls.url_verdicts(table(spark, ["http://a.com/"]), []).collect()
    assert [(r.rule, r.verdict) for r in rows] == [(None, "allow")]
