import pytest

from offerloom.llm import urls

RULES = [
    urls.host_path_rule("allow", "org/"), urls.host_path_rule("block", "example.org/es/"), urls.host_path_rule("block", "example.org/en/1"),
    urls.host_path_rule("allow", "com/fr/"), urls.host_path_rule("block", "com/de/"), urls.UrlRule("any-ads", "block", r"[^/]*/.*banner\d+"),
]
CASES = [
    ("http://example.org/es/a?x#y", "example.org", "/es/a", "example.org/es/", "block"),
    ("HTTP://WWW.Example.ORG/es/", "www.example.org", "/es/", "example.org/es/", "block"),
    ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.org", "x.org", "", None, "allow"),
    ("http://x.org?q=/es/", "x.org", "", None, "allow"),
    ("https://a.b.com/de/1#t", "a.b.com", "/de/1", "com/de/", "block"),
    ("https://a.b.com/DE/1", "a.b.com", "/DE/1", None, "allow"),
    ("http://ÄB.com/fr/é", "Äb.com", "/fr/é", "com/fr/", "allow"),
    ("x://y.net/http://z.org/", "y.net", "/http://z.org/", None, "allow"),
    ("http://q.net/x/banner12", "q.net", "/x/banner12", "any-ads", "block"),
    ("no scheme.org/", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://\n.org/a\nb", "\n.org", "/a\nb", "org/", "allow"),
]


def test_cases_with_repeats_and_clashing_columns(spark):
    rows = [(i % 9, u, "kept", "clash", "clash") for i, (u, *_) in enumerate(CASES + CASES[:2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    judged = urls.judge_urls(pages, RULES)
    assert sorted(judged.columns) == sorted(["page_id", "url", "html", *urls.RESULTS])
    got = sorted((tuple(r) for r in judged.select("url", "host", "path", "rule", "verdict").collect()), key=repr)
    assert got == sorted(CASES + CASES[:2], key=repr)
    assert judged.where("html <> 'kept'").count() == 0


def test_only_candidates_are_tried(spark):
    pages = spark.createDataFrame([("http://a.org/x",), ("http://b.net/y",), ("http://example.org/zh/",)], "url string")
    tried = {r.url: r.tried for r in urls.judge_urls(pages, RULES[:5]).collect()}
    assert tried["http://b.net/y"] == 0 and tried["http://a.org/x"] == 1


def test_index_is_by_the_rarest_token():
    index = urls.rarest_token_index(RULES, {"example": 50, "org": 40, "es": 3, "en": 60, "com": 9, "fr": 1, "de": 2})
    assert {t: [r.name for r in rules] for t, rules in index.items()} == {
        "org": ["org/", "example.org/en/1"], "es": ["example.org/es/"], "fr": ["com/fr/"], "de": ["com/de/"], None: ["any-ads"],
    }


@pytest.mark.parametrize("rules", [[], RULES])
def test_no_rows_and_no_rules(spark, rules):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    one = urls.judge_urls(spark.createDataFrame([(1, "http://k.com/fr/")], "page_id long, url string"), rules).first()
    assert one.rule == ("com/fr/" if rules else None)
