from pageloom.llm import url_rules

#: The contract's list, written out here so that no change of the code's list goes unnoticed.
CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_every_listed_word_is_the_contracts():
    assert {rule: word for word, rule in url_rules.LISTED} == CONTRACT and len(url_rules.LISTED) == len(CONTRACT)


def test_verdicts_of_rows(spark, tmp_path):
    want = {
        "http://a.com/en/1": ("com/en/", "block"),
        "http://example.com/en/7x": ("example.com/en/7", "allow"),
        "http://x.net/de/1": ("net/de/", "allow"),
        "http://net/de/8": ("net/de/", "allow"),
        "http://w.example.net/de/81": ("example.net/de/8", "block"),
        "http://example.net/de/7": ("net/de/", "allow"),
        "http://q.org/es/": ("org/es/", "block"),
        "http://q.org/fr/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    urls = list(want)
    got = {urls[r.page_id]: (r.rule, r.verdict) for r in url_rules.query(spark, str(tmp_path)).collect()}
    assert got == want
