import collections
import hashlib
import math
import random
import re

from pageloom.llm import licenses, secrets, url_rules


def exact_places(text):
    w = licenses.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label, _, base in licenses.PHRASES:
        p = phrase.split()
        found += [(k, label) for k in range(len(w)) if base and w[k : k + len(p)] == p]
    return len(w), sorted(found)


def test_base_places_against_brute_force():
    rng = random.Random(1)
    words = ["mit", "license", "apache", "general", "public", "licence", "x", "the", "MIT License", "General\nPublic  License", "Éa"]
    for _ in range(2000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        n, found = licenses.scan(text)
        assert (n, sorted((f, label) for f, _, label, _, base, _ in found if base)) == exact_places(text)


def test_edits_are_found():
    labels = lambda t: {(f[2], f[3]) for f in licenses.scan(t)[1]}
    assert labels("under the MIT Licence today") == {("mit", 1)}
    assert labels("the GNU Genral Public Licens of") == {("gpl", 2)}
    assert labels("Permission is hereby grantd, free of charge, to any persn obtaining a copy") == {("mit", 2)}
    for clean in ("with license", "limit license", "a licensed driver", "", None, "xmit license"):
        assert labels(clean) == set()


def test_license_rows(spark):
    rows = [(1, "MIT license, mit license"), (2, None), (3, ""), (1, "MIT license, mit license"), (4, "x " * 200_000 + "Apache License")]
    got = licenses.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.n_words, len(r.spans)) for r in got) == [(1, 4, 2), (1, 4, 2), (2, 0, 0), (3, 0, 0), (4, 200_002, 1)]
    assert licenses.license_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_secrets(t):
    t = t or ""
    sp = [(m.start(), 0, "assign", m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 12]
    sp += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    sp += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    base = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(sp))
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
        run = m[0]
        least = next(x for p, x in secrets.CLASSES.values() if re.match(p, run))
        if any(re.search(p, run) for p in secrets.ALLOWED):
            continue
        h = max(sum(-c / 20 * math.log2(c / 20) for c in collections.Counter(run[j : j + 20]).values()) for j in range(len(run) - 19))
        if h >= least:
            sp.append((m.start(), 3, "entropy", m.end()))
    return hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(sp))


def test_secrets_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    parts = ['token = "', "password:", "API_KEY=", "secret", "AKIA", "é😀", " ", "\n", "'", "deadbeef", "0123456789abcdef", "Zx9Qw", "abcdefgh", "A7B8C9", "/", "=", ": "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "token: secret: abcdefghijklmnopq"), (503, "key aB3dE5gH7jK9mN1pQ3sT5vX7 " * 300), (502, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.base_sha256, r.spans) for r in secrets.query(spark, str(tmp_path)).collect())
    assert got == sorted((i, *brute_secrets(t)) for i, t in rows)
    assert any("entropy" in x[2] for x in got)


def test_secrets_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert secrets.query(spark, str(tmp_path)).collect() == []


def judged(u):
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host, best = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), None
    for _, rule in url_rules.LISTED:
        at, start = rule.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_listed_rules(spark):
    urls = [None, "", "no scheme", "http://Example.COM/en/7x?q=1#f", "https://a.b.com/en/", "http://com/en/z", "http://xcom/en/", "ftp://x.net/de/1", "http://w.example.net/de/81", "http://é.org/es/", "http://q.org?x=/es/", "a://b://c.com/en/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, host string")
    got = url_rules.judge(df).collect()
    kinds = dict((r, v) for v, r in url_rules.LISTED)
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule = judged(urls[r.id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, kinds.get(rule, "allow"))
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_mined_rules_carry_over(spark):
    """What a listed rule blocks under one host teaches the path's word, which another host then shares."""
    urls = [f"http://h{i % 7}.com/spam/{i}" for i in range(60)] + [f"http://h{i % 7}.com/news/{i}" for i in range(60)] + ["http://other.net/spam/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.id: r for r in url_rules.judge(df, listed=(("block", "com/spam/"),)).collect()}
    assert got[120].verdict == "block" and got[120].rule is None and got[120].confidence >= 0.9
    assert all(got[i].verdict == "allow" for i in range(60, 120))
    rules = url_rules.mine(spark.createDataFrame([(["a", "b"], True)] * 30 + [(["a"], False)] * 30, "tokens array<string>, blocked boolean")).collect()
    assert {tuple(r.antecedent) for r in rules} == {("b",), ("a", "b")} and all(r.key == "b" for r in rules)
