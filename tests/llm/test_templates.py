"""Path templates against SQL, hosts and paths against plain slicing, merging and purity on made branches."""

import random

import duckdb

from rillspark.llm import templates


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = lambda s, stops: min([s.index(c) for c in stops if c in s], default=len(s))
    host = rest[: end(rest, "/?#")]
    path = rest[len(host) :]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[: end(path, "?#")]


def plain_rule(host, path):
    fit = [r for r in templates.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
    return (best[1] + best[2], best[0]) if best else (None, None)


ODD = [None, "", "no scheme", "http://", "http:///", "HTTP://WWW.Example.ORG/ES/x", "http://example.org/es/", "http://example.org/en/12", "http://sub.example.org/en/2", "x://org/", "x://borg/", "x://a.com", "x://a.com/fr/?q#f", "x://a.com?fr/",
       "x://a.com#/de/", "x://a.com/de", "x://a.com/de/", "a\nb://Ä.COM/de/\n1", "x://y://z/de/", "x://a.net/" + "/".join("abcdefghij"), "x://a.net//b///c/", "x://a.net/{n}/*|%/1", "x://a.net/" + "p" * 50_000, "x://a.net/" + "s/" * 3000]


def urls():
    rng = random.Random(8)
    out = list(ODD)
    for _ in range(3000):
        host = rng.choice(["big.example.com"] * 6 + ["m.example.org", "example.org", "a.net", "b.com", f"h{rng.randrange(60)}.net"])
        parts = [rng.choice(["en", "de", "fr", "es", f"x{rng.randrange(99)}"]), *rng.choice([[], [str(rng.randrange(999))], [f"{rng.randrange(99)}.html"], ["tag", rng.choice("abc"), str(rng.randrange(9))], [f"{rng.getrandbits(40):x}"]])]
        out.append(f"https://{host}/" + "/".join(parts) + rng.choice(["", "/", "?a=/b", "#/c"]))
    return out


def judged(spark, rows, **more):
    table = spark.createDataFrame([(i, u, "<p>", 5, "h") for i, u in rows], "page_id long, url string, html string, purity int, host string").repartition(3)
    return table, [tuple(r) for r in templates.judge(table, **more).collect()]


def test_against_sql_and_plain_parts(spark):
    rows = [*enumerate(urls()), (None, "x://a.com/de/1"), (4, "x://a.com/de/1")]
    table, got = judged(spark, rows)
    assert sorted(map(str, (r[:4] for r in got))) == sorted(str((i, *plain_parts(u), plain_rule(*plain_parts(u))[0])) for i, u in rows)
    pages = table.select("page_id", "url").toArrow()  # noqa: F841  read by the SQL
    want = duckdb.sql(f"SELECT page_id, host, path, rule, verdict, template, purity FROM ({templates.ORACLE})").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want))
    for r in got:
        kind = plain_rule(r[1], r[2])[1]
        assert r[4] == kind if kind else r[4] in ("allow", "block")
    assert {r[5] for r in got if r[1] == "a.net" and r[2].startswith("/s/")} <= {r[5] for r in got if r[5].endswith("/**")}
    assert judged(spark, [])[1] == []


def test_branches_merge_by_their_labels_and_blocked_templates_go(spark):
    rules = (("block", "s.net", "/bad/a"), ("allow", "s.net", "/good/a"), ("allow", "s.net", "/fine/a"))
    rows = [(i, f"x://s.net/{part}/{tail}{i}") for i, (part, tail) in enumerate((p, t) for p in ("bad", "good", "fine", "rest") for t in "ab" for _ in range(30))]
    _, got = judged(spark, rows, rules=rules)
    by = {}
    for r in got:
        by.setdefault(r[2].split("/")[1], set()).add((r[5].split("/")[1], r[4] if r[3] is None else None))
    assert by["good"] == by["fine"] == {("{fine|good}", None), ("{fine|good}", "allow")}
    assert by["bad"] == {("bad", None), ("bad", "block")}
    assert by["rest"] == {("rest", "allow")}


def test_hot_nodes_go_another_way_with_the_same_result(spark, monkeypatch):
    rows = list(enumerate(urls()))
    _, usual = judged(spark, rows)
    monkeypatch.setattr(templates, "HOT", 3)
    assert sorted(map(str, judged(spark, rows)[1])) == sorted(map(str, usual))
