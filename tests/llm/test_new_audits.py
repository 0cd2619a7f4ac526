"""Source divergence, URL filter and filter audit against plain Python on odd rows, and the language model's sums at any size."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import divergence, filter_audit, language_model, url_filter

LONG = "Word straße 漢字 the of and " * 3_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (None, "the the cat", "en", None), (None, "the the cat", "en", None), (1, None, "en", "a"), (2, "", None, None), (3, "The cat sat; the CAT!", "en", "a"), (4, "cat dog straße", "en", "b"),
        (5, "Straße the dog_cat x1y", "en", "b"), (5, "Straße the dog_cat x1y", "en", "b"), (6, LONG, "en", "c"), (7, "漢字 the", "en", "c"), (8, "un deux", "fr", "a"), (9, "un trois", "fr", "a"), (10, "un", "fr", "b"),
        (11, "9 8 7 --", "de", "z"), (12, "E\u0301 a\x00b", "fr", "b"), (13, "nur eins", "de", "y"),
    ]
    return spark.createDataFrame([(*r, 9, "x", 1, True) for r in rows], "doc_id long, text string, lang string, source string, n long, term string, terms long, good boolean").repartition(5), rows


def plain_divergence(rows, top, least):
    found = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in found}:
        documents = collections.Counter(t for x in found if x[0] == lang for t in set(x[2]))
        kept = {t for t, n in documents.items() if n >= least}
        groups = {s: collections.Counter(t for x in found if x[:2] == (lang, s) for t in x[2] if t in kept) for s in {x[1] for x in found if x[0] == lang}}
        whole = sum(groups.values(), collections.Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in groups.items():
            pairs = sorted(((sum(f(p(c, t), p(groups[o], t)) for t in kept), o) for o in groups if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p(c, t), p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, v, i + 1) for part, listed in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(listed)]
    return sorted(out)


@pytest.mark.parametrize("top, least, small", [(200, 3, False), (2, 1, True)])
def test_divergence_of_odd_rows(docs, monkeypatch, top, least, small):
    df, rows = docs
    if small:  # shards of few rows, counts handed on often, texts cut
        for name, n in (("HELD", 3), ("PIECE", 50), ("COUNTED", 4)):
            monkeypatch.setattr(divergence, name, n)
    found = divergence.source_divergence(df, top, least, 5 if small else divergence.ROWS_A_SHARD).collect()
    assert sorted(map(tuple, found)) == plain_divergence(rows, top, least)


def test_divergence_of_no_rows(docs):
    assert divergence.source_divergence(docs[0].limit(0)).count() == 0


def test_pieces_are_the_text():
    for text in (b"", b"abc", LONG.encode(), b"x" * 500, b" " * 500, b"ab" * 100 + b" " + b"cd" * 100):
        assert [t for p in divergence.pieces(text, 64) for t in p.split()] == text.translate(divergence.TERM_BYTES).split()


def plain_audit(rows, labels):
    firsts, known = {}, {}
    for doc, text, _, _ in rows:
        if doc is not None:
            firsts[text or ""] = min(firsts.get(text or "", doc), doc)
    for doc, quality, toxic in labels:
        q, t = known.get(doc, (0, 0))
        known[doc] = max(q, quality or 0), max(t, toxic or 0)
    judged = []
    for doc, text, _, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and doc > firsts[text]}
        judged.append((source or "", fails, *(known.get(doc, (0, 0)) if doc is not None else (0, 0))))
    out, shapley = {}, collections.Counter()
    for part in {j[0] for j in judged}:
        for order in itertools.permutations("ABCDE"):
            left = [j for j in judged if j[0] == part]
            for step, x in enumerate(order, 1):
                gone = [j for j in left if j[1][x]]
                failing = [j for j in judged if j[0] == part and j[1][x]]
                left = [j for j in left if not j[1][x]]
                shapley[part, x] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), len(failing) - len(gone), sum(sum(j[1].values()) == 1 for j in failing), sum(j[2] == 1 for j in gone), sum(j[3] == 1 for j in gone))
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def test_audit_of_odd_rows(spark, docs):
    df, rows = docs
    more = [(20, "a$ b", "en", "a"), (21, "a$ b", "en", "b"), (22, "a$ b", "en", ""), (23, "one two " * 150, "en", "b"), (24, " ".join(f"w{i}" for i in range(300)), "en", "b"), (25, "ÄÖÜ ABC", "en", "a")]
    wide = df.unionByName(spark.createDataFrame([(*r, 9, "x", 1, True) for r in more], df.schema))
    labels = [(20, 1, 0), (20, 0, 1), (24, 1, 0), (23, None, 1), (None, 1, 1), (21, 0, None), (6, 1, 1)]
    found = filter_audit.filter_interactions(wide, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(map(tuple, found)) == plain_audit(rows + more, labels)


def test_audit_of_no_rows(spark, docs):
    assert filter_audit.filter_interactions(docs[0].limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


PAGES = [
    (1, "https://a.net/x", '<a class="q" href="https://good.org/1">g</a><a href=//B.net/2>b</a><a href="/own">o</a>'), (2, "http://b.net/y", '<A HREF=\'http://c.net\'>c</A><!-- <a href="https://bad.com/de/">no</a> -->'),
    (3, "http://c.net/", '<script>"<a href=\'http://bad.com/de/\'>"</script>'), (4, "http://good.org/p", '<a href="http://a.net/">a</a>'), (5, "http://bad.com/de/1", '<a href="http://e.net/">e</a>'),
    (6, "http://d.net/", '<a href="https://bad.com/de/1?x">d</a>'), (7, "http://d.net/again", None), (8, "https://E.net?x=/de/", "<a <a <a"), (9, None, '<a href="http://c.net/">n</a>'), (10, "no scheme", ""), (11, "x://example.org/en/12#f", ""),
    (12, "http://sub.example.org/es/", ""), (None, "http://sub.example.org/fr/", ""), (13, "http://notexample.org", ""), (13, "http://notexample.org", ""), (14, "http://m.bad.com/en/", ""), (15, "http://fr.com/fr/a://b/de/", ""),
]


def test_rules_links_and_both_ranks(spark):
    df = spark.createDataFrame([(*p, "h", "r") for p in PAGES], "page_id long, url string, html string, host string, rule string").repartition(4)
    found = url_filter.judge_urls(df, rounds=60).collect()
    rows = {(r["page_id"], r["host"], r["path"], r["rule"]): r for r in found}
    assert len(found) == len(PAGES) and {(p, h, s): rule for p, h, s, rule in rows} == {
        (1, "a.net", "/x"): None, (2, "b.net", "/y"): None, (3, "c.net", "/"): None, (4, "good.org", "/p"): "org/", (5, "bad.com", "/de/1"): "com/de/", (6, "d.net", "/"): None, (7, "d.net", "/again"): None, (8, "e.net", ""): None,
        (9, "", ""): None, (10, "", ""): None, (11, "example.org", "/en/12"): "example.org/en/1", (12, "sub.example.org", "/es/"): "example.org/es/", (None, "sub.example.org", "/fr/"): "org/", (13, "notexample.org", ""): None, (14, "m.bad.com", "/en/"): None, (15, "fr.com", "/fr/a://b/de/"): "com/fr/",
    }
    by_host = {r["host"]: (round(r["trust"], 6), round(r["distrust"], 6)) for r in found}
    links = {("a.net", "good.org"): 1.0, ("a.net", "b.net"): 1.0, ("b.net", "c.net"): 1.0, ("good.org", "a.net"): 1.0, ("bad.com", "e.net"): 1.0, ("d.net", "bad.com"): 1.0}
    links |= {pair: 1.0 for low, high in (("sub.example.org", "example.org"), ("m.bad.com", "bad.com")) for pair in ((low, high), (high, low))}
    hosts = sorted({h for pair in links for h in pair} | {"fr.com", "notexample.org"})
    seeds = {"trust": {"good.org": 1, "sub.example.org": 1, "fr.com": 1}, "distrust": {"bad.com": 1, "example.org": 1, "sub.example.org": 1}}
    for kind, column in (("trust", 0), ("distrust", 1)):
        m, s = np.zeros((len(hosts), len(hosts))), np.array([float(seeds[kind].get(h, 0)) for h in hosts])
        for (a, b), w in links.items():
            i, j = (hosts.index(a), hosts.index(b)) if kind == "trust" else (hosts.index(b), hosts.index(a))
            m[j, i] += w
        m /= np.maximum(m.sum(0), 1e-300)
        x = np.linalg.solve(np.eye(len(hosts)) - 0.85 * m, 0.15 * s)
        x *= s.sum() / x.sum()
        assert all(by_host[h][column] == pytest.approx(x[i], abs=1e-3) for i, h in enumerate(hosts) if h in by_host)
    verdict = {r["page_id"]: r["verdict"] for r in found}
    assert (verdict[1], verdict[3], verdict[4], verdict[5], verdict[6], verdict[8], verdict[9], verdict[11], verdict[12], verdict[14]) == ("allow", "allow", "allow", "block", "block", "allow", "allow", "block", "block", "block")


def test_the_longest_rule_wins_and_a_block_before_an_allow(spark):
    rules = [("a.b", "/x", "allow"), ("b", "/x/y", "allow"), ("a.b", "/x/", "block"), ("c.b", "/", "allow"), ("c.b", "/", "block")]
    pages = spark.createDataFrame([(1, "h://a.b/x/y"), (2, "h://a.b/xx"), (3, "h://z.b/x/y"), (4, "h://c.b/"), (5, "h://ab/x")], "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules, rounds=5).collect()}
    assert found == {1: ("a.b/x/", "block"), 2: ("a.b/x", "allow"), 3: ("b/x/y", "allow"), 4: ("c.b/", "block"), 5: (None, "allow")}
    assert url_filter.judge_urls(pages.limit(0), rounds=5).count() == 0


def test_hubs_are_parted(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://s{i}.net/", f'<a href="http://hub.org/">x</a><a href="http://s{i + 1}.net/">y</a>') for i in range(40)] + [(99, "http://hub.org/", "".join(f'<a href="http://s{i}.net/">s</a>' for i in range(40)))], "page_id long, url string, html string")
    whole = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.judge_urls(pages, rounds=10).collect()}
    monkeypatch.setattr(url_filter, "EDGES_A_SALT", 7)
    parts = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.judge_urls(pages, rounds=10).collect()}
    assert whole.keys() == parts.keys() and all(parts[h] == pytest.approx(v, abs=1e-9) for h, v in whole.items())


def test_sums_of_weights_fit_a_long():
    assert language_model.unit_of(1e9) == language_model.UNIT
    assert all(language_model.unit_of(n) * n * language_model.MOST_WEIGHT <= 2.0**62 for n in (1e11, 4.7e12, 1e16))


def test_rounds_of_ranks_are_few_jobs(spark):
    """Each job of a round keeps plans, threads and broadcasts on the driver; the session's own settings stay."""
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    spark.sparkContext.setJobGroup("ranks", "rounds")
    try:
        assert url_filter.judge_urls(df).count() == len(PAGES)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("ranks")
    assert len(jobs) < 2 * url_filter.ROUNDS and spark.conf.get("spark.sql.adaptive.enabled") == "true"
