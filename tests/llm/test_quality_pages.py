"""Classifier, URL filter, HTML extraction and decontamination against brute force."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlab.llm.common import Scratch
from cohortlab.llm import decontaminate, html_text, quality, url_filter
from tests.conftest import SF001, SF01
from tests.llm.cases import empty, frame, odd_documents, prose


# ------------------------------------------------------------------ quality

def test_gradient_matches_differences():
    rnd = np.random.default_rng(0)
    score, y = rnd.normal(size=30), rnd.integers(0, 4, 30)
    cuts = np.array([-0.7, 0.2, 1.1])
    _, g_score, g_cut = quality.ordinal_loss(score, y, cuts)
    e = 1e-6
    f = lambda s, c: quality.ordinal_loss(s, y, c)[0]
    for i in range(30):
        d = np.eye(30)[i] * e
        assert abs((f(score + d, cuts) - f(score - d, cuts)) / (2 * e) - g_score[i]) < 1e-5
    for i in range(3):
        d = np.eye(3)[i] * e
        assert abs((f(score, cuts + d) - f(score, cuts - d)) / (2 * e) - g_cut[i]) < 1e-5


def test_minimise_reaches_the_optimum():
    a = np.diag([1.0, 10.0, 100.0])
    x = quality.minimise(lambda v: (0.5 * v @ a @ v - v.sum(), a @ v - 1), np.zeros(3), tol=1e-14)
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rated = quality.graded(spark.read.parquet(f"{SF01}/labels.parquet"))
    held = F.xxhash64("doc_id", F.lit("held out")) % 4 == 0
    model = quality.fit(docs, rated.filter(~held))
    assert model.thresholds == sorted(model.thresholds) and model.grades == [0, 1, 2]
    got = quality.score(docs, model).join(rated.filter(held), "doc_id").toPandas()
    good = got["grade"] == 2
    assert len(got) > 800
    # about 3,000 ratings, of which 350 are toxic in four languages
    assert (got["kept"] == good).mean() > 0.97
    assert got.loc[good, "kept"].mean() > 0.99                      # clean documents stay
    assert (~got.loc[got["grade"] == 0, "kept"]).mean() > 0.98      # poor ones go
    assert (~got.loc[got["grade"] == 1, "kept"]).mean() > 0.7       # and most toxic ones
    # the expected grade rises with the rating
    mean = got.groupby("grade")["expected_grade"].mean()
    assert mean[0] < mean[1] < mean[2]


def test_quality_odd_cases(spark):
    rows = odd_documents()
    df = frame(spark, rows)
    ratings = spark.createDataFrame([(i, 0 if i % 2 else 2) for i in range(12)] + [(0, 0), (None, 1), (105, None)],
                                    "doc_id bigint, grade int")
    model = quality.fit(df, ratings)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.tail_prob <= 1 for r in got)
    kept = quality.select(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert quality.score(empty(spark), model).count() == 0 and quality.select(empty(spark), model).count() == 0


def test_without_two_grades_everything_is_kept(spark):
    df = frame(spark, odd_documents())
    one = spark.createDataFrame([(1, 2), (2, 2)], "doc_id bigint, grade int")
    assert quality.fit(df, one) is None and quality.fit(df, one.limit(0)) is None
    assert all(r.kept and r.score is None for r in quality.score(df, None).collect())
    assert quality.select(df, None).count() == df.count()


# ------------------------------------------------------------------ urls

def _judge_brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


URLS = ["https://A.Example.ORG/en/12?x", "http://example.org/es/", "http://xexample.org/es/1", "http://org", "http://org/",
        "http://a.com/fr/1#t", "http://a.com/de/1", "http://com/de/", "http://a.com/FR/", "no scheme/x", "", None,
        "ftp://x.net?q=://b.org/", "a://b://c.org/x", "http://İ.org/", "http://u:p@h.org:80/en/1"]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(pages.withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = _judge_brute(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")


@pytest.mark.parametrize("hops, linkers", [(16, 1), (9, 30)])      # far from the seed; ranks below 1e-12
def test_every_host_that_distrust_reaches_is_blocked(spark, hops, linkers):
    rows = [(-1, "http://h0x0.net/de/1", None), (-2, "http://good.org/", None), (-3, "http://bad.com/de/1", None),
            (-4, "http://h0x0.net/", '<a href="http://bad.com/">x</a>')]
    rows += [(k * linkers + j, f"http://h{k}x{j}.net/", f'<a href="http://h{k - 1}x0.net/">x</a>')
             for k in range(1, hops + 1) for j in range(linkers)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages).collect()}
    assert got == {r[0]: "allow" if r[0] == -2 else "block" for r in rows}


def test_distrust_walks_against_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">x</a>' for h in hosts)
    rows = [(0, "http://bad.com/de/1", link("sink.net")), (1, "http://farm.net/1", link("bad.com", "BAD.com")),
            (2, "http://farm2.net/1", link("farm.net")), (3, "http://good.org/1", link("friend.net")),
            (4, "http://friend.net/1", link("friend.net")), (5, "http://lone.net/1", None), (6, None, link("bad.com")),
            (7, "http://sink.net/1", "<a href=//good.org>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    # the ranks equal a dense power iteration
    hosts = sorted({"bad.com", "farm.net", "farm2.net", "good.org", "friend.net", "sink.net"})
    edges = {("bad.com", "sink.net"), ("farm.net", "bad.com"), ("farm2.net", "farm.net"),
             ("good.org", "friend.net"), ("sink.net", "good.org")}
    links = url_filter.host_links(pages)
    assert {(r.src, r.dst) for r in links.collect()} == edges
    seeds = spark.createDataFrame([("good.org", "trust", 1.0), ("bad.com", "distrust", 1.0)],
                                  "host string, kind string, seed double")
    from cohortlab.llm.common import Scratch
    rank = {(r.host, r.kind): r["rank"] for r in url_filter.propagate(seeds, links, Scratch(spark, "t")).collect()}
    for kind, start in (("trust", "good.org"), ("distrust", "bad.com")):
        m = np.zeros((len(hosts), len(hosts)))
        for a, b in edges:
            s, d = (a, b) if kind == "trust" else (b, a)
            m[hosts.index(d), hosts.index(s)] = 1
        m /= np.maximum(m.sum(axis=0), 1)
        v = seed = np.eye(len(hosts))[hosts.index(start)]
        for _ in range(url_filter.ROUNDS):
            v = (1 - url_filter.DAMPING) * seed + url_filter.DAMPING * m @ v
        for h, x in zip(hosts, v):
            assert abs(rank.get((h, kind), 0.0) - x) < 1e-12


def test_urls_empty_table(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_filter.judge(none).count() == 0 and html_text.extract(none).count() == 0


# ------------------------------------------------------------------ html

NOISE = ('<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu item</a></li></ul></nav>'
         '<div class="cookie-notice">We use cookies <p>on every page of this site, with many words in it, indeed</p></div>'
         '<aside><p>Sidebar text that goes on and on, for long</p></aside><div id="ad-1" class="ad">Buy now</div>'
         '<form><label>Search</label><input><button>Go</button></form><script>var a="</p><p>not text";</script>'
         '<style>p{color:red}</style>')
END = ('<section class="comments"><h2>Comments</h2><div class="comment"><p>A reader says a lot of things about this '
       'article, and more.</p></div></section><footer>&copy; 2024</footer>')
STORY = ('<h1>A &amp; B</h1><p>First   paragraph\n with <b>bold</b> and <a href="#">a link</a>.</p><!-- <p>no</p> -->'
         '<p>Second &lt;one&gt; &eacute;&#233;&#x1F600;<br>next line<p>Third, unclosed<ul><li>one<li>two</ul>')
TEXT = "A & B\nFirst paragraph with bold and a link.\nSecond <one> éé\U0001f600 next line\nThird, unclosed\none\ntwo"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<div id="c7"><div class="post-body x9">{}</div></div>',
                                  '<main><div class="entry">{}</div></main>',
                                  '<div class="page with-sidebar no-ads"><div class="hasComments text">{}</div></div>', "<article><section>{}</section></article>"])
def test_article_of_a_template(spark, wrap):
    page = f"<html><head><title>T</title></head><body>{NOISE}{wrap.format(STORY)}{END}</body></html>"
    short = f"<html><body>{NOISE}{wrap.format('<p>Hi.</p>')}{END}</body></html>"
    cut = page[:page.index("Third")] + "Third</fo"
    rows = [(i, f"http://h.net/{i}", page) for i in range(3)] + [(3, "http://h.net/s", short), (4, "http://h.net/c", cut),
            (5, "http://h.net/n", None), (6, None, page), (7, "http://h.net/e", ""), (0, "http://h.net/0", page)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("own"))
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i in (0, 1, 2, 6):
        assert by[i].text == TEXT and by[i].n_chars == len(TEXT)
    assert by[3].text == "Hi."
    assert by[4].text == TEXT[:TEXT.index("Third")] + "Third"
    assert by[5].text == by[7].text == ""


def test_host_paths_win_over_a_page_of_its_own_kind(spark):
    usual = "<body><div class='story'><p>{}</p></div><div class='box'><p>{}</p></div></body>"
    rows = [(i, "http://h.net/", usual.format("story words " * 20, "box")) for i in range(5)]
    rows.append((9, "http://h.net/", usual.format("brief", "a box with far more words than usual " * 20)))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[9] == "brief" and got[0] == ("story words " * 20).strip()
    paths = html_text.host_paths(pages, Scratch(spark, "test-html")).collect()
    assert [(p.host, p.path) for p in paths] == [("h.net", ">body>div.story")]


def test_a_host_with_many_templates_keeps_every_vote(spark):
    # forty templates on one host: on a page of each the advert is longer than the story
    names = [a + b for a in "abcdefgh" for b in "klmno"]
    usual = "<body><div class='story{}'><p>{}</p></div><div class='box{}'><p>{}</p></div></body>"
    rows = [(i, "http://h.net/", usual.format(n, f"story words of {n} " * 20, n, "box"))
            for i in range(3) for n in names]
    rows += [(100 + k, "http://h.net/", usual.format(n, f"brief {n}", n, "more words than usual " * 50))
             for k, n in enumerate(names)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_text.extract(pages).filter("page_id >= 100").collect()}
    assert got == {100 + k: f"brief {n}" for k, n in enumerate(names)}
    # the join beyond the broadcast bound gives the same rows
    want = sorted(html_text.extract(pages).collect())
    bound, html_text.BROADCAST_BYTES = html_text.BROADCAST_BYTES, 0
    try:
        assert sorted(html_text.extract(pages).collect()) == want
    finally:
        html_text.BROADCAST_BYTES = bound


def test_extraction_on_the_table_equals_a_plain_parse(spark):
    import html as H
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"<(?:/|[a-z]+)?$", "", re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1])
        blocks = (" ".join(H.unescape(re.sub(r"<[^>]*>", " ", b)).split())
                  for b in re.split(r"</?(?:p|h1|article)>", body))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_scan_survives_broken_markup():
    for s in ("<", "<a", "</", "<p class='x", "<script>", "<!-- ", "<div" + " a" * 20000, "<>" * 1000, "&#xFFFFFFFF;",
              "<p>" * 5000, "<div>" * 3000 + "deep"):
        page = html_text.Page(s)
        page.text(None)


# ------------------------------------------------------------------ decontamination

ITEM = "Mary had 12 apples and bought 30 more for 4 dollars at the market near Boston before the party began"


def _hits(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("x")).withColumn("h", F.lit(1))
    b = spark.createDataFrame(items, "item_id bigint, text string").withColumn("size", F.lit("x"))
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}


def test_a_shared_prompt_line_names_no_pairs(spark):
    prompt = "Please read the following question with great care and then answer it in one short sentence"
    words = [f"{a}{b}ly" for a in "bcdfghjklmnprstvwz" for b in ("ara", "emo", "idu", "ona", "upe")]
    rng = np.random.default_rng(5)
    own = [" ".join(rng.choice(words, 40)) for _ in range(30)]
    items = [(i, f"{prompt} {t}") for i, t in enumerate(own)]
    docs = [(i, f"{prompt} and nothing else of note") for i in range(50)]
    docs += [(100, f"a page that holds {prompt} {own[7]} whole"), (101, f"{prompt} " + " ".join(own[3].split()[:30]))]
    bench = decontaminate._texts(spark.createDataFrame(items, "item_id bigint, text string"), "item_id") \
        .mapInPandas(lambda it: decontaminate._benchmark(it, decontaminate.WINDOW), decontaminate._WINDOW)
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect())
    found = decontaminate._texts(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id") \
        .mapInPandas(lambda it: decontaminate._documents(it, sizes, None), decontaminate._WINDOW)
    pairs = decontaminate.candidates(found, decontaminate.rare_windows(bench)).select("doc_id", "item_id").distinct()
    assert {tuple(r) for r in pairs.collect()} == {(100, 7), (101, 3)}
    assert _hits(spark, docs, items) == {(100, 7), (101, 3)}
    # items made of the shared line alone are found by it
    assert _hits(spark, docs[:3], [(1, prompt), (2, prompt)]) == {(d, i) for d in range(3) for i in (1, 2)}


def test_templates_and_slot_consistency(spark):
    pad = prose(3, 40)
    docs = [(1, f"{pad} {ITEM} {pad}"),
            (2, pad + " " + ITEM.replace("Mary", "John").replace("12", "7").replace("30", "99").replace("Boston", "Paris")),
            (3, pad + " " + ITEM.replace("30", "12")),                 # two numbers become one
            (4, pad), (5, None), (6, ""), (7, ITEM.replace("apples", "pears").replace("market", "shop")
                                           .replace("party", "game").replace("bought", "sold")),
            (8, ITEM[:40]), (None, ITEM), (9, ITEM), (9, ITEM),
            (10, "short item text here"), (11, "Short Item"), (12, ITEM.replace("dollars", "euros"))]
    items = [(1, ITEM), (2, None), (3, ""), (4, "short item text here"), (5, "Xy Zq"), (1, ITEM)]
    assert _hits(spark, docs, items) == {(1, 1), (2, 1), (9, 1), (10, 4), (12, 1)}


def test_slots_of_another_width(spark):
    pad, item = prose(3, 40), ("the train from Paris takes 1000 people to the coast and " + prose(5, 30)
                               + " with 20 of 70 seats left for " + prose(6, 40))
    docs = [(1, f"{pad} {item.replace('Paris', 'New York City')} {pad}"), (2, item.replace("1000", "1 000 000")),
            (3, item.replace("Paris", "New York").replace("1000", "2 500")),
            (4, item.replace("with 20", "with about 20")),             # one token more in the middle
            (5, item.replace("with 20", "20")),                        # and one fewer
            (6, item.replace("70", "20")),                             # slots that disagree cost their windows only
            (7, " ".join(reversed(item.split()))), (8, pad)]
    assert _hits(spark, docs, [(1, item)]) == {(i, 1) for i in range(1, 7)}


def test_chains_ascend_and_slots_hold():
    line = [(10 + k, k) for k in range(5)] + [(17 + k, 5 + k) for k in range(5)]     # the shift grows by 2
    assert max(map(len, decontaminate.chains(line, 6))) == 10
    far = [(10 + k, k) for k in range(5)] + [(17 + decontaminate.GAP + k, 5 + k) for k in range(5)]
    assert decontaminate.chains(far, 6) == []
    back = sorted([(20 + k, k) for k in range(5)] + [(13 + k, 5 + k) for k in range(5)])
    assert decontaminate.chains(back, 8) == []
    assert decontaminate.holding([[(0, "a", "x")], [(1, "a", "x")], [(2, "a", "y")], [], [(3, "b", "x")]]) == 3
    assert decontaminate.holding([[(0, "a", "x")], [(1, "b", "x")], []]) == 1


def test_whole_items_in_another_case(spark):
    pad, item = prose(3, 40), "Then Anna met Bob. They Saw 3 dogs. Later Carl came home. Dora left Rome after 5 days. Emil Slept."
    docs = [(1, f"{pad} {item.upper()} {pad}"), (2, f"{pad} {item.lower()} {pad}"), (3, f"{pad} {item.title()} {pad}"),
            (4, item.upper().replace(" ", "!! ").replace("3", "8")), (5, pad.upper())]
    assert _hits(spark, docs, [(1, item)]) == {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_benchmark_passages_of_the_table(spark):
    docs, bench = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [words(r.text) for r in bench.collect()]
    leaks = {r.doc_id for r in docs.collect() if any(i in words(r.text) for i in items)}
    got = decontaminate.decontamination(docs, bench).collect()
    assert len(got) == docs.count() and {r.doc_id for r in got if not r.kept} == leaks and leaks


def test_shuffled_windows_give_the_same_hits(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(decontaminate.contaminated(docs.limit(300), bench).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)      # nothing fits: all windows are joined
    assert sorted(decontaminate.contaminated(docs.limit(300), bench).collect()) == want


def test_decontamination_empty_tables(spark):
    df = frame(spark, odd_documents())
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.decontamination(df, none).collect()
    assert len(got) == sum(i is not None for i, _ in odd_documents()) and all(r.kept for r in got)
    some = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert decontaminate.decontamination(empty(spark), some).count() == 0
