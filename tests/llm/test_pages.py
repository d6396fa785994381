"""Main-text extraction and the fixity audit."""

import random

from pyspark.sql import functions as F

from kerbside.llm import extract, merkle

SCHEMA = "page_id long, url string, html string, text string, host string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)


def test_lines_leave_chrome_out():
    page = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>"</script></head><body class="login">
    <nav><ul><li>menu</ul></nav><header>top</header><div class="cookie-notice">cookies</div><article><header><h1>Head &amp; &eacute;</h1></header>
    <p>one <b>bold</b>&nbsp;<br>two<p>three <!-- <p>not this</p> --> 4 &lt; 5<div class='ad'><div>buy</div></div><form>f<input></form>
    <section id=comments><article>a reader</article></section><footer>foot</footer></article><aside>side</aside><p>after"""
    assert extract.lines(page) == [("Head & é", True), ("one bold two", True), ("three 4 < 5", True), ("after", False)]
    assert extract.lines("") == [] and extract.lines("plain  text") == [("plain text", False)]
    assert extract.lines("<p>cut <b") == [("cut", False)]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 20))] for _ in "ab")
        found = sorted(extract.shared(a, b))
        rest = iter(b)
        assert len(found) == lcs(a, b) and all(any(a[i] == y for y in rest) for i in found)


def test_pages_of_a_host_lose_what_they_share(spark):
    page = lambda own: f"<body><p>Welcome to the site<p>{own}<p>All rights reserved"
    rows = [
        (1, "http://h.example/a/1", page("first story")), (2, "http://h.example/a/2", page("second story")),
        (3, "http://other.example/a/1", page("alone")), (4, None, None), (5, "not a url", "<p>x"),
        (6, "http://h.example/b", "<article><p>Same article</article>"), (7, "http://h.example/b2", "<article><p>Same article</article>"),
    ]
    got = {r.page_id: r.text for r in extract.extract(pages(spark, rows)).collect()}
    assert got == {
        1: "first story", 2: "second story", 3: "Welcome to the site\nalone\nAll rights reserved", 4: "", 5: "x",
        6: "Same article", 7: "Same article",
    }
    assert extract.extract(pages(spark, [])).count() == 0


def test_lines_beside_an_article_are_differenced():
    page = lambda i, own: extract.Page(
        i, "", f"<p>Welcome to the site<article><p>Same teaser</article><div>{own}</div><p>All rights reserved", "h", f"/{i}"
    )
    a, b = page(1, "first body"), page(2, "second body")
    assert extract.main_text(a, None, b) == "Same teaser\nfirst body"
    assert extract.main_text(b, a, None) == "Same teaser\nsecond body"


def plain_extract(rows):
    """The same, one page at a time: NEAR keys on either side by a sort of all pages."""
    keyed = []
    for i, url, html in rows:
        bare = "" if url is None else url
        host, _, path = bare.partition("://")[2].partition("/") if "://" in bare else ("", "", bare)
        path = ("/" + path if "://" in bare else bare).split("#")[0]
        keyed.append((host.lower(), path, (i is not None, i or 0), url or "", html or "", (i, url, html)))
    keyed.sort(key=lambda x: x[:5])
    keys = sorted({x[:3] for x in keyed})
    out = []
    for x in keyed:
        k = keys.index(x[:3])
        versions = lambda key: [y for y in keyed if y[:3] == key]
        near = [versions(key)[-1] for key in reversed(keys[max(0, k - extract.NEAR) : k])] + [versions(key)[0] for key in keys[k + 1 : k + 1 + extract.NEAR]]
        near = [y for y in near if y[0] == x[0] and y[5][0] != x[5][0]]
        common = lambda y: next((n for n, (p, q) in enumerate(zip(x[1], y[1])) if p != q), min(len(x[1]), len(y[1])))
        own = extract.marked(x[4])
        left = [n for n, (_, article, chrome) in enumerate(own) if not article or chrome]
        for y in sorted(near, key=lambda y: -common(y)):
            gone = extract.shared([hash(own[n][0]) for n in left], [hash(t[0]) for t in extract.marked(y[4])])
            left = [n for k, n in enumerate(left) if k not in gone]
        out.append((str(x[5][0]), str(x[5][1]), "\n".join(t for n, (t, article, chrome) in enumerate(own) if not chrome and (article or n in left))))
    return out


def test_texts_agree_with_one_page_at_a_time_in_any_parts(spark):
    rng = random.Random(4)
    rows = [
        (i, f"http://h{i % 3}.example/{i // 7}/{i % 50}", f"<p>Menu {i % 3}<p>Part {i // 14}<p>Own {i}<p>{rng.choice('xyz')}<article>A {i % 2}</article><p>Rights {i % 3}")
        for i in range(60)
    ]
    rows += [rows[5], rows[5], (5, rows[5][1], "<p>Menu 2<p>another version"), (7, None, "<p>Own"), (None, "http://h1.example/", None), (None, None, "")]
    rows += [(200, rows[8][1], rows[8][2])]  # a tie of paths
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = {}
    try:
        for n in (1, 4, 23, 90):  # with 90, most parts hold one page or none
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got[n] = sorted((str(r.page_id), str(r.url), r.text) for r in extract.extract(pages(spark, rows)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got[1]) == len(rows) and sum("Menu" in t for _, _, t in got[1]) < 5
    assert got[4] == got[1] and got[23] == got[1] and got[90] == got[1]
    assert got[1] == sorted(plain_extract(rows))


def test_each_means_counts_the_lines_it_took(spark):
    """Menus that near pages share go by differencing, though markup names them; markup takes what is on one page alone."""
    rows = [(i, f"http://h.example/{i:02d}", f"<nav><p>Home<p>News {i}</nav><article><p>Story {i}</article><div class=ad>Buy {i}</div><p>Rights") for i in range(12)]
    got = {r.page_id: (r.text, r.n_differenced, r.n_marked) for r in extract.extract(pages(spark, rows)).collect()}
    assert got == {i: (f"Story {i}", 2, 2) for i in range(12)}
    lone = extract.extract(pages(spark, rows[:1])).first()
    assert (lone.text, lone.n_differenced, lone.n_marked) == ("Story 0\nRights", 0, 3)


def test_differencing_decides_beside_articles(spark):
    """Without it, shared notices that markup does not name would stay."""
    rows = [(i, f"http://h.example/{i}", f"<div>Only today<article><p>Story {i}</article><div>Made by us<div>Note {i}") for i in range(9)]
    with_ = {r.page_id: r.text for r in extract.extract(pages(spark, rows)).collect()}
    without = {i: extract.main_text(extract.Page(i, u, h, "h", u), None, None) for i, u, h in rows}
    assert with_ == {i: f"Story {i}\nNote {i}" for i in range(9)}
    assert all(without[i] == f"Only today\nStory {i}\nMade by us\nNote {i}" for i in without)


def test_a_very_long_page(spark):
    a = [f"line {i}" for i in range(30_000)]
    b = [x for i, x in enumerate(a) if i % 3]
    rows = [(1, "http://h/1", "<p>".join(a)), (2, "http://h/2", "<p>".join(b))]
    got = {r.page_id: r.text for r in extract.extract(pages(spark, rows)).collect()}
    assert got == {1: "\n".join(a[::3]), 2: ""}


def test_audit_finds_the_damage(spark):
    rows = [(i, f"http://h/{i}", "<p>" + "x" * (i % 50)) for i in range(0, 9000, 7)] + [(None, None, None)]
    harmed = [r for r in rows if r[0] != 7 * 5]
    harmed = [(i, u, "#" + h[1:]) if i in (4200, 8400) else (i, u, h) for i, u, h in harmed] + [(50001, "new", "page")]
    got = merkle.audit(pages(spark, rows), pages(spark, harmed)).collect()
    by = {(r.record_id, r.status) for r in got}
    assert {(4200, "changed"), (8400, "changed"), (50001, "extra")} <= by
    # the record after the lost one has moved, and so has all of its archive; others stay whole
    assert (35, "moved") in by and all(r.record_id < merkle.ARCHIVE_IDS for r in got if r.status in ("moved", "missing"))
    assert merkle.audit(pages(spark, rows), pages(spark, rows + rows[:3])).count() == 0
    assert {r.status for r in merkle.audit(pages(spark, rows[:3]), pages(spark, [])).collect()} == {"missing"}
    assert merkle.audit(pages(spark, []), pages(spark, [])).count() == 0


def test_an_id_of_many_versions_keeps_to_its_archive(spark):
    n = merkle.SLOTS + 5000
    hot = spark.range(n).selectExpr("7L page_id", "'u' url", "concat('<p>', id) html")
    rest = [(1, "v", "a"), (8, "v", "b"), (merkle.ARCHIVE_IDS + 3, "w", "c")] + [(merkle.ARCHIVE_IDS + 4 + i, "w", "d") for i in range(2000)]
    primary = hot.unionByName(spark.createDataFrame(rest, "page_id long, url string, html string"))
    replica = primary.withColumn("html", F.when(F.col("page_id") == merkle.ARCHIVE_IDS + 3, "#").otherwise(F.col("html")))
    got = merkle.audit(primary, replica).collect()
    assert [(r.record_id, r.status) for r in got] == [(merkle.ARCHIVE_IDS + 3, "changed")]
    places = merkle.place(merkle.records(primary), merkle.crowded([merkle.records(x) for x in (primary, replica)]))
    parts = places.groupBy("archive", F.floor(F.col("slot") / merkle.SLOTS)).count().collect()
    assert sum(r["count"] for r in parts) == n + len(rest) and max(r["count"] for r in parts) < 2 * merkle.PART_RECORDS
    # one version is lost: it is missing, and only what follows in its part has moved
    lost = merkle.audit(primary, primary.where("html <> '<p>70000'")).collect()
    assert {r.record_id for r in lost} == {7} and 0 < len(lost) < 2 * merkle.PART_RECORDS


def test_an_equal_replica_is_not_descended(spark):
    level = merkle.tree(merkle.layout(pages(spark, [(i, "u", "p") for i in range(40)])), 1)
    assert [x.count() for x in level] == [40, 3, 1, 1, 1]
    root = level[-1].first()
    assert root.start == 0 and root.end > 0 and len(root.digest) == 64
