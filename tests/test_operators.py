"""Operators on small inputs of their own."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import hashes, text, urls
from corpusmill.operators import annotate, counts, crawl, dedup, language, paragraphs, rules, tables, tokenizer
from corpusmill.schema import ABBR, NO_SPACE, NUMERIC, PARAGRAPH_START, PUNCT, SENTENCE_START, SITE, TEXT, TITLECASE, UPPERCASE
from corpusmill.sources import files, vertical
from corpusmill.streaming import live

VERT = """<doc id="a" lang="cs en">
<p>
<s>
32\tPrvní
0\tvěta
<g/>
16\t.
<p>
<s>
32\tSecond\tsecond\tAA\t2\tAtr
0\tline\tline\tNN\t0\tPred
</doc>
<doc id="b">
<s>
0\tx
</doc>
"""


def one(spark, column, *values):
    return spark.range(1).select(column(*[F.lit(v) for v in values])).first()[0]


def test_hashes():
    assert hashes.murmur3(b"") == 0
    assert hashes.murmur3(b"hello") == 0x248BFA47
    assert hashes.murmur3(b"hello, world") == 0x149BBB7F
    assert hashes.super_fast_hash(b"") == 0


def test_site_identity(spark):
    r = spark.createDataFrame([("http://www.test.com:8012/a?b#c",)], "u string").select(urls.site_md5(F.col("u")).alias("s"), urls.parse(F.col("u")).alias("p")).first()
    assert int(r.s, 16) == 16344464308082358390
    assert (r.p.host, r.p.port, r.p.path) == ("www.test.com", 8012, "/a?b")


def test_text_functions(spark):
    assert one(spark, text.unaccent, "Příliš Æßð žluťoučký") == "Prilis AEssth zlutoucky"
    assert one(spark, lambda x: text.csts_decode(text.csts_encode(x)), "a<b>&[c]") == "a<b>&[c]"
    assert one(spark, lambda x: text.ip_in_prefix(x, "10.0.0.0", 8), "10.3.2.1")
    assert not one(spark, lambda x: text.ip_in_prefix(x, "10.0.0.0", 8), "11.3.2.1")
    assert one(spark, urls.absolutise, "http://a.b/c/d", "../e") == "http://a.b/e"
    assert one(spark, urls.absolutise, "http://a.b/c/d", "/e") == "http://a.b/e"
    assert one(spark, urls.absolutise, "http://a.b/c/d", "//x.y/e") == "http://x.y/e"
    assert one(spark, urls.with_scheme, " a.b/c ") == "http://a.b/c"


def test_tokenizer():
    t = tokenizer.tokenize_text("Hello WORLD, x2. Next!\n\nNew para", paragraphs=True)
    assert [f for f, _ in t] == ["Hello", "WORLD", ",", "x2", ".", "Next", "!", "New", "para"]
    flags = dict(t)
    assert flags["Hello"] & PARAGRAPH_START and flags["Hello"] & TITLECASE and not flags["Hello"] & UPPERCASE
    assert flags["WORLD"] & UPPERCASE and flags["WORLD"] & NO_SPACE
    assert flags["x2"] & NUMERIC and flags["Next"] & SENTENCE_START and flags["New"] & PARAGRAPH_START
    assert flags["."] & PUNCT and not flags["."] & NO_SPACE
    assert sum(bool(f & SENTENCE_START) for _, f in tokenizer.tokenize_text("a " * 450)) == 3
    assert tokenizer.tokenize_text("x" * 150)[0][0] == "x" * 100
    cs = tokenizer.tokenize_text("Pan prof. Novák má -1.234,5 Kč. Druhá.", fixup=tokenizer.czech_fixup)
    forms = [f for f, _ in cs]
    assert "-1.234,5" in forms
    by = dict(cs)
    assert by["prof"] & ABBR and not by["Novák"] & SENTENCE_START and by["Druhá"] & SENTENCE_START


def texts(spark):
    return spark.createDataFrame(list(vertical.parse_vertical(VERT)), TEXT)


def test_vertical_round_trip(spark, tmp_path):
    t = texts(spark)
    assert t.count() == 2
    assert "\n".join(r[0] for r in t.select(vertical.rendered()).collect()) + "\n" == VERT
    vertical.write(t, f"{tmp_path}/v")
    assert sorted(map(str, vertical.read(spark, f"{tmp_path}/v").collect())) == sorted(map(str, t.collect()))
    spark.dataSource.register(vertical.VerticalSource)
    t.write.format("vertical").mode("append").save(f"{tmp_path}/w")
    paths = ",".join(str(p) for p in (tmp_path / "w").glob("*.vert"))
    assert spark.read.format("vertical").load(paths).count() == 2
    assert spark.read.format("vertical").load(f"{tmp_path}/w").count() == 2
    t.write.format("vertical").mode("append").save(f"file://{tmp_path}/w")
    assert spark.read.format("vertical").load(f"file://{tmp_path}/w").count() == 4
    t.limit(1).write.format("vertical").mode("overwrite").save(f"{tmp_path}/w")
    assert spark.read.format("vertical").load(f"{tmp_path}/w").count() == 1
    writer = vertical._Writer({"path": f"{tmp_path}/w"}, False)
    writer.write(iter(t.limit(1).collect()))  # an attempt that doesn't count
    writer.abort([None])
    assert not list((tmp_path / "w").glob("_*"))
    flat = [r[0] for r in t.select(vertical.rendered_horizontal()).collect()]
    assert "Second second AA 2 Atr\tline line NN 0 Pred" in flat[0]
    assert len(next(vertical.parse_horizontal("a b\tc\nd"))["tokens"]) == 3


def test_paragraph_filters(spark):
    t = texts(spark)
    assert [len(r.tokens) for r in paragraphs.filter_unaccented(t, 10).collect()] == [3]
    assert [len(r.tokens) for r in paragraphs.filter_unaccented(t, 10, reverse=True).orderBy("text_id").collect()] == [2, 1]
    kept = paragraphs.filter_language(t, allow=["en"]).orderBy("text_id").collect()
    assert [(len(r.tokens), r.language) for r in kept] == [(2, ["en"]), (1, [])]
    listed = spark.createDataFrame([("Second",), ("line",), ("line",)], "word string")
    assert paragraphs.filter_missing_accents(t, listed).orderBy("text_id").first().tokens[-1].form == "."
    assert paragraphs.filter_missing_accents(t, listed.limit(0)).count() == 2
    unknown = t.withColumn("tokens", F.transform("tokens", lambda x: x.withField("flags", x["flags"].bitwiseOR(256))))
    assert paragraphs.filter_unrecognized(unknown).orderBy("text_id").collect()[0].text_id == "b"
    assert paragraphs.filter_unrecognized(t).count() == 2
    rows = paragraphs.token_rows(t).filter("text_id = 'a'").orderBy("tok_idx").collect()
    assert [r.para_idx for r in rows] == [0, 0, 0, 1, 1]
    assert t.select(paragraphs.joined(F.col("tokens"))).first()[0] == "První věta. Second line"
    assert paragraphs.delete_words(t, lambda x, i: x["form"] == "x").filter("text_id = 'b'").first().tokens == []


def test_counts(spark):
    t = texts(spark)
    r = counts.word_count(t).first()
    assert (r.docs, r.paragraphs, r.sentences, r.words, r.tokens, r.lemmas) == (2, 2, 3, 5, 6, 2)
    assert {r.lang: r.words for r in counts.language_count(t).collect()} == {"cs": 2, "en": 2, "?": 1}
    s = counts.sentence_forms(t)
    assert s.count() == 3
    grams = {r.gram: r["count"] for r in counts.ngram_counts(s, 2).filter("n = 2").collect()}
    assert grams["<S>\tx"] == 1 and grams["x\t</S>"] == 1


def test_dedup(spark):
    a = [f"w{k}" for k in range(40)]
    units = spark.createDataFrame([(1, a), (2, a[:30] + ["z"] * 10), (3, ["q"] * 5), (4, [f"v{k}" for k in range(20)])], "unit long, words array<string>")
    assert {r.unit: r.kept for r in dedup.exact(units).collect()} == {1: True, 2: False, 3: True, 4: True}
    bloom = dedup.Bloom(1000)
    assert (bloom.k, bloom.duplicate(a), bloom.duplicate(a), bloom.duplicate(["q"] * 5)) == (7, False, True, False)
    t = spark.createDataFrame([(str(i), [], None, [(0, w, None, None, None, None) for w in ws]) for i, ws in ((1, a), (2, a), (3, ["q"] * 5))], TEXT)
    assert [r.text_id for r in dedup.sequential(t, 1000).collect()] == ["1", "3"]


def test_language(spark):
    table = spark.createDataFrame([("en", "the"), ("de", "der"), ("en", "in"), ("de", "in")], "lang string, word string")
    w = spark.createDataFrame([(1, "The"), (2, "der"), (3, "in"), (4, "?")], "id long, word string")
    assert {r.id: r.language for r in language.detect(w, table, "de", "id").collect()} == {1: "en", 2: "de", 3: "de", 4: "de"}
    assert one(spark, lambda x: language.detect_with(x, lambda s: [("xx", 10), ("cs", 60)]), "text") == "cs"
    t = language.detect_texts(texts(spark), table, "en").orderBy("text_id").collect()
    assert [r.language for r in t] == [["en", "en"], ["en"]]


def test_robots(spark):
    robots = "User-agent: *\nDisallow: /*bar.html$\nDisallow: /disabled\n\nUser-Agent: other\nDisallow: /\n"
    assert crawl.robots_rules(robots, "mine") == ([], ["^/.*bar\\.html$", "^/disabled"])
    assert crawl.robots_rules("User-agent: *\nDisallow: /\n\nUser-agent: mine/1\nAllow: /x # c\n", "mine") == (["^/x"], [])
    assert crawl.robots_rules(None, "mine") == ([], [])
    r = spark.createDataFrame([("/a/bar.html", False), ("/a/bar.htmlx", True), ("/disabled/y", False)], "p string, ok boolean")
    rule = F.array(F.lit("^/.*bar\\.html$"), F.lit("^/disabled"))
    assert r.filter(crawl.robots_allow(F.col("p"), F.array().cast("array<string>"), rule) == F.col("ok")).count() == 3
    pages = spark.createDataFrame([("http://a/robots.txt", 0, "HTTP/1.1 200 OK", "text/plain", None, robots), ("http://b/robots.txt", 0, "HTTP/1.1 302 Found", None, "/r.txt", None), ("http://c/robots.txt", 0, "HTTP/1.1 404 No", None, None, None)], "url string, status int, x_status string, content_type string, location string, content string")
    got = {x.url: x for x in crawl.robots_result(pages, "mine", 100).collect()}
    assert (got["http://a/robots.txt"].status, len(got["http://a/robots.txt"].disallow)) == (0, 2)
    assert (got["http://b/robots.txt"].status, got["http://b/robots.txt"].new_url) == (2, "http://b/r.txt")
    assert (got["http://c/robots.txt"].status, got["http://c/robots.txt"].robots_expires) == (1, 86500)


def test_links(spark):
    html = "<base href='http://x.org/d/'><a class=c href=\"e.html#f\">1</a><script>'<a href=\"no\">'</script><!-- <a href='no2'> --><IMG src=i.png><meta http-equiv=refresh content=\"5; url=/r\"><frame src='fr.html'>"
    p = spark.createDataFrame([("http://y.org/", html, "text/html"), ("http://z.org/", "<a href='http://q.org/'>", "text/plain")], "url string, html string, content_type string")
    assert {r.url for r in crawl.extract_urls(p).collect()} == {"http://x.org/d/e.html", "http://x.org/r", "http://x.org/d/fr.html"}
    assert {r.url for r in crawl.extract_urls(p, images=True).collect()} >= {"http://x.org/d/i.png"}


def test_fetch_and_dns(spark):
    pages = spark.createDataFrame([(1, "http://a/", "s"), (2, "http://b/", "t"), (3, "http://c/", "t")], "id long, url string, site_md5 string")
    answers = {"http://a/": (200, {"Content-Type": "text/html", "X-Status": "fake"}, "hi"), "http://b/": (200, {"Content-Type": "image/png"}, "x")}
    got = {r.id: r for r in crawl.fetch(pages, answers.get).collect()}
    assert (got[1].status, got[1].headers["X-Status"], got[2].status, got[3].status) == (0, "HTTP/1.1 200", 2, 1)
    hosts = spark.createDataFrame([("a",), ("b",), ("1.2.3.4",)], "host string")
    ips = {r.host: (r.ip, r.status) for r in crawl.resolve_dns(hosts, {"a": ("9.9.9.9", 60)}.get, 0).collect()}
    assert ips == {"a": ("9.9.9.9", 0), "b": (None, 1), "1.2.3.4": ("1.2.3.4", 0)}


def test_fetch_is_polite():
    now, log = [0.0], []

    def fetcher(url):
        log.append((round(now[0], 3), url))
        now[0] += 0.5 if url == "slow" else 0.01
        return 200, {}, ""

    rows = [{"url": u, "ip": ip, "site_md5": "s"} for u, ip in (("slow", "1"), ("a", "1"), ("b", "2"), ("c", "2"), ("d", None))]
    list(crawl._polite(rows, fetcher, {}, 1.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s)))
    at = {u: t for t, u in log}
    assert at["a"] >= 0.5 + 5 and at["c"] - at["b"] >= 1.01  # ten times as long as it took, or relax
    assert at["b"] < 1 and at["d"] < 1


def test_crawl_pass(spark):
    web = {
        "http://a.x:80/robots.txt": (301, {"Location": "/r.txt"}, ""),
        "http://a.x:80/r.txt": (200, {"Content-Type": "text/plain"}, "User-agent: *\nDisallow: /no\n"),
        "http://a.x/yes": (200, {"Content-Type": "text/html"}, "hello"),
        "http://a.x/moved": (302, {"Location": "/yes"}, ""),
        "http://b.x:80/robots.txt": (404, {}, ""),
        "http://b.x/gone": (404, {}, ""),
    }
    pages = spark.createDataFrame([(1, "http://a.x/yes"), (2, "http://a.x/no/1"), (3, "http://a.x/moved"), (4, "http://b.x/gone"), (5, "http://unknown.x/"), (6, "http://a.x/yes")], "id long, url string")
    old = spark.createDataFrame([("0" * 16, 1, "c.x", 80, "9.9.9.9", 5000, 5000, [], [])], SITE)
    fetched, sites = crawl.crawl_pass(pages, old, {"a.x": ("1.1.1.1", 60), "b.x": ("2.2.2.2", 60)}.get, web.get, "mine", 1000)
    got = {r.id: (r.event, r.url, r.status) for r in fetched.collect()}
    assert {k: v for k, v in got.items() if k not in (1, 6)} == {3: ("MOVED", "http://a.x/yes", 1), 4: ("ERROR", "http://b.x/gone", 0), 5: ("ERROR", "http://unknown.x/", 0)}
    assert [v for k, v in got.items() if k in (1, 6)] == [("OK", "http://a.x/yes", 0)]
    by = {r.host: r for r in sites.collect()}
    assert (by["a.x"].ip, by["a.x"].ip_expires, by["a.x"].disallow, by["a.x"].robots_expires) == ("1.1.1.1", 1060, ["^/no"], 1000 + 86_400)
    assert (by["b.x"].disallow, by["unknown.x"].ip, by["c.x"].ip) == ([], None, "9.9.9.9")


def test_collation(spark):
    w = spark.createDataFrame([(x,) for x in ("iva", "chata", "hora", "čas", "cena")], "word string")
    assert [r.word for r in tables.collated(w, "word").collect()] == ["cena", "čas", "hora", "chata", "iva"]


def test_path_state(spark):
    assert one(spark, crawl.next_refresh, "OK", 0, 0) == math.floor(1.5**37)
    assert one(spark, crawl.next_refresh, "ERROR", 2, 0) == math.floor(1.5**31)
    assert one(spark, crawl.next_refresh, "DISABLED", 0, 0) == 0
    state = live.advance(("NONE", 0, 0, 0, 0, None, None), "OK", 1000, 5, 6)
    assert state == ("OK", 0, 1000, 1000, 37, 5, 6)
    assert live.advance(state, "ERROR", 2000, None, None)[:2] == ("ERROR", 1)
    chain = crawl.follow(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "url string, location string"))
    assert {r.url: r.target for r in chain.collect()} == {"a": "c", "b": "c", "x": None, "y": None}


def test_streaming_state(spark, tmp_path):
    rows = [("s", "p", 10, "OK", 1, 1), ("s", "p", 20, "ERROR", None, None), ("s", "q", 10, "FATAL", None, None)]
    schema = "site_md5 string, path_md5 string, ts long, event string, size long, checksum long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = live.path_states(feed).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.path_md5, r.path_status, r.error_count) for r in spark.table("states").collect()} == {("p", "ERROR", 1), ("q", "DISABLED", 1)}


def test_rules(spark):
    df = spark.createDataFrame([(1, "abc", {"h": "v"}, "10.1.1.1"), (2, "xbc", {}, "11.1.1.1"), (3, None, None, None)], "n int, s string, m map<string,string>, ip string")
    got = rules.apply(df, '# c\ns =~ /x.*/ => DROP\nip =~ 10.0.0.0/8 && m->h == "v" => s = "net", clear(m->h), ACCEPT\nn > 2 => s = "big"\n').orderBy("n").collect()
    assert [(r.n, r.s) for r in got] == [(1, "net"), (3, "big")]
    assert got[0].m == {}
    assert rules.apply(df, "s =~ s/b/B/g => CONTINUE\n").orderBy("n").first().s == "aBc"
    with pytest.raises(ValueError):
        rules.parse("nothing here")
    assert rules.where(df, "n > 1").count() == 2
    holds = lambda rule: [r.n for r in rules.apply(df, rule + " => DROP").orderBy("n").collect()]
    assert holds("s =~ /b/") == [1, 2, 3]  # a pattern has to match the whole value
    assert holds("s =~ /.*BC/i") == [3]
    assert holds("s !~ /a.*/") == [1]
    assert holds("ip !~ 10.0.0.0/8") == [1]
    assert holds("* && \\\n n > 1") == [1]
    six = spark.createDataFrame([(1, "fe80::1:2"), (2, "2001:db8:0:0:1::7"), (3, "::1"), (4, "1::2::3"), (5, None)], "n int, ip string")
    kept = lambda rule: [r.n for r in rules.apply(six, rule + " => DROP").orderBy("n").collect()]
    assert kept("ip =~ fe80::/10") == [2, 3, 4, 5]
    assert kept("ip =~ 2001:db8::/33") == [1, 3, 4, 5]
    assert kept("ip == ::1") == [1, 2, 4, 5]


def test_tables(spark, tmp_path):
    w = spark.createDataFrame([(x,) for x in "b a b c c c".split()], "word string")
    ids = {r.word: r.id for r in tables.dictionary(w).collect()}
    assert ids == {"c": 1, "b": 2, "a": 3}
    d = tables.dictionary(w)
    assert tables.decode_words(tables.encode_words(w, d).select("id"), d).count() == 6
    assert [r.word for r in tables.top(w.distinct().withColumn("n", F.length("word")), 2, "n", "word").collect()] == ["a", "b"]
    tables.write_split(w.withColumn("n", F.lit(1)), f"{tmp_path}/s", "word")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 6
    a, b = (tables.shuffled(w.distinct(), "word").collect() for _ in range(2))
    assert a == b


def test_sources(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one\ntwo")
    (tmp_path / "list").write_text(f"{tmp_path}/x.txt\n{tmp_path}/missing.txt")
    assert files.read_raw_text(spark, f"{tmp_path}/list", True).first().text == "one\ntwo"
    assert files.plain_wiki("'''A''' [[b|c]] {{x {{y}} z}} [[File:q.png]]\n== h ==\n* d <ref>r</ref>&amp; e") == "A c\n\nd & e"
    assert files.generated_pages(spark, 4, "p", 2).count() == 4
    files.save(files.constant_texts(spark, 3), f"{tmp_path}/t")
    assert files.load(spark, f"{tmp_path}/t").count() == 3
    (tmp_path / "w.xml").write_text("<mediawiki><page><title>T</title><revision><text>[[a]] b</text></revision></page></mediawiki>")
    assert files.read_wiki(spark, f"{tmp_path}/w.xml").first().text == "a b"


def test_arrays_and_counters(spark):
    row = spark.createDataFrame([(["a", "b"], None)], "x array<string>, y array<string>")
    x = F.col("x")
    got = row.select(text.array_get(x, 1), text.array_get(x, 5, "?"), text.array_set(x, 0, "z"), text.array_set(x, 3, "z", "-"), text.array_add(x, "c"), text.array_add(F.col("y"), "c")).first()
    assert list(got) == ["b", "?", ["z", "b"], ["a", "b", "-", "z"], ["a", "b", "c"], ["c"]]
    rows, seen = counts.observed(spark.range(10), "pass", even=F.col("id") % 2 == 0)
    rows.collect()
    assert seen.get == {"items": 10, "even": 5}


def test_collocations(spark):
    rows = [("d1", 0, 0, "dog", "NN", 2, "Sb"), ("d1", 0, 1, "bite", "VB", 0, "Pred"), ("d1", 0, 2, "man", "NN", 2, "Obj"), ("d2", 0, 0, "dog", "NN", 2, "Sb"), ("d2", 0, 1, "bite", "VB", 0, "Pred")]
    t = spark.createDataFrame(rows, "doc string, sent int, tok int, lemma string, pos string, head int, deprel string")
    one = counts.collocations(t.filter("doc = 'd1'"))
    both = counts.merge_collocations(one, counts.collocations(t.filter("doc = 'd2'")))
    got = {(r.key, r.relation, r.other): (r["count"], [(p.doc, p.position) for p in r.positions]) for r in both.collect()}
    assert got["dog-N", "Sb", "bite"] == (2, [("d1", 1), ("d2", 1)])
    assert got["bite-V", "-Obj", "man"] == (1, [("d1", 2)])
    assert got == {(r.key, r.relation, r.other): (r["count"], [(p.doc, p.position) for p in r.positions]) for r in counts.collocations(t).collect()}


def test_ngrams_with_repeats_and_nulls(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "b"],), ([],), (None,)], "forms array<string>")
    got = {(r.n, r.gram): r["count"] for r in counts.ngram_counts(rows, 3).collect()}
    assert got[1, "a"] == 2 and got[1, "<S>"] == 2 and got[2, "a\tb"] == 2 and got[2, "<S>\t</S>"] == 1
    assert got[3, "<S>\ta\tb"] == 1 and got[3, "a\tb\ta"] == 1 and sum(v for (n, _), v in got.items() if n == 3) == 4


def test_annotations(spark):
    verb = texts(spark).withColumn("tokens", F.transform("tokens", lambda x, i: x.withField("pos", F.when(i == 1, "VB"))))
    assert verb.orderBy("text_id").select(annotate.following_verb(F.col("tokens"), 0)).first()[0] == "věta"
    t = texts(spark)
    got = annotate.tag(t, lambda forms: [(f.lower(), "NN", False) for f in forms]).first().tokens
    assert got[0].lemma == "první"
    failed = annotate.parse(t, lambda forms, tags: None).first().tokens
    assert (failed[0].head, failed[0].deprel) == (0, "ExD")
    assert one(spark, annotate.short_tag, "NNFS4") == "N4"
    assert one(spark, annotate.short_tag, "Db---") == "Db"
    assert one(spark, annotate.tagger_features, "Ab-1").suffix2 == "-1"
    assert annotate.export(t).first().language == ["cs", "en"]


def test_bloom_query_is_sized_by_its_table(spark, tmp_path):
    """Against a brute-force set of n-grams, on more of them than a constant size would hold."""
    from corpusmill.plans import catalog

    texts = [" ".join(f"w{d}x{i}" for i in range(40)) for d in range(60)] + ["too short"]
    texts += texts[:5] + [texts[5] + " " + " ".join(f"new{i}" for i in range(40))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sizes, plain = [], dedup.sequential
    dedup.sequential = lambda df, total, **k: sizes.append(total) or plain(df, total, **k)
    try:
        got = {r.doc_id for r in catalog.QUERIES["dedup_bloom_sequential"](spark, str(tmp_path)).collect()}
    finally:
        dedup.sequential = plain
    seen, kept, grams = set(), set(), 0
    for i, t in enumerate(texts):
        w = t.split()
        own = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        grams += len(own)
        if not own or sum(g in seen for g in own) / len(own) <= 0.3:
            kept.add(i)
            seen |= set(own)
    assert got == kept
    assert sizes == [grams]


def test_attach_sites_loses_no_site(spark, tmp_path):
    from corpusmill.plans import catalog

    rows = [(i, f"http://s{i}.example.org/p", "") for i in range(12)] + [(20, "http://s4.example.org/p", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["attach_sites"](spark, str(tmp_path)).collect()
    assert sorted(r.first_page for r in got) == list(range(12))


def test_bloom_against_single_bits():
    """Whole arrays of keys give what a filter that takes bit by bit gives; a unit that goes leaves no trace."""
    import numpy as np
    import pyarrow as pa

    words = [*(f"w{i}" for i in range(40)), "", "čeština", "abcd", "a\0", "x" * 101, None]
    mixed = hashes.murmur3_all(pa.array(words))
    assert mixed.tolist() == [hashes.murmur3((w or "").encode()) for w in words]
    rng = np.random.default_rng(1)
    for total, span in ((40, 6), (3000, 40)):
        seen, bits = dedup.Bloom(total), set()
        for _ in range(200):
            h = mixed[rng.integers(0, span, rng.integers(0, 60))]
            keys = seen.keys(hashes.murmur3_mixed(h))
            grams = np.lib.stride_tricks.sliding_window_view(h, 8) if len(h) > 7 else np.zeros((0, 8), np.uint32)
            want = [[(int(hashes.murmur3_words(grams, 2 * j + 1, 32)[g]) << 32 | int(hashes.murmur3_words(grams, 2 * j, 32)[g])) % seen.m for j in range(seen.k)] for g in range(len(grams))]
            assert keys.T.tolist() == want
            now, known = set(bits), 0
            for g in want:
                known += set(g) <= now
                now |= set(g)
            gone = bool(want) and known / len(want) > 0.3
            assert seen.goes(*seen.places(keys, np.zeros(keys.shape[1], int))) == gone
            bits = bits if gone else now
            assert np.flatnonzero(np.unpackbits(seen.bits, bitorder="little")).tolist() == sorted(bits)


def test_path_state_at_and_after_now(spark, tmp_path):
    """A change in the second of the last one, and one before it, as the query's SQL has them; the streaming twin does alike."""
    import duckdb
    from corpusmill.plans import catalog

    rows = [(k, f"http://s.org/{k}", "") for k in (0, 4, 99_996, 100_000, 100_004, 100_001)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["path_state"](spark, str(tmp_path)).collect())
    assert got == sorted(c.execute(catalog.SQL["path_state"]).fetchall())
    ages = sorted(r[5] for r in got if r[2] == "OK")
    assert ages == [16, 16, 34, 37, 41]  # page_id 99,996, 100,000, 4, 0 and 100,004
    twin = [live.advance(("OK", 0, 0, m, 0, 0, 0), "OK", 1_000_000, 1, 2)[4] for m in (0, 40, 999_960, 1_000_000, 1_000_040)]
    assert twin == [37, 34, 16, 0, 41]  # the twin enters nothing in the same second
    state = spark.createDataFrame([("s", "p", "OK", 0, 0, 1_000_000, 7, 0, 0)], "site_md5 string, path_md5 string, path_status string, error_count int, last_update long, last_modified long, history long, size long, checksum long")
    event = spark.createDataFrame([("s", "p", "OK", 1, 2)], "site_md5 string, path_md5 string, event string, size long, checksum long")
    assert [crawl.apply_events(state, event, 1_000_000, same_second=x).first().history for x in (False, True)] == [7, 7 << 8 | 16]


TREES = "array<struct<sent int, tok int, form string, lemma string, pos string, head int, deprel string>>"


def trees(spark):
    """Texts and the same tokens as rows; with nulls, heads that point nowhere, two sentences and a text without tokens."""
    words = ["Pes", "kouše", "muže", "Ďábel", "a:b", None, "z"]
    made = lambda d, s, n: [(s, k, words[(k + d) % 7], words[(k * 3 + d) % 7], ["NN", "V", "A1", "D", "Z", None][(k + d) % 6], (k * 5 + d) % (n + 2), ["Obj", "Sb", "Adv", "Atr", "Pred", None][(k * d) % 6]) for k in range(n)]
    rows = [(d, made(d, 0, 4 + d % 5) + made(d, 1, d % 4)) for d in range(40)] + [(40, []), (41, None)]
    t = spark.createDataFrame(rows, f"doc long, tokens {TREES}")
    return t, t.select("doc", F.explode("tokens").alias("t")).select("doc", "t.*")


def test_families_and_collocations_of_whole_texts(spark):
    """Whole texts give what joined rows give, without a shuffle of tokens."""
    t, rows = trees(spark)
    columns = ["doc", "sent", "tok", "parent_form", "parent_pos", "child_forms"]
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    got = annotate.family_in_texts(t)
    assert order(got) == order(annotate.with_family(rows).select(columns)) and got.columns == columns
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = order(counts.collocations(rows).select("key", "relation", "other", "count"))
    assert any(r[2] is None for r in want)
    for whole in ("doc >= 0", "doc < 20", "doc < 0"):
        assert order(counts.collocation_counts(t.filter(whole), rows.filter(f"not ({whole})"))) == want


@pytest.mark.parametrize("name", ["token_family", "collocations"])
def test_parses_of_shared_doc_ids(spark, tmp_path, name):
    """As SQL, also where documents share their doc_id or have none."""
    import duckdb
    from corpusmill.plans import catalog

    texts = ["Alpha beta gamma delta epsilon zeta eta", "one three seven eleven", "x", "", None, "the same the same word word"]
    rows = [(k % 5 if k < 6 else None if k == 6 else k, "en", "s", texts[k % 6]) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, c.execute(catalog.SQL[name]).fetchall()))


def test_hashed_grams_go_in_slices(spark, monkeypatch):
    """A batch of long units is cut by its words, and gives the same."""
    import numpy as np
    import pyarrow as pa

    b = pa.record_batch({"x": list(range(6))})
    assert [x.column("x").to_pylist() for x in paragraphs.slices(b, np.array([1, 2, 9, 0, 3, 3]), 3)] == [[0, 1], [2], [3, 4], [5]]
    rng = np.random.default_rng(3)
    rows = [(i, [f"w{k}" for k in rng.integers(0, 3, n)]) for i, n in enumerate((0, 5, 60, 8, 200, 30))] + [(9, None)]
    units = spark.createDataFrame(rows, "unit long, words array<string>").coalesce(1)
    whole = sorted(map(tuple, dedup.hashed_grams(units).collect()))
    monkeypatch.setattr(dedup, "SLICE_WORDS", 50)
    units = spark.createDataFrame(rows, "unit long, words array<string>").coalesce(1)
    assert sorted(map(tuple, dedup.hashed_grams(units).collect())) == whole and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("ids", [[1, 2, (1 << 39) - 1, 3], [-5, 2, 7, 3], [1 << 62, 2, 7, 3]])
def test_paragraph_dedup_of_any_id(spark, tmp_path, ids):
    """As SQL, whether or not the ids fit with a line's number; only small ones are found by hashes alone."""
    import duckdb
    from corpusmill.plans import catalog

    line = "a b c d e f g h i j k l"
    texts = [f"{line}\n\n{line} m n o p q r s", f"x\n{line} z", f"{line}\n" * 3, "q w e r t y u i o p a s d f"]
    rows = [(i, "en", "s", t) for i, t in zip(ids, texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES["dedup_paras_exact"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(catalog.SQL["dedup_paras_exact"]).fetchall())
    assert ("SortAggregate" in got._jdf.queryExecution().executedPlan().toString()) == (max(ids) >= 1 << 39 or min(ids) < 0)


def test_tokens_go_in_slices(spark, monkeypatch):
    """A batch of long texts is given back in parts, with the same tokens."""
    rows = [(i, t) for i, t in enumerate(["Ahoj světe. Jak je? " * 9, None, "", "x", "3,5 a +1 " * 30, "konec"])]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    whole = sorted(map(repr, tokenizer.tokenize(df, fixup="cs").collect()))
    monkeypatch.setattr(tokenizer, "SLICE_CHARS", 100)
    parts = tokenizer.tokenize(df, fixup="cs")
    assert sorted(map(repr, parts.collect())) == whole


def test_tokenizer_forgets_chunks(monkeypatch):
    """What it remembers of chunks between spaces is bounded, and changes no token."""
    text = " ".join(f"Slovo{i}, (a{i}). \n\n {'x' * i}\tKonec.{i}  3,{i}" for i in range(60))
    plain = [tokenizer.tokenize_text(x, max_word=20, paragraphs=True) for x in (text, text)]
    monkeypatch.setattr(tokenizer, "_CHUNKS", {})
    monkeypatch.setattr(tokenizer, "_MOST_KNOWN", 7)
    assert [tokenizer.tokenize_text(x, max_word=20, paragraphs=True) for x in (text, text)] == plain
    assert 0 < len(tokenizer._CHUNKS) <= 7 and max(map(len, tokenizer._CHUNKS)) <= tokenizer._LONGEST_KNOWN
    assert "".join(t[0] for t in plain[0][:8]) == "Slovo0,(a0).Konec."


def test_links_with_any_quotes(spark):
    """One search finds all quotes; empty values are no links, and HTML is freed of scripts once, in a column of its own."""
    html = """<base href='http://b.org/d/'><A class="x" HREF = "one.html?a=&#39;"><a href='t"wo'><a href=three><a href=""><a href=''><a name=x><area href="/four">
<script><a href="no"></script><!-- <a href="no2"> --><iframe src=five></iframe><img src='i.png'><a href="http://x.org/é#f"><a href="/./six">"""
    p = spark.createDataFrame([("http://a.org/p", html), ("http://a.org/q", None)], "url string, html string")
    assert p.select(crawl.links_of(F.col("html"))).first()[0] == ["one.html?a=&#39;", 't"wo', "three", "http://x.org/é#f", "/./six", "/four", "five"]
    got = crawl.extract_urls(p, images=True)
    assert sorted(r.url for r in got.collect()) == sorted(["http://b.org/d/one.html?a=&", 'http://b.org/d/t"wo', "http://b.org/d/three", "http://x.org/é", "http://b.org/six", "http://b.org/four", "http://b.org/d/five", "http://b.org/d/i.png"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("(?is)<script") == 1


def test_missing_accents_by_set_and_by_join(spark):
    """A short list is looked up where the texts are and a long one joined, with the same result."""
    import random

    random.seed(2)
    forms = ["Cas", "ČAS", "zena", "žena", "der", ",", "Mesto", "\u212a", None, "ΣΑΣ"]
    token = lambda w, first: (PARAGRAPH_START if first else PUNCT if w == "," else 0, w, None, None, None, None)
    rows = [(str(i), [], None, [token(random.choice(forms), random.random() < 0.3) for _ in range(random.randrange(30))]) for i in range(60)] + [("n", [], None, None)]
    t = spark.createDataFrame(rows, TEXT)
    listed = spark.createDataFrame([("CAS",), ("zena",), ("mesto",), ("zena",), (None,), ("σας",)], "word string")
    found = lambda df: sorted((r.text_id, tuple(x.form for x in r.tokens)) for r in df.collect())
    by_set = paragraphs.filter_missing_accents(t, listed)
    assert found(by_set) == found(paragraphs.filter_missing_accents_joined(t, listed))
    assert by_set.columns == t.columns and "Exchange" not in by_set._jdf.queryExecution().executedPlan().toString()
    assert 0 < by_set.count() < 61


def test_ngrams_are_shuffled_before_they_are_added_up(spark):
    """One exchange, below both steps of the sum, so that no task holds a table of all its n-grams before it."""
    rows = spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],)], "forms array<string>").repartition(2)
    got = counts.ngram_counts(rows, 2, least=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("REPARTITION_BY_COL") and "HashAggregate" not in plan[plan.index("REPARTITION_BY_COL") :] and "ENSURE_REQUIREMENTS" not in plan
    assert {(r.n, r.gram): r["count"] for r in got.collect()} == {(2, "<S>\ta"): 2, (2, "a\tb"): 2, (2, "b\t</S>"): 1, (2, "b\tc"): 1, (2, "c\t</S>"): 1}


@pytest.mark.parametrize("words", [7, 1 << 20])
def test_ngrams_are_shuffled_packed(spark, monkeypatch, words):
    """A row a bucket of a chunk of words goes through the shuffle, not one a distinct n-gram; sums are right over chunks."""
    monkeypatch.setattr(counts, "GRAM_WORDS", words)
    rng = random.Random(3)
    made = [[rng.choice(["", "é", "日本", "a b", *map(str, range(300))]) for _ in range(rng.choice([0, 1, 2, 30]))] for _ in range(40 if words < 100 else 2000)]
    want = Counter((n, "\t".join(p[i : i + n])) for x in made for p in [["<S>", *x, "</S>"]] for n in (2, 3) for i in range(len(p) - n + 1))
    got = counts.ngram_counts(spark.createDataFrame([(x,) for x in [*made, None]], "forms array<string>").repartition(2), 3, least=2)
    found = got.collect()
    assert len(found) == len(want) and {(r.n, r.gram): r["count"] for r in found} == want
    node = got._jdf.queryExecution().executedPlan().executedPlan()
    while "ShuffleQueryStage" not in node.nodeName():
        node = node.plan() if "QueryStage" in node.nodeName() else node.children().head()
    written = node.plan().metrics().apply("shuffleRecordsWritten").value()
    if words > 100:
        assert len(want) > 20_000 and written <= 2 * 2 * 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
