"""URL filters, exact dedup, BPE, language ID and HTML extraction on small tables, against plain Python."""

import hashlib
import html as entities
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from gristmill.llm import bpe, exact_dedup, html_text, language_id, url_filter

SF = "/root/testdata/sf0.001"


def judge(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_url_filter(spark):
    rng = random.Random(1)
    hosts = ["org", "example.org", "www.example.org", "a.b.example.org", "EXAMPLE.org", "com", "x.com", "xcom", "notexample.org", "example-org", "net", "", "a..org", "é.com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/a#b", "/de/", "/de", "?q=1", "#f", "/EN/1"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no scheme/", "://", "http://org", "a://b://c/", "http://www.example.org/es/x\ny"] * 2
    pages = spark.createDataFrame([(i, u, "kept", i) for i, u in enumerate(urls)], "page_id long, url string, stack string, key long")
    rules = [*url_filter.RULES, ("b.example.org", "/es/", "allow"), ("example.org", "/", "block")]
    got = {r["page_id"]: r for r in url_filter.url_filter(pages, rules).collect()}
    assert len(got) == len(urls) and all(r["stack"] == "kept" and r["key"] == r["page_id"] for r in got.values())
    for i, u in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == judge(u, rules), u
    assert url_filter.url_filter(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in url_filter.url_filter(pages, spark.createDataFrame([], url_filter.RULE_SCHEMA)).collect()} == {"allow"}


def test_url_filter_nested_rules(spark):
    """Deeply nested hosts and paths, rules of one place with two verdicts, very long urls, many ranges: as one by one."""
    rng = random.Random(41)
    labels, chars = ["a", "b", "aa", "x-y"], "ab/1"
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda n: "/" + "".join(rng.choice(chars) for _ in range(rng.randint(0, n)))
    rules = [(host(), rng.choice(["", path(5)]), rng.choice(["allow", "block"])) for _ in range(120)] + [("a.b", "/", "allow"), ("a.b", "/", "block"), ("b", "/" + "a" * 3000, "block")]
    urls = [f"https://{host()}{path(9)}?q" for _ in range(500)] + ["http://z.b/" + "a" * 200_000, "http://a.b/", "http://a.b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for ranges in (1, 7):
        got = {r["page_id"]: r for r in url_filter.url_filter(pages, rules, default="none", ranges=ranges).collect()}
        for i, u in enumerate(urls):
            assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == judge(u, rules, "none"), u


def test_exact_dedup(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a b", "ab", "a  b", "A b", "x" * 5000, "é", "a b", "a\x0bb", "a b"]
    rows = [(rng.choice([None, *range(300)]) if k % 40 == 0 else k, rng.choice(texts), "z", k % 3) for k in range(400)] + [(7, "a b", "z", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, rows int")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    for support in (0.001, 0.2):
        got = exact_dedup.exact_groups(docs, support=support).collect()
        assert len(got) == len(rows)
        kept = {}
        for r in got:
            if r["kept"]:
                assert r["text_sha256"] not in kept
                kept[r["text_sha256"]] = r["doc_id"]
        for t, members in groups.items():
            sha = hashlib.sha256(t.encode()).hexdigest()
            assert kept[sha] == min(members)[3]
            assert {r["group_size"] for r in got if r["text_sha256"] == sha} == {len(members)}
            assert {r["keep_id"] for r in got if r["text_sha256"] == sha} == {min(members)[3]}
    stay = exact_dedup.exact_dedup(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert exact_dedup.exact_groups(docs.limit(0)).collect() == [] and exact_dedup.exact_dedup(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(library, monkeypatch):
    rng, t = random.Random(3), bpe.Transducer(bpe.default_path())
    parts = [" ", "  ", "\n", "a", "the", "é", "日本", "😀", "12", "!!", "<|endoftext|>", "'s", "'ll", "\t", "\x1c", "\x85", " ", "ing", "=" * 200, " " * 90, "a" * 700, "aaaabbbb" * 200, "\r\n"]
    for window in (1 << 16, 40):
        monkeypatch.setattr(bpe, "WINDOW", window)
        for _ in range(400):
            s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
            want = library.encode(s, add_special_tokens=False).ids
            ids = t.encode(s)
            assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want
            assert t.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_memory_is_bounded():
    t = bpe.Transducer(bpe.default_path())
    seen = []
    back = t._back
    t._back = lambda last, size, i: (seen.append(len(size)), back(last, size, i))[1]
    assert len(list(t.run(iter([b"ab" * 32] * 400)))) > 0
    assert max(seen) < 6 * t.lookahead


def test_bpe_query(spark, library):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "Hello  world\n", 3), (3, "Hello  world\n", 3), (4, "x " * 20000, 4)], "doc_id long, text string, ids int")
    got = bpe.bpe_digests(docs).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 3, 4]
    for r in got:
        text = {1: "", 2: "", 3: "Hello  world\n", 4: "x " * 20000}[r["doc_id"]]
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = docs.select("text", bpe.decode(bpe.encode(F.col("text"))).alias("again")).collect()
    assert all((r["text"] or "") == r["again"] for r in back)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r["held_out"] and len(r["text"]) > 40]
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    rows = [(k, t, lang, 1) for k in range(60) for t, lang in [("the cat and the dog are here with you", "en")]] + [(100 + k, "der hund und die katze sind hier bei dir", "de", 1) for k in range(60)]
    rows += [(500, None, "en", 1), (501, "123 ###", None, 1), (502, "", "de", 1), (None, "the cat", None, 1), (503, "A", None, 1), (504, "the dog " * 50000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    told = language_id.identify(docs.select("doc_id", "text", "score"), language_id.fit(docs))
    got = {r["doc_id"]: r for r in told.collect()}
    assert [got[k]["lang_pred"] for k in (500, 501, 502)] == ["und"] * 3 and got[503]["lang_pred"] in ("en", "de")
    assert got[504]["lang_pred"] == "en" and got[3]["lang_pred"] == "en" and got[103]["lang_pred"] == "de"
    nothing = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_language_labels_of_held_out_documents_are_not_used(spark):
    docs = spark.createDataFrame([(k, f"the cat number {k}", "en" if zlib.crc32(str(k).encode()) % 4 != 2 else "zz") for k in range(200)], "doc_id long, text string, lang string")
    assert language_id.fit(docs).members == [["en"]]


def test_html_on_pages(spark):
    got = {r["page_id"]: r for r in html_text.op10_html_text(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_html_on_generated_pages():
    rng, model = random.Random(2024), html_text.trained()
    hit = extra = lost = 0
    for _ in range(150):
        page = html_text.sample_page(rng)
        batch = html_text.Batch()
        batch.add(page)
        clean = lambda run: " ".join(entities.unescape("".join(run)).replace(html_text.MARK, "").split())
        want = [clean(run) for _, run in batch.runs if html_text.MARK in "".join(run)]
        got = [x for x in html_text.texts(model, [page.replace(html_text.MARK, "")])[0].split("\n") if x]
        hit += sum(x in want for x in got)
        extra += sum(x not in want for x in got)
        lost += sum(x not in got for x in want)
    assert hit / (hit + extra) > 0.97 and hit / (hit + lost) > 0.97


def test_html_edges(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One  <b>two</b>\n three<p>a < b, c&nbsp;d &am<ul><li>x<li>y</ul></article><section class=comments><p>first!</p></section><footer>f</footer>"
    rows = [(1, None), (2, ""), (3, "   "), (4, page), (4, page), (5, "plain text only"), (6, "<" * 2000), (7, "<article><p>" + "word " * 60000 + "</p></article>"), (8, "<p>" * 3000)]
    pages = spark.createDataFrame([(i, h, "u", "mine") for i, h in rows], "page_id long, html string, url string, page string")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert [got[k]["text"] for k in (1, 2, 3)] == [""] * 3 and all(r["page"] == "mine" for r in got.values())
    assert got[4]["text"] == "T & U\nOne two three\na < b, c d &am\nx\ny"
    assert len(got[7]["text"]) == len("word " * 60000) - 1
    assert html_text.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("start", ["<head><title>T</title><meta charset=utf-8><body class=x>", "<head><title>T</title><link rel=x>", "<head><script>var a='<p>';</script><template><p>no</p></template><body>", "<head><title>T</title></head><body>"])
def test_html_head_left_open_and_math(start):
    """A page may leave out </head>; its text counts all the same, and so does that of formulas."""
    story = "<article><h1>Big news of the day</h1><p>A long first paragraph, with words and <math><mi>x</mi><mo>=</mo><mn>42</mn></math> in it.</p><p>Then a second one, which says more.</p></article>"
    want = "Big news of the day\nA long first paragraph, with words and x=42 in it.\nThen a second one, which says more."
    nav = "<nav><a href=/>Home</a> <a href=/a>About</a></nav>"
    assert html_text.texts(html_text.trained(), [f"<!DOCTYPE html><html>{start}{nav}{story}<footer>&copy; x</footer></html>"]) == [want]


@pytest.mark.parametrize("part", ["<a ", '<a "', "<div>", "<a 'x\"", "<!x", "</i", "<b><p>", "<ul><li><div>", "<a<", "<a x='<b>' ", 'class="', "<b></i>", "<table><tr><td>", "&amp", "<p x=\"a>b"])
@pytest.mark.parametrize("tail", ["", ">", "\"'>"])
def test_html_time_is_linear(part, tail):
    """A megabyte of broken or deep markup takes seconds, and the article before it is still found."""
    story = "<article><h1>Big news of the day</h1><p>A long first paragraph, with words in it.</p></article>"
    began = time.time()
    got = html_text.texts(html_text.trained(), [story + part * (1_000_000 // len(part)) + tail])[0]
    assert time.time() - began < 12 and isinstance(got, str)


def test_html_quoted_brackets():
    page = "<article title='a > b' data-x=\"<p>\"><h1>Big news of the day</h1><p class=\"x>y\">A long first paragraph, with words in it.</p><p>Then 3 < 4, and 5 <6 too.</p></article>"
    assert html_text.texts(html_text.trained(), [page]) == ["Big news of the day\nA long first paragraph, with words in it.\nThen 3 < 4, and 5 <6 too."]
