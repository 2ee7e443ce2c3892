"""Each operator against a brute-force version or a round trip, and on the odd cases: nulls, empty texts and tables, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import common, files, html_text, kneser_ney, langid, pieces, quality, setjoin, sharding, toxicity, warc, winnow

random.seed(11)
V = [f"w{i}" for i in range(400)]
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one two"), (904, "x " * 30000), (905, "same row here"), (905, "same row here"), (None, "an id that is null")]
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def frame(spark, rows, extra="text_ string"):
    return spark.createDataFrame([(*r, "kept") for r in rows], f"doc_id long, text string, {extra}")


def texts(n, size=40):
    return [(i, " ".join(random.choice(V) for _ in range(random.randint(1, size)))) for i in range(n)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_counts(spark):
    rows = texts(40) + ODD + [(50, "a b c d e\nq\na b c d e\nq\n\n#$ |<>"), (51, "Ä b c d e f g h i j k é 𝕏")]
    got = {(r.doc_id, r.text): r for r in quality.base_counts(frame(spark, rows)).collect()}
    for i, t in rows:
        w = BLANK.findall(t or "")
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen, cover = Counter(wins), set()
        for k, x in enumerate(wins):
            if seen[x] > 1:
                cover.update(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if BLANK.search(x)]
        r = got[i, t]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))


def test_quality_verdict(spark):
    few = [w + end for w in V[:40] for end in ("", "a")]
    good = [(i, " ".join(random.choice(few) for _ in range(300))) for i in range(90)]
    bad = [(100 + i, " ".join(random.choice(few) + "###" for _ in range(300))) for i in range(20)]
    out = quality.assess(frame(spark, good + bad + ODD), labels(spark, [(i, 1, 0) for i in range(60)]))
    kept = {r.doc_id for r in out.filter("kept").collect()}
    assert kept >= set(range(90)) and not kept & set(range(100, 120)) and not kept & {900, 901, 902, 903}
    assert "text_" in out.columns and out.count() == 110 + len(ODD)
    assert quality.assess(frame(spark, []), labels(spark, [])).count() == 0
    assert quality.assess(frame(spark, good), labels(spark, [])).filter("kept").count() == 90


def test_html(spark):
    nav = '<div><a href="/a">Home</a> <a href="/b">About us</a></div>'
    page = lambda i: f"<html><head><title>t{i}</title></head><body>{nav}<p>Story {i} &amp; more<br>text<p>Second {i}</p><div class='cookie-note x'>c</div><script>if (a < b) '</p>'</script><!-- <p>no</p> --><footer>f</footer></body></html>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(8)]
    rows.append((20, "https://h.example/x", "<nav>n</nav><article><h1>T</h1><p>A&nbsp;b</p><form>f</form><div class='comments'>c</div><aside>s</aside></article><p>out</p>"))
    rows += [(21, None, None), (22, "::bad[", "plain < text"), (23, "https://lone.example/", page(9))]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "Story 3 & more text\n\nSecond 3"
    assert out[20] == "T\n\nA b" and out[21] == "" and out[22] == "plain < text"
    assert out[23].startswith("Home About us")  # one page of a host has no template
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def words_of(*key):
    """Words that are always the same for a key and differ between keys."""
    r = random.Random(str(key))
    return " ".join(r.choice(V) + str(key[-1]) for _ in range(12))


def html_texts(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_copies(spark):
    menu = '<div><a href="/a">Home</a> <a href="/b">About us</a></div>'
    story = [f"Paragraph {k} {words_of('story', k)}" for k in range(6)]
    page = lambda ps: f"<body>{menu}{''.join(f'<p>{p}</p>' for p in ps)}</body>"
    rows = [(i, f"https://h.example/{i}", page(story)) for i in range(9)]  # exact copies
    rows += [(20 + i, f"https://h.example/n{i}", page([*story, f"Seen {i} times"])) for i in range(9)]  # near copies
    rows += [(40 + i, f"https://h.example/o{i}", page([words_of("other", i)])) for i in range(9)]
    rows += [(60 + i, f"https://copies.example/{i}", page(story)) for i in range(9)]
    out = html_texts(spark, rows)
    whole = "\n\n".join(story)
    assert all(out[i] == whole and out[20 + i] == f"{whole}\n\nSeen {i} times" and out[40 + i] == words_of("other", i) for i in range(9))
    assert all(out[60 + i] == f"Home About us\n\n{whole}" for i in range(9))  # one page of its host


def test_html_hot_host(spark, monkeypatch):
    notice = "<p>Part of the series on rivers</p>"
    rows = [(i, f"https://hot.example/{i}", f"<body>{notice if i < 6 else ''}<p>{words_of('hot', i)}</p></body>") for i in range(700)]
    assert html_texts(spark, rows) == {i: words_of("hot", i) for i in range(700)}
    monkeypatch.setattr(html_text, "SMALL", 1)  # several files of keys
    rows = [(i, u, h.replace("<body>", "<body><p>Notice</p><p>Third</p>")) for i, u, h in rows[:40]]
    assert html_texts(spark, rows) == {i: words_of("hot", i) for i in range(40)}


def test_html_inside_article(spark):
    box = "<div class='x'><p>Get our best stories by mail</p></div>"
    rows = [(i, f"https://h.example/{i}", f"<main><p>{words_of('a', i)}</p>{box}<p>{words_of('b', i)}</p></main>") for i in range(8)]
    rows.append((20, "https://h.example/short", f"<main><p>Brief</p>{box}</main>"))  # its bulk stays
    out = html_texts(spark, rows)
    assert all(out[i] == f"{words_of('a', i)}\n\n{words_of('b', i)}" for i in range(8))
    assert out[20] == "Brief\n\nGet our best stories by mail"


def test_html_names_of_wrappers():
    whole = "<p>Real story of some length here</p>"
    text = lambda h: (lambda p: p.text(np.zeros(len(p.blocks), bool)))(html_text.Page(h))
    for wrapper in ('<div class="site has-sidebar"><article>{}</article></div>', '<div class="no-comments">{}</div>', '<article class="post ad-free">{}</article>', '<div id="menu-page">{}</div>', '<div class="popup"><main>{}</main><p>Other prose that stands beside it</p></div>'):
        assert "Real story" in text(wrapper.format(whole)), wrapper
    assert text(f'{whole}<div class="site-sidebar"><p>Weather</p></div><div class="cookie_banner x">Cookies</div><div id="comments"><p>First!</p></div>') == "Real story of some length here"
    assert text(f'<article>{whole}</article><section class="comments"><article class="comment"><p>{"I say so. " * 30}</p></article></section>') == "Real story of some length here"


def test_html_keeps_prose_that_recurs(spark):
    quote, short = "<p>A sentence that many articles share.</p>", "<ul><li>Yes.</li></ul>"
    rows = []
    for i in range(12):
        body = [f"<p>{words_of('q', k, i)}</p>" for k in range(6)]
        body[1 + i % 2] += quote
        body[3 + i % 2] += short
        whole = "".join(body)
        rows += [(i, f"https://a.example/{i}", f"<article>{whole}</article>"), (100 + i, f"https://b.example/{i}", f"<body><div><p>Top line</p><p>Second line</p></div>{whole}</body>")]
    out = html_texts(spark, rows)
    for i in range(12):
        assert "A sentence that many articles share." in out[i] and "Yes." in out[i]
        assert "A sentence that many articles share." in out[100 + i] and "Yes." in out[100 + i] and "Top line" not in out[100 + i]


def test_html_names_in_articles():
    text = lambda h: (lambda p: p.text(np.zeros(len(p.blocks), bool)))(html_text.Page(h))
    assert text('<article><p class="share-price">Shares fell.</p></article>') == "Shares fell."
    assert text('<article><div class="comment-on-budget"><p>The minister said so.</p></div><p>x</p></article>') == "The minister said so.\n\nx"
    assert text('<article><h2 class="search-title">Find</h2><p>q</p></article>') == "Find\n\nq"
    assert text('<article><p>t</p><div class="comment-list"><p>c</p></div><div class="cookie-banner">n</div></article>') == "t"


@pytest.mark.parametrize("source", ["<a " * 1_000_000, '<a href="x" ' * 100_000, "<b>" * 60_000 + "</i>" * 60_000, "<i><div>" + "<b>" * 60_000 + "</i>" * 60_000, "<ul>" + "<div>" * 30_000 + "<li></li>" * 30_000, "<table>" + "<tr><td>x" * 30_000, "<a \"'>" * 100_000, "<!x" * 300_000, "<div class=ad>" * 20_000 + "x", "<li><td>" * 30_000])
def test_html_of_hostile_pages(source):
    began = time.process_time()
    page = html_text.Page(source)
    page.returned(), page.keys("h")
    assert time.process_time() - began < 8  # quadratic work would take minutes


class Plain(HTMLParser):
    """A parser of its own for well-formed pages: blocks in order, those of junk elements and classes left out."""

    def __init__(self, source):
        super().__init__()
        self.out, self.run, self.stack = [], "", []
        self.feed(source)
        self.flush()

    def flush(self):
        text = " ".join(self.run.split())
        if text and not any(self.stack):
            self.out.append(text)
        self.run = ""

    def handle_starttag(self, tag, attrs):
        if tag in html_text.VOID:
            self.run += " " if tag in ("br", "hr") else ""
            return
        if tag in html_text.BLOCK:
            self.flush()
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).split()
        self.stack.append(tag in html_text.JUNK or tag in html_text.RAW or tag == "header" or bool({"ad", "comments", "sidebar"} & set(names)))

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.flush()
        self.stack.pop()

    def handle_data(self, data):
        if not (self.stack and self.stack[-1] and self.lasttag in html_text.RAW):
            self.run += data


def test_html_against_another_parser():
    r = random.Random(12)
    say = lambda: " ".join(r.choice(["word", "a &amp; b", "<b>bold</b> x", "&eacute;t&#233;", "1 &lt; 2", "y<br>z", '<a href="u">link</a> text', "<i>i</i>"]) for _ in range(r.randint(1, 9)))

    def tree(depth):
        kind = r.choice(["p", "p", "h2", "div", "ul", "blockquote", "nav", "aside", "script", "ad", "comments", "table"])
        if kind in ("p", "h2") or not depth:
            return f"<p>{say()}</p>"
        if kind == "script":
            return "<script>if (a < b) '</p>'</script>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{say()}</li>" for _ in range(3)) + "</ul>"
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{say()}</td><td>{say()}</td></tr>" for _ in range(2)) + "</table>"
        inner = "".join(tree(depth - 1) for _ in range(r.randint(1, 3)))
        return f'<div class="{kind}">{inner}</div>' if kind in ("ad", "comments") else f"<{kind}>{inner}</{kind}>"

    for _ in range(200):
        source = "<body>" + f"<p>{say()} lead {'prose ' * 400}</p>" + "".join(tree(3) for _ in range(8)) + "</body>"
        page = html_text.Page(source)
        assert page.text(np.zeros(len(page.blocks), bool)) == "\n\n".join(Plain(source).out)


def test_grams_of_many_words(monkeypatch):
    r = np.random.default_rng(2)
    for most in (5, 2**22, 2**40):
        columns = [r.integers(0, most, 4000, dtype=np.uint64) for _ in range(3)]
        columns = [np.append(c, c[:900]) for c in columns]
        found, n = kneser_ney.grams(columns)
        want = Counter(zip(*(c.tolist() for c in columns), strict=True))
        assert dict(zip(zip(*(c.tolist() for c in found), strict=True), n.tolist(), strict=True)) == want
    v = np.arange(2_200_000, dtype=np.uint64)  # more different words than three places fit
    assert not kneser_ney.fits(len(v), 3)
    (t, u, w), n = kneser_ney.grams([np.append(v[:1], v[:-1]), v, v[::-1].copy()])
    assert len(n) == len(v) and n.max() == 1 and (u == v).all() and (w == v[::-1]).all()


def plain_labels(net, data):
    """The network byte by byte in plain steps: mean probabilities over all positions of a text."""
    h, total = langid.HIDDEN, np.zeros(len(net.names))
    table, recur = net.table.astype(float).reshape(3, 2, h, 256), net.recur.astype(float).reshape(3, 2, h, 2, h)
    for at in range(0, len(data), langid.STRETCH):
        part = data[at : at + langid.STRETCH]
        states = np.zeros((len(part), 2 * h))
        for side, order in ((0, range(len(part))), (1, range(len(part) - 1, -1, -1))):
            state = np.zeros(h)
            for i in order:
                x, r = table[:, side, :, part[i]], recur[:, side, :, side] @ state
                u, g = 1 / (1 + np.exp(-(x[:2] + r[:2])))
                new = np.tanh(x[2] + g * r[2])
                state = new + u * (state - new)
                states[i, side * h : (side + 1) * h] = state
        z = states @ net.out.astype(float).T + net.bias[:, 0]
        p = np.exp(z - z.max(1, keepdims=True))
        total += (p / p.sum(1, keepdims=True)).sum(0)
    return total / len(data)


def test_language_of_every_text_against_plain_steps(spark):
    r = random.Random(8)
    kinds = {"de": "der die und nicht schön Straße", "en": "the and not with of which", "fr": "le la été où très ça"}
    rows = [(i, " ".join(r.choice(kinds[k].split()) for _ in range(r.randint(1, 60))), k) for i, k in ((i, r.choice(list(kinds))) for i in range(150))]
    docs = spark.createDataFrame(rows + [(900, None, "de"), (901, "1 2 3", "en"), (902, "x" * 700, None)], "doc_id long, text string, lang string")
    net = langid.fit(docs)
    assert net.names == ["de", "en", "fr"]
    for x in langid.identify(docs, net).collect():
        if not any(c.isalpha() for c in x.text or ""):
            assert (x.lang_pred, x.lang_score) == ("und", 0.0)
            continue
        p = plain_labels(net, x.text.encode())
        assert x.lang_pred == net.names[int(p.argmax())] and abs(x.lang_score - p.max()) < 1e-4


def brute_templates(pages):
    """The rules of `templates` and `extract`, all pages in memory."""
    parsed = [(html_text.Page(h), html_text.host_of(u)) for _, u, h in pages]
    kinds = {}
    for page, host in parsed:
        kinds.setdefault((host, tuple(page.blocks)), []).append((page.keys(host).tobytes(), page.spans().tobytes(), page))
    distinct = [(host, min(x, key=lambda y: y[:2])[2]) for (host, _), x in kinds.items() if x[0][2].subtrees]

    def often(rows):
        n = {}
        for keys in rows:
            for k in set(keys):
                n[k] = n.get(k, 0) + 1
        return {k for k, c in n.items() if c >= html_text.LEAST_PAGES}

    recurring = often(p.keys(h).tolist() for h, p in distinct)
    there = lambda p, h, some: p.spans()[[k in some for k in p.keys(h).tolist()]]
    found = often([k for k in p.keys(h).tolist() if k in recurring] for h, p in distinct if html_text.covered(there(p, h, recurring), p.weights()) is not None)
    out = []
    for page, host in parsed:
        gone = html_text.covered(there(page, host, found), page.weights()) if page.subtrees else None
        out.append(page.text(np.zeros(len(page.blocks), bool) if gone is None else gone))
    return out


def test_html_against_brute_force(spark):
    r = random.Random(6)
    menus = {h: f"<div><p>{words_of('menu', h)}</p><p>short {h}</p></div>" for h in range(3)}
    rows = []
    for i in range(150):
        h = r.randrange(3)
        body = "".join(f"<p>{words_of('p', r.randrange(60))}</p>" for _ in range(r.randint(0, 5)))
        rows.append((i, f"https://h{h}.example/{i}", f"<body>{menus[h] if r.random() < 0.8 else ''}<main>{body}{'<div class=by>Written by our staff</div>' if r.random() < 0.5 else ''}</main></body>"))
    rows += [(200 + i, *rows[0][1:]) for i in range(8)] + [(300, "https://h0.example/", "<p>" + "long words " * 20_000 + "</p>"), (301, None, "")]
    got = html_texts(spark, rows)
    want = brute_templates(rows)
    assert [got[i] for i, _, _ in rows] == want
    plain = [(lambda p: p.text(np.zeros(len(p.blocks), bool)))(html_text.Page(h)) for _, _, h in rows]
    assert sum(a != b for a, b in zip(want, plain, strict=True)) > 30  # templates decide


def test_toxicity(spark):
    clean = texts(200, 60)
    toxic = [(1000 + i, " ".join(random.choice(V) for _ in range(40)) + " grumble snarl " + " ".join(random.choice(V) for _ in range(5)) + " snarl") for i in range(90)]
    known = labels(spark, [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic])
    rows = toxicity.assess(frame(spark, clean + toxic + ODD), known).collect()
    assert sum(r.toxic != (r.doc_id is not None and r.doc_id >= 1000) for r in rows) <= 2 and len(rows) == 290 + len(ODD)
    assert all(0 <= r.toxicity <= 1 for r in rows) and all(r.passages for r in rows if r.toxic)
    assert {r.toxicity for r in toxicity.assess(frame(spark, clean), labels(spark, [])).collect()} == {0.0}
    assert toxicity.assess(frame(spark, []), known).count() == 0


def test_toxicity_of_many_mild_words(spark):
    r, mild = random.Random(5), V[:60]
    say = lambda share, n: " ".join(r.choice(mild) if r.random() < share else r.choice(V[60:140]) for _ in range(n))
    clean, toxic = [(i, say(0.3, 40)) for i in range(300)], [(1000 + i, say(0.65, 40)) for i in range(150)]
    new = [(5000, say(0.65, 300)), (5001, say(0.3, 300)), (5002, f"{say(0.0, 100)} {say(1.0, 60)} {say(0.0, 100)}")]
    docs, known = frame(spark, clean + toxic + new), labels(spark, [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic])
    table = toxicity.fit(docs, known).table
    assert max(table.weights(V).values()) < 1.5 and min(table.weights(V).values()) < -0.2  # no single word is clear evidence
    got = {x.doc_id: x for x in toxicity.assess(docs, known).collect()}
    assert got[5000].toxic and not got[5001].toxic and sum(got[i].toxic != (i >= 1000) for i, _ in clean + toxic) < 45
    assert [(95 < p.first < 105, 155 < p.last < 165) for p in got[5002].passages] == [(True, True)]  # clean words end it


def test_segments_are_the_maximal_ones():
    def brute(s):  # the recursive definition
        best, at = 0, None
        for i in range(len(s)):
            total = 0
            for j in range(i, len(s)):
                total += s[j]
                if total > best + 1e-12:
                    best, at = total, (i, j)
        if at is None:
            return []
        i, j = at
        return brute(s[:i]) + [(i, j)] + [(a + j + 1, b + j + 1) for a, b in brute(s[j + 1 :])]

    m = toxicity.Model({"p": 0.3537, "q": 1.0713})  # no sums of these tie
    for _ in range(200):
        words = [random.choice("ppqnnnnnnn") for _ in range(random.randint(0, 25))]
        s = [m.weights.get(w, -toxicity.DRIFT) for w in words]
        assert [(a, b) for a, b, _ in m.segments(words)] == brute(s)


def test_ties_and_repeated_rows(spark):
    """Segments of equal scores are all reported; rows of one text get one verdict, whatever their ids."""
    m = toxicity.Model({"p": 1.0})
    assert [(a, b) for a, b, _ in m.segments(["p", *["n"] * 30, "p", *["n"] * 30, "p"])] == [(0, 0), (31, 31), (62, 62)]
    assert m.evidence([2.0, 2.0], 10) == m.evidence([2.0, 2.0][::-1], 10)
    rows = texts(40, 30)
    rows += [(1000 + i, t) for i, t in rows] + [(None, t) for _, t in rows[:5]]
    known = labels(spark, [(i, 1, i % 2) for i in range(40)])
    docs = spark.createDataFrame([(*r, "a" if r[0] and r[0] % 2 else "b") for r in rows], "doc_id long, text string, lang string")
    for out, column in ((quality.assess(docs, known), "score"), (quality.assess(docs, known), "kept"), (toxicity.assess(docs, known), "toxicity"), (langid.identify(docs, langid.fit(docs)), "lang_score")):
        seen = {}
        for r in out.select("text", column).collect():
            assert seen.setdefault(r.text, r[column]) == pytest.approx(r[column], abs=1e-6)
    at = quality.assess(docs, known)
    assert at.filter("NOT base_failed AND kept <> (score >= -0.3)").count() == 0


def test_very_long_pages_are_archived(spark):
    r = random.Random(8)
    long = "<p>" + " ".join(r.choice(V) for _ in range(600_000)) + "</p>"
    rows = [(i, "u", f"{long if i in (3, 7) else 'x' * i}") for i in range(10)] + [(20, "u", long + "more")]
    got = {x.page_id: x for x in warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].record_type == "revisit" and got[3].refers_to == 7 and bytes(got[7].payload).decode() == long and got[20].full_length == len(long) + 4


def test_sharding(spark):
    rows = frame(spark, texts(300) + ODD).repartition(3)
    store = sharding.shard(rows, small=2000, fan_in=3, target=20000)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, rows.collect()))
    v = store.latest()
    store.append(rows.limit(5))
    assert store.read().count() == rows.count() + 5 and store.read(v).count() == rows.count()
    assert not store.versions.create(f"v{v['version']:08d}.json", b"{}")  # a version can't be written twice
    assert store.vacuum() == 0  # what is young may belong to an append that hasn't committed
    assert store.vacuum(older=0) > 0 and store.read().count() == rows.count() + 5
    assert sharding.shard(frame(spark, [])).read().collect() == []


def test_sharding_of_any_columns(spark):
    rows = spark.createDataFrame([(i, ["x" * 100] * 20, None if i % 2 else "t") for i in range(200)], "`a.b` long, `an array` array<string>, text string")
    store = sharding.ShardStore(spark, common.shared_path(spark, "shards"), rows.schema, small=20_000)
    store.append(rows)
    assert store.latest()["shards"] > 10  # nested values count by what they hold
    assert sorted(map(str, store.read().collect())) == sorted(map(str, rows.collect()))


def test_of_two_writers_one_commits(spark, tmp_path):
    local = files.Store(str(tmp_path))
    assert local.create("v1", b"a") and not local.create("v1", b"b") and local.read("v1") == b"a"
    assert local._renamed("v2", b"c") and not local._renamed("v2", b"d") and local.read("v2") == b"c" and local.names() == ["v1", "v2"]


def test_writers_of_one_store_both_end(spark):
    from threading import Thread

    rows = frame(spark, texts(40))
    store = sharding.ShardStore(spark, common.shared_path(spark, "shards"), rows.schema)
    threads = [Thread(target=store.append, args=(rows,)) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.latest()["version"] == 3 and store.read().count() == 120


def test_language(spark):
    a, b = ["lorem", "dolor", "amet", "sit"], ["þæt", "wæs", "god", "cyning"]
    rows = [(i, " ".join(random.choice(a if i % 2 else b) for _ in range(12)), "la" if i % 2 else "an") for i in range(200)] + [(i, t, None) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert sum(r.lang is not None and r.lang != r.lang_pred for r in got) <= 2 and len(got) == len(rows)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) and 0 <= r.lang_score <= 1 for r in got)
    none = docs.filter("false")
    assert langid.fit(none) is None and langid.identify(none, None).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_letters():
    assert [langid.has_letter(t) for t in (None, "", "½ ² 12", "_ 3", "a", "½é", "中", "ª")] == [False, False, False, False, True, True, True, True]


def test_network():
    r, h = np.random.default_rng(3), langid.HIDDEN
    windows = [bytes(r.integers(97, 123, r.integers(3, 20)).astype(np.uint8)) for _ in range(12)]
    net = langid.train(windows, [i % 3 for i in range(12)], ["a", "b", "c"])
    p = net.label([windows[0], windows[1] * 40])
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    assert np.allclose(net.label([windows[1] * 40])[0], p[1], atol=1e-5)  # neighbours and padding don't matter
    # the gradients are those that differences of the loss show
    x, mask = np.zeros((langid.WINDOW, 4), np.uint8), np.zeros((langid.WINDOW, 4), np.float32)
    for i in range(4):
        x[: len(windows[i]), i], mask[: len(windows[i]), i] = np.frombuffer(windows[i], np.uint8), 1
    y, w = np.array([0, 1, 2, 0]), np.ones(4, np.float32)
    net = langid.Network(["a", "b", "c"], *(r.normal(0, 0.4, s).astype(np.float32) for s in ((6 * h, 256), (6 * h, 2 * h), (3, 2 * h), (3, 1))))
    apart = np.tile(np.repeat(np.arange(2), h), 3)[:, None] == np.repeat(np.arange(2), h)[None]
    net.recur *= apart

    def loss():
        return float(-(np.log(net.probabilities(net.steps(x, mask)[0])[:, y, np.arange(4)] + 1e-12) * mask).sum() / mask.sum())

    grads = langid._gradients(net, x, mask, y, w, apart)
    for k, p in enumerate((net.table, net.recur, net.out, net.bias)):
        i = np.unravel_index(np.argmax(np.abs(grads[k])), p.shape)
        old, step = p[i].copy(), 5e-3
        p[i] = old + step
        up = loss()
        p[i] = old - step
        down = loss()
        p[i] = old
        assert grads[k][i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def components(rows):
    sets = []
    for _, t in rows:
        w = BLANK.findall(low(t))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    to = list(range(len(rows)))

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                to[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_set_join(spark):
    rows, hot = [], [random.choice(V) for _ in range(60)]
    for _ in range(25):
        base = [random.choice(V) for _ in range(random.choice([3, 5, 6, 8, 9, 12, 30, 60, 150]))]
        base = hot + base if random.random() < 0.4 else base
        for _ in range(random.choice([1, 1, 2, 3, 25])):
            w = list(base)
            for _ in range(random.choice([0, 1, 1, 2, 3])):
                w[random.randrange(len(w))] = random.choice(V)
            rows.append((len(rows), " ".join(w).upper() if random.random() < 0.3 else " ".join(w)))
    rows += ODD
    got = setjoin.join(frame(spark, rows)).collect()
    assert sorted(map(str, ((r.doc, r.n, r.component) for r in got))) == sorted(map(str, components(rows)))
    assert setjoin.join(frame(spark, [])).count() == 0


def variants(r, base, many, edits):
    """The base and texts that add, drop or change words of it."""
    out = [base]
    for k in range(many):
        w = list(base)
        for _ in range(r.randint(1, edits)):
            i, what = r.randrange(len(w) + 1), r.randrange(3)
            if what == 0 or i == len(w):
                w.insert(i, f"n{k}x{r.randrange(3)}")
            elif what == 1 and len(w) > 5:
                del w[i]
            else:
                w[i] = f"c{k}x{r.randrange(3)}"
        out.append(w)
    return out


def test_set_join_of_large_groups(spark):
    """Groups of 17 to 90 near copies, in all small bands and one beyond, each with words of its own."""
    r, groups = random.Random(21), []
    for g in range(90):
        base = [f"g{g}w{r.randrange(10_000)}" for _ in range(r.choice([8, 9, 10, 10, 11, 12, 14, 17, 22, 30, 45, 66, 120]))]
        groups.append([" ".join(w) for w in variants(r, base, r.randint(16, 90), r.choice([1, 1, 2, 3, 6]))])
    rows, want = [], []
    for texts_of in groups:
        mine = [(len(rows) + k, t) for k, t in enumerate(texts_of)]
        rows += mine
        want += components(mine)
    got = setjoin.join(frame(spark, rows)).collect()
    assert sorted((x.doc, x.n, x.component) for x in got) == sorted(want)


def test_set_join_of_a_text_and_its_extensions(spark):
    base = " ".join(f"e{i}" for i in range(10))
    rows = [(0, base)] + [(1 + i, f"{base} more{i}") for i in range(40)]
    assert {x.component for x in setjoin.join(frame(spark, rows)).collect()} == {0}


def test_set_join_when_groups_outgrow_blocks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    monkeypatch.setattr(setjoin, "PART", 20)
    monkeypatch.setattr(setjoin, "SMALL", 3)
    r = random.Random(4)
    passage = [f"p{i}" for i in range(50)]
    rows = [(i, " ".join(passage + [f"q{i}y{k}" for k in range(r.randint(0, 12))])) for i in range(60)]
    chain = [f"k{i}" for i in range(60)]
    rows += [(100 + i, " ".join(chain[: 60 - i] + [f"z{k}" for k in range(i)])) for i in range(50)]
    got = setjoin.join(frame(spark, rows)).collect()
    assert sorted((x.doc, x.n, x.component) for x in got) == sorted(components(rows))


def test_every_linked_pair_meets_in_one_signature():
    """The guarantee itself: sets of 0.8 share a signature at the level that either of both stops at."""
    r = random.Random(9)
    for n in [*range(4, 70), 90, 150, 400]:
        for _ in range(30):
            x = {r.getrandbits(63) for _ in range(n)}
            d = (2 * n + 2 * n // 8) // 9
            y = set(x)
            for _ in range(r.randint(1, max(1, d))):
                if r.random() < 0.5 and len(y) > 1:
                    y.discard(r.choice(sorted(y)))
                else:
                    y.add(r.getrandbits(63))
            if 5 * len(x & y) < 4 * len(x | y) or x == y:
                continue
            sx, sy = (setjoin.signatures(np.array(sorted(s), np.uint64)) for s in (x, y))
            met = [s for bx, lx, _, a in sx for by, ly, _, b in sy if bx == by for s in np.intersect1d(a, b).tolist() if s >> 18 & 7 == min(lx, ly) or s & 0xFFF == 0xFFF]
            assert met, (n, len(y))


def test_sketch_bounds_the_difference():
    for _ in range(100):
        a = np.unique(np.array([random.getrandbits(64) for _ in range(random.randint(1, 300))], np.uint64))
        b = np.unique(np.append(a[: random.randint(1, len(a))], np.array([random.getrandbits(64) for _ in range(random.randint(0, 200))], np.uint64)))
        assert setjoin.least_difference(setjoin.sketch(a), setjoin.sketch(b)) <= len(np.setxor1d(a, b))


def test_pieces(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("piece_bpe_32k.model")
    lib = pieces.model(path).library
    letters = "ab  ▁é日𝕏\n\t.,!(){}_0 1Ñ́\xa0　\r\x00thTheing   <s>"
    rows = texts(30) + ODD + [(2000 + i, "".join(random.choice(letters) for _ in range(random.randint(0, 90)))) for i in range(400)]
    for r in pieces.round_trip(frame(spark, rows), path).collect():
        assert r.piece_ids == [*lib.encode(r.text or ""), lib.eos_id()] and r.decoded == lib.decode(r.piece_ids)
    assert pieces.round_trip(frame(spark, [], "decoded string"), path).count() == 0


def test_language_model(spark):
    rows = texts(120, 30) + ODD
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    learn = [(i, t) for i, t in rows if not held(i)]
    model = kneser_ney.fit(frame(spark, learn))
    out = kneser_ney.score(frame(spark, rows), model).collect()
    tok = lambda t: BLANK.findall(low(t)) + ["</s>"]
    one_count, two_count = Counter(), Counter()
    for _, t in learn:
        one_count.update(tok(t))
        two_count.update(zip(["<s>", *tok(t)], tok(t), strict=False))
    n, v = sum(one_count.values()), len(one_count)
    before, total, kinds = Counter(w for _, w in two_count), Counter(), {}
    for (u, _), c in two_count.items():
        total[u] += c
        kinds.setdefault(u, [0, 0, 0])[min(c, 3) - 1] += 1
    count = lambda xs: [sum(x == k for x in xs) for k in (1, 2, 3, 4)]
    d2, d1 = kneser_ney.discounts(count(two_count.values())), kneser_ney.discounts(count(before.values()))
    left = sum(d1[min(c, 3) - 1] for c in before.values()) / len(two_count)
    one = lambda w: (max(before[w] - d1[min(before[w], 3) - 1], 0) if before[w] else 0) / len(two_count) + left / (v + 1)

    def two(u, w):
        if not total[u]:
            return one(w)
        c = two_count[u, w]
        return (max(c - d2[min(c, 3) - 1], 0) if c else 0) / total[u] + sum(x * y for x, y in zip(d2, kinds[u], strict=True)) / total[u] * one(w)

    assert model.tokens == n and model.types == v and len(out) == len(rows)
    assert sum(two(V[0], w) for w in one_count) + two(V[0], "?unknown") == pytest.approx(1)
    for r in out:
        w = tok(r.text)
        assert r.n_tokens == len(w) and r.n_known == sum(one_count[x] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10((one_count[x] + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(two(u, x)) for u, x in zip(["<s>", *w], w, strict=False)))
    none = kneser_ney.fit(frame(spark, []))
    assert [r.score for r in kneser_ney.score(frame(spark, rows[:2]), none).collect()] == [0.0, 0.0]


def test_blocks_and_slices_of_ngrams():
    r = np.random.default_rng(2)
    for n in (0, 1, 3000):
        columns = [np.sort(r.integers(0, 1 << 40, n)).astype(np.uint64), r.integers(0, 300, n).astype(np.uint64), r.integers(0, 1 << 62, n)]
        assert all((a == b).all() for a, b in zip(kneser_ney.load(kneser_ney.dump(columns)), columns, strict=True))
        key, first, sums = kneser_ney.summed(columns[1], columns[1].astype(np.int64) + 1)
        assert key.tolist() == sorted(set(columns[1].tolist())) and (columns[1][first] == key).all() and sums.sum() == columns[1].sum() + n
    g = np.unique(r.integers(0, 2**64, 20_000, np.uint64))
    c = r.choice([1, 1, 1, 2, 255, 256, 1 << 40], len(g))
    file = np.frombuffer(kneser_ney._gram_file(g, [c, c // 2]), np.uint64)
    ask = np.concatenate([g[::3], r.integers(0, 2**64, 5000, np.uint64)])
    out = np.zeros((2, len(ask)), np.int64)
    kneser_ney.Slice(file, 2).facts(ask, out)
    want = dict(zip(g.tolist(), c.tolist(), strict=True))
    assert out[0].tolist() == [want.get(x, 0) for x in ask.tolist()]
    assert all(b == want[x] // 2 for x, b in zip(ask.tolist(), out[1].tolist(), strict=True) if want.get(x, 1) > 1)


@pytest.mark.parametrize("pieces_of", [0, 37])
def test_language_model_of_order_three(spark, monkeypatch, pieces_of):
    monkeypatch.setattr(kneser_ney, "SLICE", 150)  # several slices
    monkeypatch.setattr(kneser_ney, "WORDS", 100)
    monkeypatch.setattr(kneser_ney, "CHUNK", 500)
    if pieces_of:  # as if no chunk's words fitted side by side
        monkeypatch.setattr(kneser_ney, "fits", lambda most, columns: False)
        monkeypatch.setattr(kneser_ney, "PIECE", pieces_of)
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(V[:9]) for _ in range(r.randint(0, 30)))) for i in range(90)] + ODD[:4]
    learn = rows[:70] + ODD[:3]
    model = kneser_ney.fit(frame(spark, learn), order=kneser_ney.ORDER)
    tok = lambda t: BLANK.findall(low(t)) + ["</s>"]
    grams = lambda t: list(zip(["<s>", "<s>", *tok(t)], ["<s>", *tok(t)], tok(t), strict=False))
    three = Counter(g for _, t in learn for g in grams(t))
    two = Counter(g[1:] for g in three)  # distinct words before
    one = Counter(g[1] for g in two)
    v = len({g[2] for g in three})
    count = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    d = {k: kneser_ney.discounts(count(c)) for k, c in ((3, three), (2, two), (1, one))}

    def p(context, w):
        c = {2: three, 1: two, 0: one}[len(context)]
        below = p(context[1:], w) if context else 1 / (v + 1)
        mine = {g: x for g, x in c.items() if not context or g[:-1] == context}
        cut = d[len(context) + 1]
        x = c[(*context, w) if context else w]
        return (max(x - cut[min(x, 3) - 1], 0) * (x > 0) + sum(cut[min(x, 3) - 1] for x in mine.values()) * below) / sum(mine.values()) if mine else below

    assert model.order == 3 and model.slices > 1 and model.words.slices > 1
    assert sum(p((V[0], V[1]), w) for w in {g[2] for g in three} | {"?unknown"}) == pytest.approx(1)
    for x in kneser_ney.score(frame(spark, rows), model).collect():
        assert x.score == pytest.approx(sum(math.log10(p(g[:2], g[2])) for g in grams(x.text)))
    alone = kneser_ney.fit(frame(spark, [(1, "a b a")]), order=3)  # both starts are a context met once
    first, left = np.array([alone.types], np.uint64), alone.open()
    two = kneser_ney.pair(first, first)
    assert left.counts("contexts", left.slot(two), two, 4)[:, 0].tolist() == [1, 1, 0, 0]
    none = kneser_ney.fit(frame(spark, []), order=3)
    assert [x.score for x in kneser_ney.score(frame(spark, rows[:2]), none).collect()] == [0.0, 0.0]


def test_warc(spark):
    big = "<p>" + "y" * 1200 + "</p>"
    rows = [(i, f"http://a/{i}", f"<p>{' '.join(random.choice(V) for _ in range(50))}</p>") for i in range(80)]
    rows += [(100, "http://b", big), (101, None, big), (102, "http://c", big), (103, "http://d", "short"), (104, "http://e", "short"), (105, "x", None), (106, "x", ""), (None, "n", big), (102, "http://c", big)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        full = next(h or "" for i, _, h in rows if i == r.page_id).encode()
        assert r.payload_digest == hashlib.sha1(full).hexdigest() and r.full_length == len(full)
        revisit = full == big.encode() and r.page_id != 102
        assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == (102 if revisit else None)
        assert bytes(r.payload) == (b"" if revisit else full)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "SMALL", 2)
    monkeypatch.setattr(warc, "SHARE", 3)
    big = [f"<p>{'z' * 1200}{k}</p>" for k in range(8)]
    rows = [(i, f"http://a/{i}", big[0]) for i in range(60)] + [(100 + i, "u", big[1 + i % 7]) for i in range(21)] + [(None, "n", big[3]), (200, None, "short")]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    last = {}
    for i, _, h in rows:
        last[h] = max(last.get(h, -1), -1 if i is None else i)
    want = sorted((str(i), len(h) >= 1000 and i != last[h], last[h] if len(h) >= 1000 and i != last[h] else None) for i, _, h in rows)
    assert sorted((str(r.page_id), r.record_type == "revisit", r.refers_to) for r in got) == want


def test_dictionary_leads_the_archive():
    records = [warc.record(i, "http://x/y", f"<html><body>{random.random()} common boilerplate text {i}</body></html>".encode() * 3, "0" * 40, "response", None) for i in range(200)]
    data = warc.pack(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and list(warc.unpack(data)) == records
    assert list(warc.unpack(warc.pack(records[:2]))) == records[:2]


def test_large_and_few_records_have_a_dictionary():
    r = random.Random(4)
    page = lambda i, n: warc.record(i, "http://x/y", f"<html><body>{' '.join(r.choice(V) for _ in range(n))}</body></html>".encode(), "0" * 40, "response", None)
    for records in ([page(i, 40_000) for i in range(20)], [page(i, 300) for i in range(100)] + [page(100, 4_000_000)], [page(i, 2_000) for i in range(4)]):
        data = warc.pack(records)
        assert int.from_bytes(data[4:8], "little") > 0 and list(warc.unpack(data)) == records


def test_winnowing(spark):
    items = [(i, " ".join(random.choice(V) for _ in range(random.choice([3, 9, 10, 11, 30])))) for i in range(25)] + [(30, None), (31, ""), (32, "z"), (33, "q q q q q q q q q q q q")]
    docs = texts(60, 80)
    for i in range(60):
        w = random.choice(items[:25])[1].split()
        a = random.randrange(len(w))
        docs.append((100 + i, " ".join([random.choice(V) for _ in range(random.randint(0, 30))] + w[a : a + random.randint(1, 30)] + [random.choice(V) for _ in range(5)]).title()))
    docs += [*ODD, (800, "q " * 15), (801, "a, z: b"), (802, items[4][1] + " " + items[4][1])]
    docs += [(7, items[4][1]), (None, items[5][1]), (None, "another row without an id"), (7, items[4][1])]  # rows of one id are judged apart
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = frame(spark, docs).withColumn("same", winnow.same_text(F.col("text")))
    got = {(r.doc_id, r.text): r for r in rows.join(winnow.contamination(frame(spark, docs), bench), "same").collect()}
    word, wins = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {}
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    for i, t in docs:
        w, hit, found = word.findall(low(t)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if x := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        if hit:
            assert (got[i, t].n_hit, sorted(got[i, t]["items"])) == (len(hit), sorted(found))
        else:
            assert (i, t) not in got
    left = winnow.screen(frame(spark, docs), bench)
    assert left.count() == sum((i, t) not in got for i, t in docs) and left.columns == ["doc_id", "text", "text_"]
    assert winnow.contamination(frame(spark, []), spark.createDataFrame([], "item_id long, text string")).count() == 0
