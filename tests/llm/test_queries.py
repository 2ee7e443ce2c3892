"""Every registered query on small tables: the digest columns of its contract against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from foliant.llm import html_text, quality, queries

from test_operators import ODD, brute_templates, components, low

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, d = random.Random(31), str(tmp_path_factory.mktemp("sf"))
    v = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(r.choice(v) for _ in range(n))
    docs = [(i, say(r.randint(1, 60))) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " end") for i in range(10)] + [(120 + i, f"{say(20)} vile scum {say(3)} scum") for i in range(30)] + ODD + [(910, "½ ² 3"), (911, "A B\nA B\n\n#|"), (912, docs[3][1])]
    items = [(1, docs[2][1]), (2, say(4)), (10, say(40)), (None, say(12)), (3, None)]
    docs.append((913, f"x {items[2][1]} y {items[1][1]} z"))
    big = "<main><p>" + "long text " * 200 + "</p></main>"
    pages = [(i, f"https://h.example/{i}", f"<div><p>menu</p></div><main><p>{say(30)}</p></main>") for i in range(12)] + [(50, "u", big), (51, None, big), (52, "v", None), (53, "w", "short"), (54, "w", "short")]
    spark.createDataFrame([(*x, "l1" if "w1" in (x[1] or "") else "l2", "s", 1) for x in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(120 <= i < 150)) for i, _ in docs if i is not None and i < 150], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d, docs, items, pages


def rows(spark, tables, name, *columns):
    return sorted(tuple(map(str, x)) for x in queries.Q[name](spark, tables[0]).select(*columns).collect())


def shown(want):
    return sorted(tuple(map(str, x)) for x in want)


def held(i, n, k):
    return i is not None and zlib.crc32(str(i).encode()) % n == k


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_op1(spark, tables):
    want = []
    for i, t in tables[1]:
        w = BLANK.findall(t or "")
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen, cover = Counter(wins), set()
        for k, x in enumerate(wins):
            if seen[x] > 1:
                cover.update(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if BLANK.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    assert rows(spark, tables, "op1_quality", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == shown(want)
    assert not queries.Q["op1_quality"](spark, tables[0]).filter("base_failed AND kept").count()


def test_op1_scores(spark, tables):
    """Weights and verdicts again in plain Python, over the buckets that Spark's hash gives."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    labels = spark.read.parquet(f"{tables[0]}/labels.parquet")
    bags = [(x.doc_id, list(x.f)) for x in docs.select("doc_id", quality.features(quality.token_hashes(docs.text)).alias("f")).collect()]
    good = {x.doc_id for x in labels.filter("quality = 1").collect()}
    raw, target = Counter(b for _, f in bags for b in f), Counter(b for i, f in bags if i in good for b in f)
    n, m, p = raw.total(), target.total(), quality.PRIOR
    weight = {b: math.log((target[b] + p * c / n) / (m + p) / (c / n)) for b, c in raw.items()}
    want = sorted((str(i), round(sum(weight[b] for b in f) / len(f), 4) if f else None) for i, f in bags)
    got = sorted((str(x.doc_id), x.score and round(x.score, 4)) for x in queries.Q["op1_quality"](spark, tables[0]).collect())
    key = lambda x: (x[0], x[1] is None, x[1] or 0)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[0] == b[0] and (a[1] or 0) == pytest.approx(b[1] or 0, abs=2e-4)
    kept = {x.doc_id for x in queries.Q["op1_quality"](spark, tables[0]).filter("kept").collect()}
    assert kept == {x.doc_id for x in quality.assess(docs, labels).filter(f"NOT base_failed AND score >= {quality.LEAST}").collect()}


def test_op1_computes_once(spark, tables):
    """A filter on the verdict isn't pushed into the expressions behind it."""
    kept = quality.assess(spark.read.parquet(f"{tables[0]}/documents.parquet"), spark.read.parquet(f"{tables[0]}/labels.parquet")).filter("kept").select("doc_id")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_op2(spark, tables):
    got = {x.page_id: (x.url, x.text, x.n_chars) for x in queries.Q["op2_html_text"](spark, tables[0]).collect()}
    want = brute_templates(tables[3])
    assert got == {i: (u, t, len(t)) for (i, u, _), t in zip(tables[3], want, strict=True)}
    assert got[0][1] and "menu" not in got[0][1] and html_text.LEAST_PAGES <= 12


def test_op3(spark, tables):
    assert rows(spark, tables, "op3_toxicity", "doc_id", "held_out") == shown((i, held(i, 3, 1)) for i, _ in tables[1])
    out = queries.Q["op3_toxicity"](spark, tables[0]).collect()
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in out)
    assert sum((x.doc_id is not None and 120 <= x.doc_id < 150) != x.predicted for x in out) <= 4


def test_op4(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").collect()
    assert rows(spark, tables, "op4_sharding", "doc_id", "lang", "source", "n_chars", "text_sha256") == shown((x.doc_id, x.lang, x.source, x.n_chars, None if x.text is None else sha(x.text)) for x in docs)


def test_op5(spark, tables):
    assert rows(spark, tables, "op5_langid", "doc_id", "held_out") == shown((i, held(i, 3, 1)) for i, _ in tables[1])
    for x in queries.Q["op5_langid"](spark, tables[0]).collect():
        texts = [t for i, t in tables[1] if i == x.doc_id]
        assert (x.lang_pred == "und") == (not any(c.isalpha() for c in texts[0] or "")) and 0 <= x.score <= 1


def test_op6(spark, tables):
    assert rows(spark, tables, "op6_setjoin", "doc_id", "n_shingles", "component_id") == shown(components(tables[1]))


def test_op7(spark, tables):
    pytest.importorskip("public_tokenizers")
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    want = []
    for i, t in tables[1]:
        ids = [*lib.encode(t or ""), lib.eos_id()]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))))
    assert rows(spark, tables, "op7_pieces", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == shown(want)


def test_op8(spark, tables):
    tok = lambda t: [*BLANK.findall(low(t)), "</s>"]
    count = Counter(w for i, t in tables[1] if not held(i, 7, 2) for w in tok(t))
    n, v = count.total(), len(count)
    want = {}
    for i, t in tables[1]:
        w = tok(t)
        want[str(i), len(w)] = (held(i, 7, 2), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
    out = queries.Q["op8_kneser_ney"](spark, tables[0]).collect()
    assert len(out) == len(tables[1])
    for x in out:
        a, b, c, base = want[str(x.doc_id), x.n_tokens]
        assert (x.held_out, x.n_known, x.train_tokens) == (a, b, c) and x.base_score == pytest.approx(base) and x.score < 0


def test_op9(spark, tables):
    data = [(i, (h or "").encode()) for i, _, h in tables[3]]
    last = {}
    for i, b in data:
        last[b] = max(i, last.get(b, i))
    again = lambda i, b: len(b) >= 1000 and i != last[b]
    want = [(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again(i, b) else "response", last[b] if again(i, b) else None) for i, b in data]
    assert rows(spark, tables, "op9_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == shown(want)


def test_op10(spark, tables):
    wins = {}
    for i, t in tables[2]:
        w = ITEM.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = []
    for i, t in tables[1]:
        w, hit, found = ITEM.findall(low(t)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if x := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x - {None}
        want.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    assert rows(spark, tables, "op10_winnow", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == shown(want)
