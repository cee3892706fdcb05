"""Resampling, periodic runs and HTML extraction against plain loops, and on edge rows."""

import html
import re
from collections import Counter
from hashlib import sha256
from math import floor, log
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptledger.llm import html_text, periodic, queries, resampling

LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(40_000))
EDGES = [(1, "a b\nc"), (1, "a b\nc"), (2, None), (3, ""), (4, " \n\t "), (None, "no id here"), (None, "no id here"), (None, None), (5, LONG), (6, "É é ß \x85日本\nÀ-b C3" * 9), (7, "go " * 30), (8, "\n\n" + "x y z\n" * 12), (9, "!?\n--")]
CLASHING = ("k1", "k2", "h1", "h2", "n", "line", "gain", "copies", "part", "place", "start", "rank", "weight", "runs", "length", "period", "words", "_best", "n_words", "host", "winners", "same", "_host", "_won", "pages", "path", "score")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, *["clash"] * len(CLASHING)) for i, t in EDGES], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [crc32(x.encode()) % 10000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def resampled(docs, texts, percent=25, least=20):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x))
    for x in texts:
        t.update(features(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [floor(1000 * log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, x in docs:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= 2 * least - 1), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted(((*r, rank.get(id(r))) for r in rows), key=repr)


def test_op11(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    texts = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = queries.QUERIES["op11_resampling"](spark, small)
    assert dict(got.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled(docs, texts)


def test_op11_edges(spark, edges):
    target = spark.createDataFrame([("go to the house",), (None,), ("x y\nz a b",), ("",)], "text string")
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    got = [tuple(r) for r in resampling.scored(edges, target).select(names).collect()]
    assert sorted(got, key=repr) == resampled(EDGES, [r.text for r in target.collect()])
    half = resampling.scored(edges, target, percent=50, least_words=3).select(names).collect()
    assert sorted(map(tuple, half), key=repr) == resampled(EDGES, [r.text for r in target.collect()], 50, 3)
    kept = resampling.resample(edges, target, percent=100)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} == {5, 6, 7, 8} and all(r[c] == "clash" for r in kept.collect() for c in CLASHING)
    assert resampling.scored(edges.limit(0), target).collect() == [] == resampling.resample(edges.limit(0), target.limit(0)).collect()


def test_op11_lines_are_counted_once(spark):
    """A hot line is one row of the counted lines; its features are counted as often as it occurs."""
    docs = spark.createDataFrame([(k, f"the same line of all\nown{k} words\nthe same line of all") for k in range(300)], "doc_id long, text string")
    rows = resampling._named(docs)
    lines = resampling.counted_lines(rows, 10000).collect()
    assert sorted(r.n for r in lines)[-2:] == [1, 600] and len(lines) == 301
    found = resampling.totals([resampling.counted_lines(rows, 10000), resampling.crossed_rows(rows, 10000)], 10000)
    want = Counter(b for r in docs.collect() for b in features(r.text))
    assert {b: n for b, n in enumerate(found.tolist()) if n} == dict(want)


def runs_loop(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        s = 0
        while s < n - q:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            size = e + q - s if e > s else 0
            if size >= max(6, 4 * q) and not any(all(words[s + k] == words[s + k + d] for k in range(size - d)) for d in range(1, q)):
                out.append((s, size, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_squares_and_stretches_equal_a_loop():
    rng = np.random.default_rng(12)
    for _ in range(1500):
        w = rng.integers(0, rng.integers(1, 6), rng.integers(0, 60)).tolist()
        if len(w) > 3 and rng.random() < 0.6:
            a, p = int(rng.integers(len(w))), int(rng.integers(1, 7))
            w = [w[i] if i < a or a + (i - a) % p >= len(w) else w[a + (i - a) % p] for i in range(len(w))]
        if rng.random() < 0.3:
            w = w + w[:3] + w * 4
        assert periodic.squares(w) == {(s, q): s + n for s, n, q in runs_loop(w)}
        text = " ".join(map(str, w)).encode()
        want = {k: runs_loop(t.decode().split()) for k, t in enumerate((text, b"one two " + text, text)) if runs_loop(t.decode().split())}
        assert periodic.runs_in([text, b"one two " + text, text]) == want


def periodic_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_loop(words) if len(words) < 3000 else []
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    hashed = lambda x: sha256(x.encode()).hexdigest()
    numbers = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *numbers, hashed("".join(f"{s},{size},{q}\n" for s, size, q in runs)), hashed(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_periodic_runs"](spark, small)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = {d for d, t in docs if len((t or "").split()) < 3000}
    rows = sorted(tuple(r) for r in got.collect() if r.doc_id in short)
    assert rows == sorted(periodic_digest(d, t) for d, t in docs if d in short) and sum(r[1] for r in rows) > 3


def test_op12_edges(spark, edges):
    got = periodic.digest(periodic.periodic_runs(edges, periodic.tail_repeated)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((periodic_digest(d, t) for d, t in EDGES), key=repr)
    whole = {r.doc_id: r for r in periodic.periodic_runs(edges).collect()}
    assert whole[7].collapsed_text == "go" and [tuple(r) for r in whole[7].runs] == [(0, 30, 1)] and whole[8].collapsed_text == "x y z" and whole[2].n_words == 0
    assert periodic.periodic_runs(edges.limit(0)).collect() == []


def test_long_run_is_not_quadratic():
    for w in ([0] * 30_000, [k % 700 for k in range(30_000)]):
        assert list(periodic.squares(w).values()) == [30_000]


def article_loop(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in blocks if x)


def test_op13(spark, small):
    got = queries.QUERIES["op13_html_text"](spark, small).collect()
    want = {r.page_id: (r.url, article_loop(r.html)) for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), ("plain <b>te</b>xt &amp; more", "plain text & more"), ("<p>a<p>b", "a\nb"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<p>x&nbsp;&nbsp;y\n\t z &#x41;&lt;b&gt;</p>", "x y z A<b>"),
        ("<SCRIPT>if(a<b) x='</p>'</script ><p>ok<script>never closed <p>x", "ok"), ("<p>a <!-- c > --> b</p><!-- open <p>gone", "a b"), ("<p>Text <span class=ad>buy <i>me</i></span>here.</p>", "Text here."),
        ("<form><div><article><p>In a form.</p></article></div></form>", "In a form."), ("<textarea><p>no</p></textarea><p>yes</p>", "yes"), ("<pre>a\n b</pre><table><tr><td>c1<td>c2<tr><td>c3</table>", "a b\nc1\nc2\nc3"),
        ("<nav><ul><li><a>m</a><article><p>Body of it.</p></article><section class=comments><article><p>Nice post!</p></article></section>", "Body of it."),
        ("<article><header><h1>Head</h1><p>by me</p></header><p>T.</p><aside>x</aside><form><input>q</form></article><header><h1>Site</h1></header>", "Head\nT."),
        ("<div id=cookie-notice>We use cookies.</div><div class=c1><h1>T</h1><p>One two three.</p><ul><li>x<li>y</ul></div><div class=sidebar><p>Hi there you.</p></div>", "T\nOne two three.\nx\ny"),
        ("<div class='content with-sidebar'><p>Whole text.</p></div><div style='display: none'><p>Hidden text here.</p></div>", "Whole text."),
    ],
)
def test_one_page(page, text):
    assert html_text.extract(page, [], []) == text


def test_host_consensus(spark):
    """A page whose own best container is another follows its host; what all pages say alike is no article."""
    page = lambda k, body, more="": f"<div class='y'>{'We do this on every page and say it at length. ' * 9}</div><div class='x{k}'><h1>Title {k}.</h1><p>{body}</p><div class='q7'>Read our terms before you go.</div></div><div class='z'>{more}</div>"
    bodies = ["A long text about something. " * 20 + str(k) for k in range(6)] + ["Short."]
    rows = [(k, f"https://a.example/{k}", page(20 + k, b, "Seen elsewhere today. " * 9 + str(k) if k == 6 else "")) for k, b in enumerate(bodies)]
    rows += [(7, "https://a.example/7", "<article><p>Another template.</p></article>"), (8, None, page(1, "No host.")), (9, "nothing", None), (10, "https://b.example/", "")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, _host int")
    got = {r.page_id: r for r in html_text.main_text(pages).collect()}
    want = {k: f"Title {20 + k}.\n" + " ".join(b.split()) for k, b in enumerate(bodies)}
    assert {k: got[k].text for k in range(7)} == want and got[7].text == "Another template." and (got[9].text, got[10].text) == ("", "")
    assert set(got[0].asDict()) == {"page_id", "url", "html", "text", "_host"} and got[0]["_host"] == 1
    best = html_text.winning_paths(pages.selectExpr("case when url like '%://a.%' then 'a.example' else '' end as host", "html")).collect()
    assert [(r.host, r.pages, r.winners[0], r.same) for r in best] == [("a.example", 8, ">div.x#", [">div.x#>div.q#"])]
    assert html_text.main_text(pages.limit(0)).collect() == []


def test_winners_by_shuffle(spark, small, monkeypatch):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    want = {(r.page_id, r.text) for r in html_text.main_text(pages).collect()}
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(html_text, "MOST_HOT", 10)
    assert {(r.page_id, r.text) for r in html_text.main_text(pages).collect()} == want
