"""Hard negatives, HTML extraction and collocations: against plain loops, on odd rows, and where their parts can go two ways."""

import re
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest

from tapeloom.llm import collocations, hard_negatives, html_text
from tapeloom.llm import queries as q
from tests.conftest import DATA

# --- op11 ------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, score string, row string"


def mined(rows):
    live = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, v, label, *_ in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, label, v) in enumerate(live):
        if i % 50:
            continue
        near = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, own == label) for b, (j, own, w) in enumerate(live) if b != a and len(w) == len(v))
        for p, j, _ in [x for x in near if x[2]][:5]:
            inside = [(s, k) for s, k, same in near if not same and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(i, j, rank + 1, k, -p, -s) for rank, (s, k) in enumerate(inside[:3])]
    return sorted(out)


def some_vectors(n, seed=3):
    pick = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(pick.normal(size=4), 1)], int(pick.integers(0, 3)), "s", "r") for i in range(n)]
    return rows + [
        (50, [0.5, 0.5, 0.0, 0.0], 1, None, None), (50, [0.5, 0.5, 0.0, 0.0], 1, None, None), (7, None, 1, None, None), (8, [1.0, None, 0.0, 0.0], 1, None, None), (100, [1.0, 2.0, 3.0, 4.0], None, None, None),
        (None, [1.0, 2.0, 3.0, 4.0], 1, None, None), (150, [float("nan"), 0.0, 0.0, 0.0], 1, None, None), (200, [1.0, 1.0], 1, None, None), (201, [1.0, 1.0], 1, None, None), (202, [0.9, 0.9], 2, None, None), (250, [], 1, None, None), (251, [], 2, None, None),
        (300, [0.0, 0.0, 0.0, 0.0], 0, None, None),
    ]


@pytest.mark.parametrize("block", [4096, 7])
def test_hard_negatives_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block // 2 + 1)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", block)
    rows = some_vectors(320)
    got = sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, VECTORS)).collect()))
    assert got == mined(rows) and got
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0


def test_keys_and_products():
    score, ids = np.array([5, -3, 5, 0, 1 << 40]), np.array([9, -1, 2, 0, 7])
    keys = hard_negatives.pack(score, 0, ids) + hard_negatives.pack(score, 1, ids)
    assert [*zip(*hard_negatives.unpack(sorted(keys)), strict=True)] == sorted(((s, k, i) for k in (0, 1) for s, i in zip(score.tolist(), ids.tolist(), strict=True)), key=lambda x: (-x[0], x[1], x[2]))
    big = np.array([[1 << 30, 3], [-(1 << 30), 1]])
    assert hard_negatives.inner(big, big).tolist() == [[(1 << 60) + 9, 3 - (1 << 60)], [3 - (1 << 60), (1 << 60) + 1]]
    huge = np.array([[(1 << 31) - 1] * 4])
    assert hard_negatives.inner(huge, -huge).tolist() == [[-((1 << 63) - 1)]]
    assert hard_negatives.first(np.array([1, 3, 3, 2, 3, 3, 0, 0, 0, 0, 0, 0, 0]), 3).tolist() == [1, 2, 4]


# --- op12 ------------------------------------------------------------------------------------------------------------


def text(html, template=frozenset()):
    return html_text.Page(html).extract(set(template))


def test_given_pages(spark):
    rows = {r.page_id: r for r in q.op12_html_text(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        want = "\n".join(x for x in (" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?p>|</?h1>", inner)) if x)
        assert (rows[r.page_id].text, rows[r.page_id].n_chars, rows[r.page_id].url) == (want, len(want), r.url)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""), ("<p>", ""), ("just text", "just text"), ("<article><p>a &amp; b&nbsp;&#8364; &am</article>", "a & b € &am"), ("<article><p>one<p>two<br>more</article><p>off", "one\ntwo more"),
        ("<article><h1>T</h1><script>var x='</p>'</script><style>p{}</style><p>x<!-- <p>no --> y</p><section class='comments'><p>nice</p></section></article>", "T\nx y"),
        ("<main><div class=cookie-notice>Cookies</div><article><header><h1>T</h1></header><p>Body<aside>side</aside></p><div class='adBox'>buy</div><form><label>mail</label></form><footer>f</footer></article></main>", "T\nBody"),
        ("<div role=banner>B</div><main><h2>T</h2><p title='a > b'>c</p><ul><li>x<li>y</ul></main>", "T\nc\nx\ny"),
        ("<form id=aspnet><div class=menu>m</div><article class='post has-sidebar'><p>in a form</p></article><article class=comment><p>a comment that is longer than the post</p></article></form>", "in a form"),
        ("<article><p>a<b>b</p><p>c</b>d</p><table><tr><td>1<td>2<tr><td>3</table>", "ab\ncd\n1\n2\n3"), ("<article><p>cut <a href='x", "cut"), ("<ARTICLE><P>Up</P></ARTICLE><script>never ends <p>x", "Up"), ("<article>" * 3 + "deep" + "</article>" * 2, "deep"),
        ("<body><nav><p>n</nav><h1>Title</h1><div><p>long enough text of the page</p></div><div id=footer>f</div>", "Title\nlong enough text of the page"),
    ],
)
def test_pages(html, want):
    assert text(html) == want


def test_odd_markup_ends():
    assert text("<div>" * 50_000 + "x" + "</span>" * 50_000) == "x"
    assert text("<article><p>a < b & c <3 </> <!x> <?y?> </ z>d</p></article>") == "a < b & c <3 d"
    assert text("<article>" + "<a title=\"" * 20_000) == ""
    long = "word " * 200_000
    assert text(f"<article><p>{long}</p></article>") == long.strip()


def site(n):
    """A site whose pages have no telling names: a bar, a block of links, an own text that ends in a sentence of all pages, a bar."""
    for k in range(n):
        own = " ".join(f"word{k}x{j}" for j in range(30))
        yield k, f"http://plain.example/{k}", f"<body><div><a href=/>Home</a><a href=/{k}>About us</a></div><div><div><h1>Page {k}</h1><p>{own}</p><p>All rights of this text are free.</p><p>And {own}</p></div><div>Like this? Tell others.</div></div><div>Made by Plain Inc.</div>"


def test_templates_of_a_site(spark):
    rows = [*site(12), *((100 + k, "http://copies.example/x", f"<body><div>Menu of copies</div><section><h1>Same</h1><div>{'the same article again and again ' * 5}</div></section>") for k in range(12))]
    rows += [(200, None, rows[0][2]), (201, "http://plain.example/null", None), (202, "http://plain.example/", ""), (3, *rows[3][1:])]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, places string, page int")
    want = {k: f"Page {k}\n{(own := ' '.join(f'word{k}x{j}' for j in range(30)))}\nAll rights of this text are free.\nAnd {own}" for k in range(12)}
    got = html_text.main_text(pages)
    assert got.columns == ["page_id", "url", "html", "places", "page", "text", "n_chars"] and got.count() == len(rows)
    found = {r.page_id: r for r in got.collect()}
    assert {k: found[k].text for k in range(12)} == want and all(r.n_chars == len(r.text) for r in found.values())
    # copies are one content: nothing in them recurs
    assert all(found[100 + k].text.endswith("again") and "Same" in found[100 + k].text for k in range(12))
    assert found[200].text == want[0] and found[201].text == found[202].text == ""
    joined = html_text.main_text(pages, broadcast=0)
    assert sorted(map(str, joined.select("page_id", "text").collect())) == sorted(map(str, got.select("page_id", "text").collect()))
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_shared_sentences_stay_in_articles(spark):
    rows = [(k, f"http://h.example/{k}", f"<article><p>Own sentence number {k} of this article, which is the longest.</p><p>A passage that all share.</p><div><span>Share this page</span></div></article>") for k in range(9)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Own sentence number {k} of this article, which is the longest.\nA passage that all share." for k in range(9)}


# --- op13 ------------------------------------------------------------------------------------------------------------


def collocated(rows, top=2000):
    seen = defaultdict(Counter)
    for body, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), body or "")):
            w = re.findall("[^\x20\x09]+", piece)
            seen[lang if lang is not None else "und"].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, f in seen.items():
        n, many = sum(v for k, v in f.items() if len(k) == 1), {k: v for k, v in f.items() if len(k) > 1 and v >= 10}
        covered = {s for k, v in many.items() if len(k) == 3 for s in (k[:2], k[1:]) if 100 * v >= 50 * f[s]}
        best = []
        for k, a in many.items():
            if k not in covered:
                score, _, left, right = min((1_000_000 * a * a // (f[k[:i]] * f[k[i:]]), i, f[k[:i]], f[k[i:]]) for i in range(1, len(k)))
                best.append((-score, -a, " ".join(k).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_collocations_are_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert sorted(map(tuple, collocations.phrases(docs).collect())) == collocated([(r.text, r.lang) for r in docs.select("text", "lang").collect()])


def test_collocations_on_odd_rows(spark, monkeypatch):
    rows = [("New York City is far. NEW YORK city, new york", None), (None, "en"), ("", "en"), (" \t .,;", "en"), ("é\x0bé é\x1cé NEW york", "en"), ("a a a a a a a a a a a a", "en"), ("new york", "und"), ("x " * 30_000 + "y", "de"), ("new york! " * 9, "fr")]
    rows = [(t, lang) for t, lang in rows for _ in range(11 if lang != "fr" else 1)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "text string, lang string, word string, n int")
    want = collocated(rows)
    assert sorted(map(tuple, collocations.phrases(docs).collect())) == want and {r[0] for r in want} == {"und", "en", "de"}
    # tiny bitmaps, many shards, a shard a pass: the same
    for name, value in (("WORD_BITS", 6), ("PAIR_BITS", 6), ("SHARD", 2), ("BLOCK", 3), ("PASS_BYTES", 1), ("PART_BYTES", 100)):
        monkeypatch.setattr(collocations, name, value)
    assert sorted(map(tuple, collocations.phrases(docs).collect())) == want
    assert collocations.phrases(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("words", "phrases"), [(2, 3), (40, 900), (5000, 20_000)])
def test_tries_hold_their_phrases(words, phrases):
    pick = np.random.default_rng(words)
    known = np.unique(pick.integers(1, 1 << 63, words).astype(np.uint64))
    some = known[np.minimum((pick.pareto(0.7, (phrases, 3)) * 2).astype(int), len(known) - 1)]
    some[::2, 2] = 0
    some = np.unique(some, axis=0)
    trie = collocations.Trie(*(x.tobytes() for x in collocations.build_trie(some)))
    assert np.array_equal(np.unique(trie.phrases(np.flatnonzero(trie.accept)), axis=0), some) and trie.accept.sum() == len(some)
