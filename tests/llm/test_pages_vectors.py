"""Pages, URL lists, vectors and the pipeline on odd rows and against plain versions."""

from __future__ import annotations

import datetime
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import html_text, registry, top_k, url_filter, vector_dup
from quantloom.llm.components import components
from quantloom.llm.base import Scratch
from tests.llm import brute

LONG = "This is the long main text of the page that is on the subject of the article and has many of the stop words that are in it. It goes on for a while so that it is longer than two hundred characters in all, to be sure of it."


def test_main_text_leaves_furniture_out():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site of the things that are on it</h1></header><nav><ul><li><a href="/">The home of it</a></li></ul></nav>
    <div class="cookie-notice">We use cookies to make this the best site for you and all of us</div>
    <div id="sidebar"><p>Most popular of the week in this and that</p></div>
    <article><h1>Head &amp; line</h1><p>{LONG}<p>Short <b>one</b>.<br>Next&nbsp;line</p><form><input><p>Search the site</p></form></article>
    <section class="comments"><p>{LONG}</p></section><!-- ad --><div class="ad">{LONG}</div><footer>&copy; 2024</footer></body></html>"""
    assert html_text.main_text(page) == f"Head & line {LONG} Short one. Next line"


def test_short_blocks_follow_their_neighbours():
    page = f"<p>{LONG}</p><p>Short.</p><p>{LONG}</p>" + '<p><a href="/a">Many links here and more of them</a> <a href="/b">that go away</a></p><p>Tail</p><p><a href="/c">more links that lead away from here</a></p>'
    assert html_text.main_text(page) == f"{LONG} Short. {LONG}"


RUSSIAN = "Это длинный абзац основного текста страницы и он написан на языке которого нет в списке стоп слов но в нём есть много коротких слов и все они идут подряд так что его длина больше чем двести знаков и это всё что надо для проверки правила."


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p title=don't>Main text</p><p>it's the second</p></article>", "Main text it's the second"),
        ("<article><p>a <b the rest", "a the rest"),
        ("<p>one <b two <p>three</p>", "one two three"),
        (f"<p>{RUSSIAN}</p>", RUSSIAN),
        (f'<p>{LONG}</p><ul><li><a href="/a">&eacute;&eacute;&eacute;&eacute;&eacute;&eacute;</a> and then a good many plain words</li></ul>', f"{LONG} éééééé and then a good many plain words"),
        (f'<article><header><h1>Title</h1></header><div class="discussion"><p>{LONG}</p></div><p class="tags">Short.</p></article>', f"Title {LONG} Short."),
        (f'<div class="discussion"><p>{LONG}</p></div>', ""),
        (f'<article><p>{LONG}</p><ul><li><a href="/1">One more story</a></li><li><a href="/2">Yet another</a></li></ul><p>Bye.</p></article>', LONG),
    ],
)
def test_main_text_of_hard_pages(page, text):
    assert html_text.main_text(page) == text


def test_main_text_equals_the_plain_version_on_every_page(spark, data):
    pages = [r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    for page in pages:
        for form in (page, page.replace("<article>", "<div>").replace("</article>", "</div>"), page.replace(' class="ad"', "")):
            assert html_text.main_text(form) == brute.page_text(form)


def test_rules_and_not_markup_alone_decide(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    used = {(r["rule"], r["main"]): r["blocks"] for r in html_text.rules_used(pages).collect()}
    assert all(used.get(key, 0) > 50 for key in (("density", True), ("neighbours", True), ("links", False)))
    assert used[("markup", False)] < sum(n for (rule, _), n in used.items() if rule in ("density", "links"))


@pytest.mark.parametrize("page", ["", "<p", "<", "&am", "<a href='x", "<script>", "</p></div>", "<p>&#0;&bogus;</p>", "<!--", "<p>" * 5000, "a" * 100_000])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_text.main_text(page), str)


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (2, "u", "", 5), (3, None, f"<article><p>{LONG}</p>", 5), (3, None, f"<article><p>{LONG}</p>", 5)], "page_id long, url string, html string, n_chars int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, LONG, len(LONG)), (3, LONG, len(LONG))]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_url_keys(spark):
    frame = spark.createDataFrame([("https://u:p@A.b.Example.com:80/x/y/z?q#f",), ("nothing",), (None,), ("http://host/",)], "url string")
    got = [r[0] for r in frame.select(url_filter.keys_of(F.col("url"))).collect()]
    assert sorted(got[0]) == sorted(h + p for h in ("a.b.example.com", "b.example.com", "example.com") for p in ("", "/x/", "/x/y/"))
    assert got[1] is None and got[2] is None and got[3] == ["host"]


@pytest.mark.parametrize("keys", [50_000, 0])
def test_url_filter_judges_by_the_day(spark, keys):
    day = lambda n: datetime.date(2024, 1, n)
    events = spark.createDataFrame(
        [("bad.com", "spam", "add", day(5)), ("bad.com", "spam", "add", day(5)), ("bad.com", "spam", "remove", day(10)), ("x.bad.com/p/", "ads", "add", day(1)), (None, "a", "add", day(1)), ("bad.com", "tie", "add", day(20)), ("bad.com", "tie", "remove", day(20))],
        "key string, category string, action string, day date",
    )
    rows = [(1, "http://bad.com/", day(4)), (2, "http://x.bad.com/p/q", day(5)), (3, "http://bad.com/", day(10)), (4, None, day(6)), (5, "http://bad.com", None), (2, "http://x.bad.com/p/q", day(5)), (6, "http://notbad.com/", day(6)), (7, "http://bad.com/", day(25))]
    captures = spark.createDataFrame(rows, "page_id long, url string, day date")
    out = url_filter.filter_captures(captures, events, id_col="page_id", broadcast_keys=keys).collect()
    got = sorted((r["page_id"], r["blocked"], r["n_active"], r["key"], r["category"]) for r in out)
    clear = lambda i: (i, False, 0, None, None)
    assert got == [clear(1), (2, True, 2, "x.bad.com/p/", "ads"), (2, True, 2, "x.bad.com/p/", "ads"), *map(clear, (3, 4, 5, 6, 7))]
    assert url_filter.filter_captures(captures, events.limit(0), id_col="page_id").filter("blocked").count() == 0
    assert url_filter.filter_captures(captures.limit(0), events, id_col="page_id").count() == 0


@pytest.mark.parametrize("keys", [50_000, 0])
def test_url_filter_matches_prefixes_of_any_depth(spark, keys):
    day = datetime.date(2024, 1, 1)
    deep = "a.com/" + "".join(f"{k}/" for k in range(30))
    names = ["b.com/x/y/z/", "x.b.com/x/y/z/w/v/", deep, "c.com/", "d.com/x/y/z"]
    events = spark.createDataFrame([(k, "spam", "add", day) for k in names], "key string, category string, action string, day date")
    urls = ["http://b.com/x/y/z/q", "http://b.com/x/y/z", "http://x.b.com/x/y/z/w/v/", "http://x.b.com/x/y/z/w/v?q=/", f"http://w.{deep}q", "http://a.com/0/1/2/", "http://c.com", "http://c.com/p/q/r/s", "http://d.com/x/y/z/w"]
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, url string, day date")
    out = url_filter.filter_captures(captures, events, id_col="page_id", broadcast_keys=keys).orderBy("page_id").collect()
    assert [r["key"] for r in out] == ["b.com/x/y/z/", None, "x.b.com/x/y/z/w/v/", "b.com/x/y/z/", deep, None, "c.com/", "c.com/", None]
    assert [r["n_active"] for r in out] == [1, 0, 2, 1, 1, 0, 1, 1, 0] and all(r["blocked"] == (r["key"] is not None) for r in out)


def test_url_filter_of_tables_with_clashing_names(spark):
    day = datetime.date(2024, 1, 3)
    events = spark.createDataFrame([("a.com", "spam", "add", day, 1, "x")], "key string, category string, action string, day date, begun int, until string")
    captures = spark.createDataFrame([(1, "http://a.com/", day, "k", "c", 0)], "page_id long, url string, day date, key string, category string, last int")
    out = url_filter.filter_captures(captures, events, id_col="page_id").collect()
    assert [tuple(r) for r in out] == [(1, "http://a.com/", day, True, 1, "a.com", "spam")]


def odd_vectors(spark, seed: int = 0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 24))
    x = [c + rng.normal(size=24) * s for c in centres for s in (0.0, 0.0, 0.1, 0.15, 0.2, 0.25, 0.3)]
    rows = [(i * 3, [float(np.float32(v)) for v in row], 1) for i, row in enumerate(x)]
    nan = float("nan")
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 24, 0), (1003, [nan] + [1.0] * 23, 0), (1004, [None] + [1.0] * 23, 0), (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0), rows[5], (None, rows[0][1], 0), (1100, [float("inf")] * 24, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int"), rows


def good(v) -> bool:
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("tile", [4096, 7])
def test_vector_links_equal_brute_force(spark, tile):
    frame, rows = odd_vectors(spark)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if i is not None and good(v) and any(v)}
    pairs = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    ids = {i for i, _, _ in rows if i is not None}
    want = brute.components(ids, pairs)
    links = {i: sum(i in p for p in pairs) for i in ids}
    out = vector_dup.near_duplicates(frame, tile=tile).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["vec_id"] is None:
            assert r["n_links"] == 0 and r["component_id"] is None and r["kept"]
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])
    assert vector_dup.near_duplicates(frame.limit(0)).count() == 0


def test_tile_plans_hold_all_near_ranges_and_are_quick():
    rng = np.random.default_rng(5)
    low = rng.normal(size=300)
    tiles = [(int(k % 2), float(x), float(x + w), k) for k, (x, w) in enumerate(zip(low, rng.exponential(0.1, size=300), strict=True))]
    spans, pairs = vector_dup.plan_tiles(tiles, 0.3)
    order, of = sorted(tiles), {name: (first, last) for name, _, first, last in spans}
    for i, (d, lo, hi, name) in enumerate(order):
        for j, (e, lo2, hi2, _) in enumerate(order):
            if d == e and lo <= hi2 + 0.3 and lo2 <= hi + 0.3:
                assert of[name][0] <= j <= of[name][1]
    assert pairs == sum(last - k + 1 for _, k, _, last in spans)
    assert all(of[order[j][3]][0] <= k <= of[order[j][3]][1] for _, k, first, last in spans for j in range(first, last + 1))
    began = time.perf_counter()
    vector_dup.plan_tiles([(64, float(x), float(x + 0.001), k) for k, x in enumerate(rng.uniform(-0.5, 0.5, size=20_000))], 0.3)
    assert time.perf_counter() - began < 2


def best_rows(rows: list[tuple], every: int, k: int) -> list[tuple]:
    """(query_id, rank, vec_id, score) by the full product; every row that shares an id is a row of its own."""
    whole = [(n, r[0], [int(np.floor(1024 * x)) for x in r[1]]) for n, r in enumerate(rows) if r[0] is not None and good(r[1])]
    want = []
    for n, q, v in whole:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, i, w in whole if m != n and len(v) == len(w))
            want += [(q, place + 1, i, -s) for place, (s, i) in enumerate(found[:k])]
    return sorted(want)


@pytest.mark.parametrize("shard", [4096, 9])
def test_top_k_equals_brute_force(spark, shard):
    frame, rows = odd_vectors(spark, 1)
    assert sorted(tuple(r)[:4] for r in top_k.top_k(frame, every=9, shard=shard).collect()) == best_rows(rows, 9, 10)
    assert top_k.top_k(frame.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [4096, 5])
def test_top_k_takes_each_row_of_an_id(spark, shard):
    rng = random.Random(6)
    rows = [(5, [None, 1.0]), (5, [1.0, 1.0]), (7, [0.5, 0.5]), (7, [3.0, 3.0]), (100, [1.0, 2.0]), (100, [2.0, 1.0]), (200, [-1.0, 0.0]), (300, [1e300, -1e300])]
    rows += [(rng.randrange(20), [float(rng.randrange(-2, 3)), float(rng.randrange(-2, 3))]) for _ in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = [r for r in rows if r[0] != 300]
    got = top_k.top_k(frame.filter("vec_id <> 300"), shard=shard).collect()
    assert sorted(tuple(r)[:4] for r in got) == best_rows(kept, 100, 10)
    huge = top_k.top_k(frame, shard=shard).collect()  # components beyond what doubles sum exactly, scores beyond long
    assert max(r["score"] for r in huge if r["query_id"] == 100) == 2**63 - 1 and any(r["query_id"] == 300 for r in huge)


def check_reading(x: np.ndarray, queries: np.ndarray) -> float:
    """Holds a shard's answers against the full product; the share of all list entries that was read."""
    lists, shares = top_k.SortedLists(np.arange(len(x)), x), []
    for query, ids, scores, entries in lists.search(queries, x[queries], 10):
        own = x @ x[query]
        own[query] = -np.inf
        want = np.lexsort((np.arange(len(x)), -own))[:10]
        assert ids.tolist() == want.tolist() and scores.tolist() == own[want].tolist()
        left, _ = lists.read(query, x[query], 10)
        assert len(left) <= max(20, top_k.FEW * len(x)) or entries >= np.count_nonzero(x[query]) * len(x)
        shares.append(entries / x.size)
    return float(np.mean(shares))


def test_top_k_stops_reading_before_the_lists_end():
    rng = np.random.default_rng(3)
    queries = np.arange(0, 1000, 50)
    assert check_reading(np.floor(1024 * rng.normal(size=(1000, 64))), queries) < 0.9
    steep = rng.normal(size=(1000, 64)) * 2.0 ** -np.arange(0, 16, 0.25)
    assert check_reading(np.floor(1024 * steep), queries) < 0.25


def test_top_k_of_ties_and_of_components_that_are_zero():
    rng = np.random.default_rng(4)
    x = np.floor(1024 * rng.normal(size=(400, 8)))
    x[100:300] = x[7]
    x[:, 3] = 0.0
    x[350:] = 0.0
    check_reading(x, np.array([0, 7, 150, 360]))


def test_top_k_of_huge_components_is_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * 2.0**rng.randrange(20, 24) for _ in range(8)]) for i in range(30)]
    whole = {i: [int(1024 * x) for x in v] for i, v in rows}
    got = [tuple(r)[:4] for r in top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, k=3).collect()]
    want = []
    for q in (0, 10, 20):
        found = sorted((-min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), -(2**63)), 2**63 - 1), i) for i, v in whole.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:3])]
    assert sorted(got) == sorted(want)


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(40, 39), (5, 5)]
    out = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()
    want = brute.components({x for e in edges for x in e} - {5}, [e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["component"] for r in out} == want


def test_pipeline_stages_take_effect(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    now, sizes = docs, []
    scratch = Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        now = scratch.write(stage(spark, now, data))
        sizes.append(now.count())
        if name != "encoding":
            assert now.columns == docs.columns
        if name == "near_dup":
            rows = {r["doc_id"]: r["text"] for r in now.collect()}
            assert len(set(brute.near_components(rows).values())) == len(rows)
    assert docs.count() > sizes[0] > sizes[2] and sizes[3] == sizes[4] > 0
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(now.columns)


def test_pipeline_stages_on_odd_rows_and_on_none(spark, data):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{k}" for k in range(20_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", len(long)), (3, long, "en", "a", len(long)), (3, "other words", "en", "a", 11), (None, "no id at all", "en", "b", 12), (4, " ".join(["one two three four five six"] * 3), "en", "b", 80)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, data)
            assert out.count() <= 3 * docs.count()
            assert name == "encoding" or out.columns == docs.columns
    near = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema), data).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near if r["text"]) == sorted([(0, rows[5][1]), (3, "other words"), (4, rows[6][1])])


def test_pipeline_drops_near_copies_from_jaccard_80(spark, data):
    import corpus_pipeline

    words = [f"w{k}" for k in range(300)]
    likeness = lambda a, b: len(a & b) / len(a | b)
    texts = [" ".join([*words[:cut], *(f"x{k}" for k in range(300 - cut))]) for cut in range(240, 300)]
    of = {t: likeness(brute.shingles(" ".join(words)), brute.shingles(t)) for t in texts}
    near, far = next(t for t in texts if 0.81 <= of[t] < 0.84), next(t for t in texts if 0.7 < of[t] < 0.78)
    for text, want in ((near, [1]), (far, [1, 2])):
        docs = spark.createDataFrame([(1, " ".join(words)), (2, text)], "doc_id long, text string")
        assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, data).collect()) == want


def test_every_operator_is_registered():
    names = registry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
