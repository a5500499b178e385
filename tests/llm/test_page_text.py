"""Main text of pages: repeated runs against plain suffix comparison, broken markup, and work that grows with the page."""

from __future__ import annotations

import collections
import random
import time

import pytest

from fragx.llm import extract

PAGES = "page_id long, url string, html string, host string, value long, row long, found string"


def frame(spark, pages):
    return spark.createDataFrame([(*p, None, None, None, None) for p in pages], PAGES)


def brute(pages, run=extract.RUN, streams=extract.STREAMS):
    """Every run of tokens of a host as a tuple, with the set of whole streams that hold it."""
    held = collections.defaultdict(set)
    read = []
    for page_id, url, html in pages:
        blocks, host = extract.blocks_of(html or ""), extract.host_of(url)
        sides = [[w for k, t in blocks if (k == extract.ARTICLE) == inside for w in t.split(" ")] for inside in (False, True)]
        read.append((page_id, blocks, host, sides))
        for inside, words in enumerate(sides):
            for i in range(len(words) - run + 1):
                held[host, inside, tuple(words[i : i + run])].add(tuple(words))
    out = []
    for page_id, blocks, host, sides in read:
        cover = []
        for inside, words in enumerate(sides):
            gone = [False] * len(words)
            for i in range(len(words) - run + 1):
                if len(held[host, inside, tuple(words[i : i + run])]) >= streams:
                    gone[i : i + run] = [True] * run
            cover.append(gone if not inside or 2 * sum(gone) <= len(gone) else [False] * len(gone))
        lines, at = [], [0, 0]
        for kind, text in blocks:
            side, words = int(kind == extract.ARTICLE), text.split(" ")
            kept = [w for w, g in zip(words, cover[side][at[side] :]) if not g]
            at[side] += len(words)
            if kind != extract.PART and kept:
                lines.append(" ".join(kept))
        out.append((page_id, "\n".join(lines)))
    return sorted(out, key=str)


def texts(df, **options):
    rows = extract.extract(df, **options).collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    return sorted(((r.page_id, r.text) for r in rows), key=str)


def random_hosts(seed):
    rng = random.Random(seed)
    shared = [" ".join(f"b{k}x{rng.randrange(5)}" for _ in range(rng.randrange(4, 25))) for k in range(6)]
    pages = []
    for i in range(150):
        host = "hot.example" if i % 3 else f"h{rng.randrange(4)}.example"  # two thirds on one host
        body = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 5))] + rng.sample(shared, rng.randrange(4))
        rng.shuffle(body)
        article = "".join(f"<p>{t}</p>" for t in body)
        around = "".join(f"<div>{t}</div>" for t in rng.sample(shared, 2))
        pages.append((i, f"http://{host}/{i}", f"<nav>menu one two</nav>{around}<article>{article}</article>" if i % 4 else f"{around}<section>{article}</section>"))
    return pages + pages[:5] + [(900, None, pages[0][2]), (901, "::", ""), (902, "http://hot.example/x", None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("sent", [extract.SENT, 0])
def test_shared_runs_equal_brute_force(spark, seed, sent):
    pages = random_hosts(seed)
    want = brute(pages)
    assert texts(frame(spark, pages), sent=sent) == want
    assert want != brute(pages, streams=10**6)  # something is removed


def test_shared_runs_of_the_test_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = [(r.page_id, r.url, r.html) for r in df.select("page_id", "url", "html").collect()]
    assert texts(df) == brute(pages)


def test_no_text_is_lost_to_broken_markup():
    def lines(html):
        return [t for _, t in extract.blocks_of(html)]

    assert lines("price 5 < 6 and this whole sentence is main text") == ["price 5 < 6 and this whole sentence is main text"]
    assert lines("<p>a<b and c") == ["a<b and c"]
    assert lines("one<svg>two</p><p>three") == ["onetwo", "three"]
    assert lines("<p>one</p><noscript>two</noscript><math><mi>x</mi></math><object>three</object>") == ["one", "twoxthree"]
    assert lines('<p title="a > b">text</p>') == ["text"] and lines("<p title='open>text</p>") == ["text"]
    assert lines("<p>1 &lt; 2 &amp;amp; 3</p>") == ["1 < 2 &amp; 3"] and lines("x <!-- no --> y <!doctype html> z <?php ?> !") == ["x y z !"]
    assert lines("a <! b") == ["a <! b"] and lines("a <!-- b") == ["a"] and lines("<script>1 < 2</script>text<style>") == ["text"]


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '\"", "token <", "<!", "<!--", "</", "<title", '<a href=">" ', "<p class=ad>x "])
@pytest.mark.parametrize("tail", ["", ">"])
def test_work_grows_with_the_page(piece, tail):
    begun = time.perf_counter()
    extract.blocks_of(piece * (1_000_000 // len(piece)) + tail)
    assert time.perf_counter() - begun < 10
