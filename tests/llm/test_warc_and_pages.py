import io
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import warc, wrappers
from paperloom.shipping import scratch_path

PAGES = [
    (1, "http://a.example/x", "<p>same</p>"), (2, "http://b.example/y?b=2&a=1#f", "<p>same</p>"), (3, "http://a.example/x", None), (4, None, ""), (5, "", "é\r\n\r\nWARC/1.1\r\n\r\n😀"),
    (6, "http://[broken", "<p>same</p>"), (7, "http://a.example/\r\nX: y", "x" * 300_000), (8, "https://www.A.example:8080/P/", "long"), (8, "https://www.A.example:8080/P/", "long"), (8, "https://c.example/", "<p>same</p>"),
]


def brute(rows, least):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least:
            first[data] = min(i, first.get(data, i))
    out = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        refers = first[data] if len(data) >= least and first[data] != i else None
        out[(i, len(data), warc.base32_sha1(data), "response" if refers is None else "revisit", refers)] += 1
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("archive", "offset", "refers_to", "digest", "n", "range")})
    rows = warc.capture_index(pages.repartition(3), least).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == brute(PAGES, least)
    order = sorted(rows, key=lambda r: r.place)
    assert [r.place for r in order] == list(range(len(rows))) and [r.range for r in order] == sorted(r.range for r in rows)
    assert [(r.url_key, r.capture_time, r.page_id) for r in order] == sorted((r.url_key, r.capture_time, r.page_id) for r in rows)


def test_many_runs_become_one_order(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    folder = scratch_path(spark, "warc-test")
    archives = warc.write_archives(pages.repartition(4), folder, segment_bytes=20_000)
    assert archives.count() > 4
    captures = warc.read_archives(archives, folder)
    rows = warc.merge_runs(captures, ranges=3).orderBy("place").collect()
    keys = [(r.url_key, r.capture_time, r.page_id) for r in rows]
    assert keys == sorted(keys) and len(keys) == pages.count() and len({r.range for r in rows}) == 3
    assert [(r.place, r.history_no) for r in rows] == numbered(rows)


def numbered(rows):
    seen, out = Counter(), []
    for place, r in enumerate(rows):
        out.append((place, seen[r.url_key]))
        seen[r.url_key] += 1
    return out


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_histories_go_on_from_range_to_range(spark, ranges):
    """One URL with two thirds of all captures, ids that repeat, and ranges that may be empty."""
    rows = [(i % 150, "http://hot.example/" if i % 3 else f"http://{i % 11}.example/{i % 4}", f"p{i % 90}") for i in range(240)] + [(None, None, None)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = scratch_path(spark, "warc-test")
    captures = warc.read_archives(warc.write_archives(pages, folder, segment_bytes=5_000), folder)
    got = warc.merge_runs(captures, ranges).orderBy("place").collect()
    keys = [(r.url_key, r.capture_time, r.page_id if r.page_id is not None else -1, r.archive, r.offset) for r in got]
    assert keys == sorted(keys) and [(r.place, r.history_no) for r in got] == numbered(got)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows[:-3], 0) + Counter(
        {(None, 0, warc.base32_sha1(b""), "response", None): 3}
    )
    system, root = warc.fs.FileSystem.from_uri(folder)
    ids, blocks = [], []
    for r in {r.archive for r in got}:
        for _, _, fields, block in warc.read_records(system.open_input_file(f"{root}/{r}")):
            ids.append(fields["WARC-Record-ID"])
            blocks.append(block)
    assert len(set(ids)) == len(ids) == len(got) and all(b.startswith(b"HTTP/1.1 200 OK\r\n") for b in blocks)


def test_empty_table(spark):
    assert warc.capture_index(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted((x, i) for i, x in enumerate(r)) for r in runs]
    assert [x[0] for x in warc.LoserTree(runs)] == sorted(x[0] for r in runs for x in r)


def test_records_are_checked():
    import gzip

    good = gzip.compress(warc.warc_record("a/0", 1, "u", b"abc")) + gzip.compress(warc.warc_record("a/9", 2, "u", b"abc", warc.Original(1, "v")))
    found = [(f["WARC-Type"], f.get("WARC-Refers-To-Target-URI"), warc.payload_of(b)) for _, _, f, b in warc.read_records(io.BytesIO(good))]
    assert found == [("response", None, b"abc"), ("revisit", "v", b"")]
    spans = [(a, n) for a, n, _, _ in warc.read_records(io.BytesIO(good))]
    assert sum(n for _, n in spans) == len(good) and spans[1][0] == spans[0][1]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-5])))


def test_url_keys():
    assert warc.url_key("https://www.B.Example.org:443/A/?z=1&a=2#x") == "org,example,b)/a?a=2&z=1"
    assert warc.url_key(None) == "" == warc.url_key("")


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav><div class="cookie-notice">cookies</div>
<article><h1>Head &amp; line</h1><p>One <b>bold</b>\n text&nbsp;here<br>next<p>Two &lt;tag&gt; &eacute;<div class="share">share</div><script>x("</p>")</script><p>Share this page</p></article>
<aside>side</aside><form><p>form</p></form><section id="comments"><p>comment</p></section><footer>foot</footer></body>"""


def test_main_text():
    assert wrappers.main_text(PAGE) == "Head & line\nOne bold text here next\nTwo <tag> é\nShare this page"
    assert wrappers.main_text("") == "" and wrappers.main_text("plain  text") == "plain text"
    assert wrappers.main_text("<div class=menu>m</div><p>a<p>b") == "a\nb"
    assert wrappers.main_text("<p>unclosed <b>b &am") == "unclosed b &am" and wrappers.main_text("<!-- never closed <p>x") == ""


def test_classes_within_articles_name_only_containers_of_furniture():
    inside = "<p class='legal'>a</p><section id='search-results'><p>b</p></section><ul class='tags'><li>c</ul><div class='meta'>d</div>"
    noise = "<div class='ad'>x</div><section class='comments'><p>x</p></section><nav>x</nav><div role='search'>x</div><ul class='share'><li>x</ul>"
    assert wrappers.main_text(f"<body><div class='legal'>x</div><article>{inside}{noise}</article></body>") == "a\nb\nc\nd"
    assert wrappers.main_text(f"<body><div class='legal'>x</div><div class='post'><p>y</p>{noise}</div></body>") == "y"
    assert wrappers.main_text("<article><header class='entry-header'><h1>T</h1><p>by me</p></header><p>z</article>") == "T\nz"


def test_deep_pages():
    deep = lambda n: "<body><article>" + "<div>" * n + "<p>core</p>" + "</div>" * n
    assert wrappers.main_text(deep(5000)) == "core"
    trees = [wrappers.pack_tree(wrappers.parse(deep(n))) for n in (5000, 4000, 4001, 3000, 100, 7)]
    assert wrappers.induce(trees) is None
    memo, (a, _), (b, _) = {}, *map(wrappers.unpack_tree, trees[:2])
    assert wrappers.matched_nodes(a, b, memo) == 4003


def random_tree(rnd, depth, labels=2, width=3):
    return (rnd.randint(1, labels), *(random_tree(rnd, depth - 1, labels, width) for _ in range(rnd.randint(0, width) if depth else 0)))


def slots(spec):
    slot = wrappers.Slot(spec[0])
    slot.children = [slots(c) for c in spec[1:]]
    return slot


def most_matched(a, b):
    """Simple tree matching as it is defined."""
    if a[0] != b[0]:
        return 0
    table = [[0] * len(b) for _ in a]
    for i, x in enumerate(a[1:], 1):
        for j, y in enumerate(b[1:], 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + most_matched(x, y))
    return 1 + table[-1][-1]


@pytest.mark.parametrize(("depth", "labels", "width"), [(2, 2, 3), (3, 2, 4), (3, 1, 4), (2, 3, 7)])
def test_tree_matching_is_the_best_alignment(depth, labels, width):
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ((0, *random_tree(rnd, depth, labels, width)[1:]) for _ in range(2))
        x, y, memo = wrappers.seal(slots(a)), wrappers.seal(slots(b)), {}
        assert wrappers.matched_nodes(x, y, memo) == most_matched(a, b)
        found = list(wrappers.aligned(x, y, memo))
        assert len(found) == most_matched(a, b) and all(p.label == q.label for p, q, _ in found)
        assert all(pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) for _, _, pairs in found)


def test_furniture_inside_the_main_region_is_found_by_its_slot(spark):
    """Site furniture that no class or tag tells, among paragraphs of varying number, against what the pages were made of."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    text = lambda: " ".join(word() for _ in range(20))
    rows, right = [], {}
    quoted = "Read this first."  # furniture at one place, a paragraph of content at another
    for i in range(600):
        host = ("one", "two", "tiny")[0 if i < 400 else 1 if i < 596 else 2]
        body = [text() for _ in range(rnd.randint(1, 9))]
        if i % 50 == 7:
            body.insert(0, quoted)
        front = {"one": f"<div class='lead'><p>{quoted}</p></div>", "two": "<p class='x1'>Sign up.</p>", "tiny": "<p>Only four pages.</p>"}[host]
        back = {"one": "<p>Last words of all pages.</p>", "two": "<blockquote><p>Send it on.</p></blockquote>", "tiny": ""}[host]
        rows.append((i, f"http://{host}.example/{i}", f"<body><article><h1>{word()}</h1>{front}{''.join(f'<p>{t}</p>' for t in body)}{back}</article></body>"))
        right[i] = ([] if host != "tiny" else ["Only four pages."]) + body
    for i in range(600, 700):  # near copies of one article, and copies, are content
        body = ["The same article " * 9, "in many near copies " * 9, f"number {i % 60}"]
        rows.append((i, f"http://copies.example/{i}", f"<body><article>{''.join(f'<p>{t}</p>' for t in body)}</article></body>"))
        right[i] = [t.strip() for t in body]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "salt", "wrapper", "salts", "n")})
    got = {r.page_id: r.text.split("\n") for r in wrappers.extract(pages).collect()}
    assert {i: (got[i][1:] if i < 600 else got[i]) for i in got} == right
    assert {r.host for r in wrappers.host_wrappers(pages).select("host").distinct().collect()} == {"one.example", "two.example"}


def test_induction_matches_a_plain_version():
    """Votes and texts of a wrapper, computed anew from the pages, where places are plain: lists of leaves of different labels."""
    rnd = random.Random(5)
    for _ in range(40):
        pages = []
        for _ in range(12):
            own = {f"c{k}": rnd.choice(["aa", "bbbb", "c" * rnd.randint(5, 9) + str(rnd.random())]) for k in range(6) if rnd.random() < 0.8}
            pages.append(own)
        pages = [dict(t) for t in dict.fromkeys(tuple(sorted(p.items())) for p in pages)]
        trees = [wrappers.pack_tree(wrappers.parse("<body>" + "".join(f"<p class='x{'abcdef'[int(k[1])]}'>{t}</p>" for k, t in sorted(p.items())))) for p in pages]
        seen = Counter(t for p in pages for t in set(p.values()))
        votes = [sum(len(t) for t in p.values() if seen[t] == 1) / max(1, sum(map(len, p.values()))) for p in pages]
        right = Counter()
        for k in (f"c{k}" for k in range(6)):
            for t in {p[k] for p in pages if k in p}:
                have = [v for p, v in zip(pages, votes) if p.get(k) == t]
                right[t] += sum(v >= 0.5 for v in have) >= wrappers.LEAST_PAGES and sum(have) >= wrappers.LEAST_SHARE * sum(votes)
        packed = wrappers.induce(trees)
        found, stack = Counter(), [wrappers.unpack_wrapper(packed)] if packed else []
        while stack:
            slot = stack.pop()
            found.update(slot.texts.keys())
            stack += slot.children
        assert found == Counter({wrappers.xxhash.xxh64_intdigest(t): n for t, n in right.items() if n})


def test_constant_nodes_are_template(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rnd = random.Random(1)
    text = lambda: " ".join(rnd.choice(words) for _ in range(30))
    rows = [(i, f"http://{'big' if i < 400 else 'small'}.example/{i}", f"<body><article><h1>{text()}</h1><p>{text()}</p><p class='x'>Sign up for our mail.</p></article></body>") for i in range(405)]
    rows += [(1000 + i, "http://copies.example/1", "<body><article><p>All the same text.</p></article></body>") for i in range(12)] + [(2000, None, None), (2001, "http://big.example/", "")]
    got = {r.page_id: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert len(got) == len(rows)
    assert not any("Sign up" in got[i].text for i in range(405)) and all(got[i].text.count("\n") == 1 for i in range(405))
    assert all(got[1000 + i].text == "All the same text." for i in range(12)) and got[2000].text == "" and got[2001].n_chars == 0
