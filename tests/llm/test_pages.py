"""HTML extraction, WARC archives and URL verdicts."""

import base64
import gzip
import hashlib
import io
import random
import re

import pytest

from folioflow.llm import html_extract, url_filter, warc

PAGES = "page_id long, url string, html string"


def text_of(page):
    found, kinds, marked = html_extract.lines_of(page)
    return [found[k] for k in html_extract.chosen(kinds, set(), False, html_extract.rules(marked, kinds, [len(x) for x in found]))]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<nav>menu</nav><article><h1>T &amp; U</h1><p><b>a  b<br>c</p><p>d</article><footer>f", ["T & U", "a b", "c", "d"]),
        ("<article><p>a<script>x('</p>')</script>b<!-- <p>no --></p><div class='ad box'>buy</div><section id=comments><article>reply</article></section>c", ["ab", "c"]),
        ("<article>cut &amp", ["cut &"]),
        ("<article>cut &am", ["cut &am"]),
        ("<article>x<p title='a>b'>y</p>1 < 2</article>", ["x", "y", "1 < 2"]),
        ("<body><header>H</header><div>one</div><aside>A</aside><form>F</form><div class=cookie-notice>C</div>two</body>", ["one", "two"]),
        ("<main><p>m</p></main><p>out</p>", ["m"]),
        ("<article><header><h1>T</h1></header>a</article><style>p{}</style><div hidden>h</div>", ["T", "a"]),
        ("<article>a&nbsp;b&#233;&lt;p&gt;</article>", ["a bé<p>"]),
        ("", []),
        ("<article>open <b tag", ["open"]),
        ("<article>a<!-- b > c", ["a"]),
        ("<script><!-- x </script><article>b</article>", ["b"]),
        ("<p>" + "<b " * 30_000, []),
        ("<script>never closed <article>x</article>", []),
    ],
)
def test_roles(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<nav><form><select>" + "<option>land" * 250 + "</select></form></nav><article>a</article>", ["a"]),
        ("<nav>" + "<div>" * 250 + "menu</nav><article>a</article>", ["a"]),
        ("<article><table>" + "<tr><td>c<td>d" * 150 + "</table></article><p>after", ["c", "d"] * 150),
        ("<article><table><tr><td class=ad>buy<td>a<tr><td><table><tr><td>b<td>c</table>d<tr><th>e</table><dl><dt class=share>s<dd>f</dl>g</article>", ["a", "b", "c", "d", "e", "f", "g"]),
        ("<select><optgroup><option>x<optgroup><option>y</select><article>a<td>b</article><p>c", ["a", "b"]),
    ],
)
def test_open_elements(page, want):
    assert text_of(page) == want


def test_shared_lines():
    assert html_extract.shared([1, 2, 3, 4], [2, 9, 4]) == {1, 3}
    assert html_extract.shared([1, 1, 2], [1, 2, 2]) == {0, 2}
    assert html_extract.shared([], [1]) == set()
    assert len(html_extract.shared([1, 2], [2, 1])) == 1


@pytest.mark.parametrize(
    "mark, stays",
    [("div class=share-price", True), ("section id=related-work", True), ("table id=header-table", True), ("div class='x share-buttons'", False), ("div class=cookie-notice", False), ("div id=ad-slot-3", False)],
)
def test_whole_class_tokens(mark, stays):
    assert text_of(f"<article>a<{mark}>b</{mark.split()[0]}>c</article>") == (["a", "b", "c"] if stays else ["a", "c"])


def longest_common(a, b):
    """Length of the longest common subsequence, by the table of all prefixes."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for k, y in enumerate(b):
            row.append(before[k] + 1 if x == y else max(row[k], before[k + 1]))
    return row[-1]


def test_shared_lines_match_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.sample(range(30), rng.randint(0, 20))
        b = rng.sample(range(30), rng.randint(0, 20))
        found = html_extract.shared(a, b)
        places = iter(b)
        assert len(found) == longest_common(a, b) and all(a[k] in places for k in sorted(found))


def test_pairing_on_all_pages(spark):
    """Every page is differenced, and the container restores; lines in the order of paths within the host, by brute force."""
    rng = random.Random(2)
    rows = []
    for k in range(60):
        menu = "".join(f"<li>m{rng.randint(0, 3)}" for _ in range(4))
        body = "".join(f"<p>{rng.choice(('same', f'own {k}', f'b{rng.randint(0, 9)}'))} {j}</p>" for j in range(5))
        rows.append((k, f"http://h{k % 3}.example/{rng.randint(0, 99):02d}", f"<ul>{menu}</ul>" + (f"<article>{body}</article>" if k % 2 else body) + "<footer>f</footer>"))
    parsed = {i: html_extract.lines_of(h) for i, _, h in rows}
    order = sorted(rows, key=lambda r: (r[1].split("/")[2], r[1].split("/")[3], r[0]))
    want = {}
    for at, (i, url, _) in enumerate(order):
        lines, kinds, marked = parsed[i]
        gone, copy = set(), False
        for j in (at - 1, at + 1):
            if 0 <= j < len(order) and order[j][1].split("/")[2] == url.split("/")[2]:
                found = html_extract.shared(lines, parsed[order[j][0]][0])
                gone |= found
                copy |= found >= {k for k, kind in enumerate(kinds) if kind != html_extract.ROLE}
        article = html_extract.rules(marked, kinds, [len(x) for x in lines], gone)
        want[i] = (" ".join(lines[k] for k in html_extract.chosen(kinds, gone, copy, article)), len(gone))
    df = spark.createDataFrame(rows, PAGES).coalesce(1)
    assert {r["page_id"]: (r["text"], r["n_shared"]) for r in html_extract.extract(df).collect()} == want
    off = {r["page_id"]: (r["text"], r["n_shared"]) for r in html_extract.extract(df, pairing=False).collect()}
    assert all(off[k][1] == 0 for k in off) and sum(off[k][0] != want[k][0] for k in off) > 20 and all(off[k][0] == want[k][0] for k in off if k % 2)


def test_differencing(spark, extra):
    page = lambda k: f"<body><p>Site of things</p><p>own text {k}</p><p>Read on in the shop</p></body>"
    rows = [(k, f"http://h.example/a/{k:02d}", page(k)) for k in range(9)] + [(20, "http://other.example/x", page(20)), (21, None, None), (22, None, "<article>q</article>"), (22, None, "<article>q</article>")]
    rows += [(30, "http://copy.example/1", page("c")), (31, "http://copy.example/2", page("c"))]
    got = html_extract.extract(extra(spark.createDataFrame(rows, PAGES)).repartition(4)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[k] == f"own text {k}" for k in range(9))
    assert text[20] == "Site of things own text 20 Read on in the shop" and text[30] == text[31] == "Site of things own text c Read on in the shop"
    assert text[21] == "" and text[22] == "q" and len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(spark.createDataFrame([], PAGES)).collect() == []


def independent(page):
    """(kind, text) of blocks by the standard library's parser; kinds as the operator has them, from tags alone."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.blocks, self.parts = [], [], []

        def end(self):
            text = " ".join("".join(self.parts).split())
            if text:
                kind = html_extract.ROLE if set(self.stack) & html_extract.BOILER else html_extract.INSIDE if "article" in self.stack else html_extract.OUTSIDE
                self.blocks.append((kind, text))
            self.parts = []

        def handle_starttag(self, tag, attrs):
            if tag not in html_extract.INLINE:
                if tag not in ("script", "style"):
                    self.end()
                self.stack += [tag] * (tag not in html_extract.VOID)

        def handle_endtag(self, tag):
            if tag not in html_extract.INLINE:
                if tag not in ("script", "style"):
                    self.end()
                if tag in self.stack:
                    del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

        def handle_data(self, data):
            if not {"script", "style"} & set(self.stack):
                self.parts.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.end()
    return reader.blocks


def test_blocks_match_an_independent_parser():
    rng = random.Random(12)

    def element(depth):
        kind = rng.choice(["p", "div", "section", "article", "nav", "aside", "footer", "ul", "script", "text", "inline", "br"])
        if kind == "text" or depth > 4:
            return rng.choice(["some words ", "a &amp; b ", "caf&eacute; ", "&#8364;5\n", " "])
        if kind in ("br", "script"):
            return "<br>" if kind == "br" else "<script>var x = 'no text';</script>"
        inner = "".join(element(depth + 1) for _ in range(rng.randint(0, 3)))
        if kind == "inline":
            return f"<b>{rng.choice(['bold', 'x'])}</b>"
        return f"<ul><li>{rng.choice(['one', 'two'])}</li><li>three</li></ul>" if kind == "ul" else f"<p>{rng.choice(['one', 'two &lt; 3'])}</p>" if kind == "p" else f"<{kind}>{inner}</{kind}>"

    seen = set()
    for _ in range(400):
        page = "<html><body>" + "".join(element(0) for _ in range(4)) + "</body></html>"
        want = independent(page)
        lines, kinds, marked = html_extract.lines_of(page)
        assert list(zip(kinds, lines, strict=True)) == want and (marked == html_extract.ARTICLES) == any(k == html_extract.INSIDE for k, _ in want)
        seen.update(k for k, _ in want)
    assert seen == {0, 1, 2}


def test_a_teaser_is_no_article(spark):
    """An article that is less than the rest of the page rules nothing; one that is more than what is not shared does."""
    story = "".join(f"<div>Sentence {{0}} of the story number {k} that the page is about.</div>" for k in range(6))
    teaser = "<article><a href='/x'>Teaser of another story</a></article>"
    menu = "".join(f"<div>Link of the menu {k} to another part of the site</div>" for k in range(9))
    rows = [(k, f"http://h.test/a/{k}", menu + story.format(k) + (teaser if k == 1 else "")) for k in range(3)]
    short = "<article><p>A short piece of its own, {0}.</p></article>"
    rows += [(10 + k, f"http://i.test/a/{k}", menu + short.format(k)) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    told = lambda k: " ".join(f"Sentence {k} of the story number {j} that the page is about." for j in range(6))
    assert [got[k] for k in range(3)] == [told(0), f"{told(1)} Teaser of another story", told(2)]
    assert [got[10 + k] for k in range(3)] == [f"A short piece of its own, {k}." for k in range(3)]


def test_neighbours_over_tasks_without_rows(spark):
    from folioflow.llm.common import Scratch, neighbours

    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(h, f"{k:03d}", k, [k]) for h, n in (("a", 30), ("b", 1), ("c", 7)) for k in range(n)]
    try:
        for n in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = spark.createDataFrame(rows, "host string, path string, row long, hashes array<long>")
            near = neighbours(Scratch(spark, "n"), df, ["host", "path", "row"], "hashes", "host", ("host", "row"))
            plan = near._jdf.queryExecution().toString()
            got = sorted((r["host"], r["row"], r["prev"], r["next"]) for r in near.collect())
            size = {"a": 30, "b": 1, "c": 7}
            assert got == sorted((h, k, [k - 1] if k else None, [k + 1] if k + 1 < size[h] else None) for h, _, k, _ in rows)
            assert "SinglePartition" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_archives(spark, extra):
    big = "".join(chr(0x61 + k % 26) for k in range(200_000)) + "é"
    rows = [(5, "http://a", "x"), (3, "http://b\r\nX: y", "x"), (4, None, None), (9, "u", ""), (1, "u", big), (2, "u", big), (7, "u", "unique é"), (None, "u", "x"), (8, "u", "dup"), (8, "u", "dup")]
    got = sorted((tuple(r) for r in warc.archive_round_trip(extra(spark.createDataFrame(rows, PAGES)).repartition(3)).collect()), key=str)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = first[h or ""] != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).collect() == []
    small = {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(spark.createDataFrame(rows, PAGES), min_bytes=2).collect()}
    assert small[5] == "response" and small[2] == "revisit"


def test_payloads_come_back(spark):
    rows = [(k, "u", "z" * k * 7919) for k in range(8)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, PAGES), keep_payload=True).collect()
    assert {r["page_id"]: bytes(r["block"]).decode() for r in got} == {k: h for k, _, h in rows}


@pytest.mark.parametrize("payload", [b"", b"a", b"ab" * 5000])
def test_chunks(payload):
    assert warc.from_chunks(warc.to_chunks(payload, 100)) == payload
    with pytest.raises(ValueError):
        warc.from_chunks(warc.to_chunks(payload + b"x", 100)[:-8])


def crawl(version: bytes) -> list[bytes]:
    """Records as others write them: an information record, a request, a response, metadata, a revisit."""
    page = b"<p>other's page</p>" * 50
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    digest = hashlib.sha1(page).hexdigest()
    rows = [
        ("warcinfo", b"software: x\r\n", []),
        ("request", b"GET / HTTP/1.1\r\n\r\n", [b"WARC-Target-URI: http://a.example/"]),
        ("response", http + warc.to_chunks(page, 64), [b"WARC-Target-URI: http://a.example/", b"WARC-Payload-Digest: sha1:" + digest.encode()]),
        ("response", http + page, [b"WARC-Payload-Digest: sha1:" + warc.digest_of(page).encode()]),
        ("response", http + page, [b"WARC-Payload-Digest: sha256:00"]),
        ("response", http + page, [b"WARC-Payload-Digest: sha1:", b"  WRONG"]),
        ("metadata", b"fetchTimeMs: 1\r\n", []),
        ("revisit", b"", [b"WARC-Payload-Digest: sha1:ABC"]),
    ]
    out = []
    for k, (kind, block, more) in enumerate(rows):
        head = [version, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:x:%d>" % k, *more, b"Content-Length: %d" % len(block)]
        out.append(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n")
    return out


@pytest.mark.parametrize("form", ["members", "one member", "plain"])
@pytest.mark.parametrize("version", [b"WARC/1.0", b"WARC/1.1"])
def test_archives_of_others(spark, tmp_path, form, version):
    rows = crawl(version)
    data = {"members": b"".join(map(gzip.compress, rows)), "one member": gzip.compress(b"".join(rows)), "plain": b"".join(rows)}[form]
    (tmp_path / "x.warc").write_bytes(data)
    files = spark.createDataFrame([("x.warc",)], "file string")
    got = sorted(warc.read_records(files, f"file://{tmp_path}", True, strict=False).collect(), key=lambda r: r["origin"])
    page = b"<p>other's page</p>" * 50
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "response", "response", "metadata", "revisit"]
    assert [r["intact"] for r in got] == [None, None, True, True, None, False, None, None]
    assert [bytes(r["block"]) for r in got[2:6]] == [page] * 4 and got[2]["url"] == "http://a.example/"
    assert {r["payload_digest"] for r in got[2:6]} == {warc.digest_of(page)} and got[7]["payload_digest"] == "ABC"
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_records(files, f"file://{tmp_path}").collect()


def test_pieces_and_ends():
    rows = b"".join(crawl(b"WARC/1.0"))
    whole = list(warc.parse(iter([rows])))
    for size in (1, 7, 1000):
        assert list(warc.parse(rows[k : k + size] for k in range(0, len(rows), size))) == whole
    with pytest.raises(ValueError):
        list(warc.parse(iter([rows[:-5]])))
    assert b"".join(warc.unpacked(io.BytesIO(gzip.compress(b"x" * (5 << 20)) + gzip.compress(b"y")))) == b"x" * (5 << 20) + b"y"
    with pytest.raises(ValueError):
        list(warc.unpacked(io.BytesIO(gzip.compress(rows)[:-3])))


def test_string_ids(spark):
    rows = [("b", "http://x/", "same"), ("a é\n1", "http://x/2", "same"), (None, None, "same"), ("", "", "other")]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {"a é\n1": ("response", None), "b": ("revisit", "a é\n1"), None: ("revisit", "a é\n1"), "": ("response", None)}


def test_gap_is_an_error(spark):
    parts = [("o", 1, None, "response", "1", None, None, "d", None, b"x", None), ("o", 3, 2, "continuation", None, None, None, None, None, b"y", None)]
    with pytest.raises(Exception, match="not whole"):
        warc.reassemble(spark.createDataFrame(parts, warc.RECORD)).collect()


def verdicts(spark, rows, **options):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, PAGES), **options).collect()}


def test_rules(spark, extra):
    rows = [
        (1, "http://A.Example.COM/en/700?x", None), (2, "https://x.com/en/8", ""), (3, "http://example.net/de/81", ""), (4, "http://n.net/de/", ""), (5, "nothing", ""), (6, None, "x"),
        (7, "http://acom/en/1", ""), (8, "http://b.org?q=/es/", ""), (9, "http://spam-farm.example.org/x", ""), (10, "a://İ.org/es/", ""), (10, "a://İ.org/es/", ""),
    ]
    df = extra(spark.createDataFrame(rows, PAGES))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got == {
        1: ("a.example.com", "/en/700", "example.com/en/7", "allow"), 2: ("x.com", "/en/8", "com/en/", "block"), 3: ("example.net", "/de/81", "example.net/de/8", "block"), 4: ("n.net", "/de/", "net/de/", "block"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("acom", "/en/1", None, "allow"), 8: ("b.org", "", None, "allow"), 9: ("spam-farm.example.org", "/x", None, "allow"), 10: ("İ.org", "/es/", "org/es/", "block"),
    }
    assert url_filter.judge(df).count() == len(rows) and url_filter.judge(df.limit(0)).collect() == []


def test_distrust_runs_against_links(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">l</a>' for h in hosts)
    rows = [(1, "http://spam.test/", link("victim.test")), (2, "http://feeder.test/", link("spam.test")), (3, "http://far.test/", link("feeder.test", "good.test", "good2.test", "good3.test")), (4, "http://victim.test/", ""), (5, "http://good.test/", link("mixed.test")), (6, "http://mixed.test/", link("spam.test", "good.test"))]
    got = {k: v[3] for k, v in verdicts(spark, rows, rules=(), trusted_hosts=("good.test",), blocked_words=("spam",)).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def brute_rank(edges, seeds, damping, rounds):
    out = {}
    for s, d, n in edges:
        out.setdefault(s, []).append((d, n))
    rank = dict(seeds)
    for _ in range(rounds):
        new = dict(seeds)
        for s, v in rank.items():
            total = sum(n for _, n in out.get(s, []))
            for d, n in out.get(s, []):
                new[d] = new.get(d, 0) + damping * v * n / total
        rank = new
    return rank


def test_propagation_matches_brute_force(spark):
    from folioflow.llm.common import Scratch

    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "a", 5)]
    seeds = spark.createDataFrame([("a", 0.7)], "host string, seed double")
    got = url_filter.propagate(Scratch(spark, "t"), spark.createDataFrame(edges, "src string, dst string, n long"), seeds, "t", 0.5, 1e-4)
    want = brute_rank(edges, {"a": 0.7}, 0.5, 60)
    found = {r["host"]: r["score"] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[h] - want[h]) < 1e-3 for h in want)


def test_verdicts_match_brute_force(spark):
    """Rules make seeds, links and domains carry them."""
    rng = random.Random(4)
    hosts = [f"{a}.{b}.{t}" for a in ("x", "y", "z") for b in ("one", "two") for t in ("com", "net")] + ["w.one.org", "long" * 40 + ".two.com", "1.2.3.4"]
    rows = []
    for k in range(120):
        link = "".join(f"<a href='//{rng.choice(hosts)}/p'>l</a>" for _ in range(rng.randint(0, 2)))
        rows.append((k, f"http://{rng.choice(hosts)}/{rng.choice(('en/7', 'en/1', 'de/1', 'fr/1', 'fr/2' + 'x' * 9000))}", link))
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, PAGES), damping=0.6).collect()}
    host, ruled = {k: r["host"] for k, r in got.items()}, {k: r["verdict"] if r["rule"] else None for k, r in got.items()}
    links = {}
    for k, _, html in rows:
        for dst in re.findall(r"href='//([^/]+)/", html):
            if dst != host[k]:
                links[host[k], dst] = links.get((host[k], dst), 0) + 1
    for h in set(host.values()) | {d for _, d in links}:
        labels = h.split(".")
        for k in range(len(labels) - 2 if not labels[-1].isdigit() else 0):
            links.setdefault((".".join(labels[k:]), ".".join(labels[k + 1 :])), 1)
    share = lambda h, v: sum(host[k] == h and ruled[k] == v for k in host) / sum(host[k] == h for k in host)
    bad = {h: share(h, "block") for h in set(host.values()) if share(h, "block") >= 0.5}
    good = {h: share(h, "allow") for h in set(host.values()) if share(h, "allow") > 0}
    trust = brute_rank([(s, d, n) for (s, d), n in links.items()], good, 0.6, 80)
    distrust = brute_rank([(d, s, n) for (s, d), n in links.items()], bad, 0.6, 80)
    want = {k: ruled[k] or ("block" if distrust.get(host[k], 0) >= 0.2 and distrust[host[k]] > trust.get(host[k], 0) else "allow") for k in host}
    assert {k: r["verdict"] for k, r in got.items()} == want
    free = [k for k in want if ruled[k] is None]
    assert {want[k] for k in free} == {"allow", "block"} and any(want[k] == "block" and host[k] not in bad for k in free)


def test_distrust_reaches_hosts_three_links_away(spark):
    """No rule, seed or word names the hosts that link to a blocked one over two others."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">l</a>' for h in hosts)
    rows = [(k, f"http://bad.com/en/{k}", "") for k in range(3)]
    rows += [(10, "http://one.test/", link("bad.com")), (11, "http://two.test/", link("one.test")), (12, "http://three.test/", link("two.test")), *((30 + k, f"http://l{k}.test/", link("three.test")) for k in range(9))]
    rows += [(20, "http://fine.example.com/en/70", link("also.test")), (21, "http://also.test/", link("one.test"))]
    got = {k: v[3] for k, v in verdicts(spark, rows).items()}
    assert {k: v for k, v in got.items() if k >= 10} == dict.fromkeys((10, 11, 12), "block") | dict.fromkeys((20, 21, *range(30, 39)), "allow")


def test_seed_table(spark):
    rows = [(1, "http://A.shop.test/", ""), (2, "http://b.test/", "<a href='http://c.test/'>c</a>"), (3, "http://c.test/", "")]
    seeds = spark.createDataFrame([("Shop.test", "block"), ("c.test", "block"), ("b.test", "allow"), (None, "block"), ("far.test", "block")], "host string, verdict string")
    assert {k: v[3] for k, v in verdicts(spark, rows, seeds=seeds).items()} == {1: "block", 2: "allow", 3: "block"}


def test_query_seeds_hosts_with_blocked_words(spark, tmp_path):
    """As its SQL does; words are whole parts of a name."""
    rows = [(1, "http://casino.test.org/x", "<a href='//a.test'>l</a>"), (2, "http://best-pills.test/x", ""), (3, "http://casinos.test/x", ""), (4, "http://feeder.test/x", "<a href='//best-pills.test/'>l</a>"), (5, "http://spam.example.com/en/7", ""), (6, None, None)]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(r) for r in url_filter.query(spark, str(tmp_path)).collect()}
    assert {r[0]: r[4] for r in got} == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow"}
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert set(con.execute(url_filter.ORACLE_SQL).fetchall()) == got
