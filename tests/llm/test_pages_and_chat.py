"""HTML extraction, WARC derivatives and preference pairs."""

import gzip
import hashlib
import zlib

import numpy as np
import pytest
import zstandard

from photonlake.llm import chat, html_text, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu a</a></li><li><a href="/b">Menu b</a></li></ul></nav><div class="ad">Buy this very long advertisement, it is really long, longer than others!</div>
<article><h1>Title &amp; more</h1><p><b>First para.<br><p>Second&nbsp;para with
 white   space &eacute;.</p><ul><li>one</li><li>two</li></ul><aside>See also</aside><form><input><button>Send</button></form><div class="comments"><p>Reader says a lot of things here.</p></div></article>
<footer>&copy; site</footer></body></html>"""


def test_article_blocks():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst para.\n\nSecond para with white space é.\n\none\n\ntwo"


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain text", "plain text"), ("<article><p>x", "x"), ("<article><p>cut off &am", "cut off &am"), ("<article><p>kept</p><p class='x", "kept"),
    ("<article><p>a</p><![CDATA[b]]></article>", "a"), ("<body><main><p>m</p></main></body>", "m"), ("<article hidden><p>h</p></article><article><p>v</p></article>", "v"),
    ("<nav>only a menu</nav>", ""), ("</p></div>odd<p>b", "odd\n\nb"), ("<table><tr><td>a<td>b</table>", "a\n\nb"),
])
def test_odd_pages(html, text):
    assert html_text.main_text(html) == text


def test_page_without_article_element():
    long = "A sentence of the article that goes on for a good while, with commas and words. " * 3
    html = f"<body><div id='header'>Site name</div><div class='content'><h2>Head</h2><p>{long}</p><p>short</p><p>{long}</p></div><div class='sidebar'><p>{long}</p></div><div id='footer'>c</div></body>"
    assert html_text.main_text(html) == "\n\n".join(["Head", " ".join(long.split()), "short", " ".join(long.split())])


def test_long_and_deep_pages(spark):
    html = "<article>" + "<div>" * 3000 + "<p>deep</p>" + "<p>x y</p>" * 20000
    rows = spark.createDataFrame([(1, "u", html), (2, None, None), (None, "u", "<p>a</p>"), (2, None, None)], "page_id long, url string, html string")
    out = html_text.extract(rows).collect()
    assert len(out) == 4 and max(r.n_chars for r in out) == len("deep") + 20000 * 5
    assert html_text.extract(rows.limit(0)).count() == 0


def test_warc_round_trip():
    made = warc.response("http://a/\r\nX: y", PAGE, "1", "2024-01-01T00:00:00Z")
    other = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>")], b"software: x\r\n")
    records = list(warc.parse(other + made + made))
    assert len(records) == 3 and warc.derive(*records[0]) is None
    headers, block = records[1]
    row = warc.derive(headers, block)
    payload = PAGE.encode()
    assert row["source_payload_digest"] == warc.digest(payload) == headers["warc-payload-digest"] and row["source_length"] == len(payload)
    for kind in ("metadata", "conversion"):
        (h, b), = warc.parse(row[f"{kind}_record"])
        assert h["warc-type"] == kind and h["warc-refers-to"] == headers["warc-record-id"] and h["warc-refers-to-target-uri"] == headers["warc-target-uri"]
        assert h["warc-block-digest"] == warc.digest(b) and int(h["content-length"]) == len(b) and h["warc-record-id"] == row[f"{kind}_id"] != headers["warc-record-id"]
    (_, text), = warc.parse(row["conversion_record"])
    assert "Second para with white space é." in text.decode()
    assert warc.derive(headers, block) == row
    for broken in (b"HTTP/1.1 200", made[:-40]):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


def test_warc_tables(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "u", ""), (1, "u", PAGE)], "page_id long, url string, html string")
    rows = warc.page_derivatives(pages).collect()
    assert len(rows) == 4 and len({r.metadata_id for r in rows}) == 3
    files = warc.page_responses(pages)
    derived = warc.derive_records(files).collect()
    digests = {hashlib.sha256(r.conversion_record).hexdigest() for r in derived}
    assert digests == {r.conversion_sha256 for r in rows}
    assert warc.page_derivatives(pages.limit(0)).count() == 0


def warc_response(http, payload, extra=(), warc_extra=()):
    head = "".join(f"{k}: {v}\r\n" for k, v in [("Content-Type", "text/html"), *extra])
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", "http://a/"), *warc_extra]
    return warc.record(headers, f"{http}\r\n{head}\r\n".encode() + payload)


def derived_of(data):
    (h, b), = warc.parse(data)
    row = warc.derive(h, b)
    (_, facts), = warc.parse(row["metadata_record"])
    text = list(warc.parse(row["conversion_record"])) if row["conversion_record"] else [(None, b"")]
    return row, facts.decode(), text[0][1].decode()


def test_warc_keeps_all_source_headers():
    data = warc_response("HTTP/1.1 200 OK", b"<p>x</p>", [("Server", "s/1"), ("Last-Modified", "then"), ("Set-Cookie", "a"), ("Set-Cookie", "b")], [("WARC-IP-Address", "192.0.2.1"), ("WARC-Truncated", "length")])
    row, facts, _ = derived_of(data)
    (headers, block), = warc.parse(data)
    lines = facts.split("\r\n")
    assert [x for x in lines if x.startswith("sourceWarcHeader")] == [f"sourceWarcHeader: {k}: {v}" for k, v in headers.pairs]
    assert [x for x in lines if x.startswith("sourceHttpHeader")] == ["sourceHttpHeader: Content-Type: text/html", "sourceHttpHeader: Server: s/1", "sourceHttpHeader: Last-Modified: then", "sourceHttpHeader: Set-Cookie: a", "sourceHttpHeader: Set-Cookie: b"]
    for kind in ("metadata", "conversion"):
        (h, b), = warc.parse(row[f"{kind}_record"])
        assert h["warc-payload-digest"] == h["warc-block-digest"] == warc.digest(b) == row[f"{kind}_digest"]


def chunks(data, n):
    return b"".join(b"%x;ext=1\r\n%s\r\n" % (len(data[i : i + n]), data[i : i + n]) for i in range(0, len(data), n)) + b"0\r\n\r\n"


@pytest.mark.parametrize("names, encode", [
    ("gzip", gzip.compress), ("deflate", zlib.compress), ("deflate", lambda x: zlib.compress(x, wbits=-15)), ("zstd", lambda x: zstandard.ZstdCompressor().compress(x)), ("gzip, deflate", lambda x: zlib.compress(gzip.compress(x))), ("", bytes),
])
@pytest.mark.parametrize("chunked", [True, False])
def test_warc_undoes_encodings(names, encode, chunked):
    payload = encode("<p>Zürich</p>".encode())
    extra = [("Content-Encoding", names)] * bool(names) + [("Transfer-Encoding", "chunked")] * chunked
    row, facts, text = derived_of(warc_response("HTTP/1.1 200 OK", chunks(payload, 7) if chunked else payload, extra))
    assert text == "Zürich" and "sourceDecodingProblem" not in facts
    assert row["source_length"] == len(chunks(payload, 7) if chunked else payload)


def test_warc_of_odd_bodies():
    assert "sourceDecodingProblem: br is not known" in derived_of(warc_response("HTTP/1.1 200 OK", b"\x8b", [("Content-Encoding", "br")]))[1]
    assert "sourceDecodingProblem: no chunk" in derived_of(warc_response("HTTP/1.1 200 OK", b"<p>x</p>", [("Transfer-Encoding", "chunked")]))[1]
    assert derived_of(warc_response("HTTP/1.1 200 OK", b"<meta charset='latin-1'><p>\xe9</p>"))[2] == "é"
    (h, b), = warc.parse(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:2>")], b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"))
    row = warc.derive(h, b)
    assert row["conversion_record"] is None and row["conversion_id"] is None and row["text_length"] is None and row["metadata_record"]


def test_packed_and_broken_warc_files(spark):
    one, two = (warc.response(f"http://{k}/", PAGE, k, "2024-01-01T00:00:00Z") for k in "ab")
    packed = gzip.compress(one) + gzip.compress(two)
    no_length = one.replace(b"Content-Length: ", b"Content-Size: ", 1)
    bad_member = bytearray(gzip.compress(one))
    bad_member[20] ^= 0xFF
    files = [one + two, packed, no_length + two, b"junk\r\n\r\n" + one + two[:-30], bytes(bad_member) + gzip.compress(two), None, b"", one.replace(b"Content-Length: ", b"Content-Length: x", 1)]
    rows = warc.derive_records(spark.createDataFrame([(x,) for x in files], "content binary")).collect()
    good, bad = [r for r in rows if r.problem is None], [r for r in rows if r.problem is not None]
    ids = sorted(r.refers_to for r in good)
    a, b = warc.record_id("response", "a"), warc.record_id("response", "b")
    assert ids == sorted([a, b, a, b, b, a, b]) and all(r.metadata_record is None for r in bad)
    assert sorted(r.problem.split(" at ")[0] for r in bad) == ["no length", "no length", "no record", "no record", "record is cut off"]


TURNS = [(2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"), (2, 3, "assistant", "yes"), (3, 0, "user", "x"), (3, 1, "assistant", "no"), (4, 0, "user", "alone"), (None, 0, "user", "z"), (6, 0, "assistant", None), (7, 0, None, "q"), (7, 1, "assistant", "")]


def test_preference_pairs(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    out = {r.pair_id: r for r in chat.preference_pairs(chat.sibling_pairs(df)).collect()}
    assert set(out) == {2, 3, 6, 7}
    r = out[2]
    assert r.n_prefix == 3 and r.prompt == "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\n<|end|>\n<|user|>\nmore\n<|end|>\n"
    assert r.chosen == "<|assistant|>\nyes\n<|end|>\n" and r.rejected == "<|assistant|>\nno\n<|end|>\n"
    (s,) = r.chosen_mask
    assert r.chosen[s.start : s.end] == "yes\n<|end|>\n"
    assert out[6].n_prefix == 1 and out[6].chosen == out[6].rejected == "" and out[6].chosen_mask == []
    assert chat.preference_digests(df).count() == 4 and chat.preference_digests(df.limit(0)).count() == 0


def test_prefix_of_equal_and_longer(spark):
    t = lambda *x: [{"turn": i, "role": r, "text": s} for i, (r, s) in enumerate(x)]
    a = t(("user", "a"), ("assistant", "b"), ("assistant", "c"))
    rows = [(1, a, a), (2, a, a[:1]), (3, None, a), (4, [], []), (5, a, t(("user", "z")))]
    df = spark.createDataFrame(rows, "pair_id int, chosen_turns array<struct<turn:bigint,role:string,text:string>>, rejected_turns array<struct<turn:bigint,role:string,text:string>>")
    out = {r.pair_id: r for r in chat.preference_pairs(df).collect()}
    assert [out[i].n_prefix for i in range(1, 6)] == [3, 1, 0, 0, 0]
    assert out[2].rejected == "" and len(out[2].chosen_mask) == 2 and out[3].chosen == ""


def test_no_part_of_an_article_is_given_up():
    p = lambda k, n: f"<p>{' '.join(f'part{k}' for _ in range(n))}</p>"
    wrap = lambda x: f"<html><body><nav><a href=a>Menu</a></nav>{x}</body></html>"
    has = lambda x: {k for k in range(1, 5) if f"part{k}" in html_text.main_text(wrap(x))}
    for a, b in ((60, 40), (50, 50), (40, 60)):
        assert has(f"<article>{p(1, a)}</article><article>{p(2, b)}</article>") == {1, 2}
    assert has(f"<main><h1>part3</h1>{p(1, 20)}<article>{p(2, 100)}</article></main>") == {1, 2, 3}
    assert has(f"<div>{p(1, 40)}<div>{p(2, 40) * 5}</div></div>") == {1, 2}
    assert has(f"<article>{p(1, 60)}<figure><img src=x><figcaption>part2 of it</figcaption></figure>{p(3, 60)}</article>") == {1, 2, 3}
    assert "Menu" not in html_text.main_text(wrap(f"<article>{p(1, 60)}</article>"))


def paragraphs(*sizes):
    return [" ".join(f"{'abcdefgh'[k]}{j}" for j in range(n)) for k, n in enumerate(sizes)]


def page(*parts):
    return "<html><body>" + "".join(parts) + "</body></html>"


LINKS = "".join(f"<li><a href='/{k}'>Punkt {k}</a></li>" for k in range(6))


@pytest.mark.parametrize("name", ["werbung", "xq7", ""])
def test_menu_and_advert_go_whatever_their_names(name):
    a, b, c = paragraphs(60, 3, 50)
    menu, ad = f"<div class='{name}m'><ul>{LINKS}</ul></div>", f"<div class='{name}'>Jetzt kaufen, nur heute.</div>"
    text = [f"<p>{x}</p>" for x in (a, b, c)]
    assert html_text.blocks_of(page(menu, ad, "<div>", *text, "</div>", menu, ad)) == [a, b, c]
    assert html_text.blocks_of(page(menu, ad, "<article>", *text, "</article>", ad)) == [a, b, c]
    # Without any element around the article: menus go as rows of links, the advert as a poor container beside it.
    assert html_text.blocks_of(page(menu, ad, *text, menu)) == [a, b, c]


@pytest.mark.parametrize("odd", ["<p class='side note'>{}</p>", "<p class='related'>{}</p>", "<div class='share-price'>{}</div>", "<section class='header-files'><p>{}</p></section>", "<h2 id='comments-on-rome'>{}</h2>"])
def test_misleading_names_inside_an_article_stay(odd):
    a, b, c = paragraphs(60, 12, 50)
    html = page("<nav>Menu</nav><article>", f"<p>{a}</p>", odd.format(b), f"<p>{c}</p></article><footer>f</footer>")
    assert html_text.blocks_of(html) == [a, b, c]


@pytest.mark.parametrize("name", ["ad", "comments", "newsletter-box", "cookie-notice", "related"])
def test_marked_containers_of_poor_or_linked_text_go(name):
    a, b = paragraphs(60, 50)
    inside = f"<div class='{name}'><a href=x>More to read</a> <a href=y>and more</a></div>"
    assert html_text.blocks_of(page(f"<article><p>{a}</p>{inside}<p>{b}</p></article>")) == [a, b]
    after = f"<div class='{name}'><p>{' '.join(paragraphs(40)[0].split())}</p></div>"
    assert html_text.blocks_of(page(f"<article><p>{a}</p><p>{b}</p>{after}</article>")) == [a, b] or name == "related"


def test_wrapper_with_a_marking_name_is_no_sidebar():
    a, b = paragraphs(60, 50)
    html = page(f"<div class='with-sidebar'><div class='text'><p>{a}</p><p>{b}</p></div><div class='sidebar'><p>{b}</p></div></div>")
    assert html_text.blocks_of(html) == [a, b]


def test_captions_formulas_and_short_lines_stay():
    a, b = paragraphs(60, 50)
    html = page(f"<article><h1>T</h1><p>{a}</p><figure><img src=x><figcaption>Seen from above</figcaption></figure><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math></p><p>Yes.</p><p>{b}</p><p>End.</p></article>")
    assert html_text.blocks_of(html) == ["T", a, "Seen from above", "so x=2", "Yes.", b, "End."]


def test_article_elements_hold_against_a_long_advert_but_not_as_teasers():
    a, b, ad = paragraphs(60, 50, 45)
    assert html_text.blocks_of(page(f"<div class='werbung'>{ad}</div><article><p>{a}</p><p>{b}</p></article>")) == [a, b]
    teasers = "".join(f"<article><p>Teaser {k} of something else</p></article>" for k in range(2))
    assert html_text.blocks_of(page(f"<div><p>{a}</p><p>{b}</p><p>{ad}</p></div>{teasers}"))[:3] == [a, b, ad]


def test_clusters_of_ratios():
    lines = html_text.lines_of(page(f"<ul>{LINKS}</ul><p>{paragraphs(60)[0]}</p><p>{paragraphs(50)[0]}</p>")).lines
    raw = html_text.own_ratios(lines)
    one = html_text.smoothed(np.eye(11)[5])
    assert abs(one.sum() - 1) < 1e-9 and one.argmax() == 5 and np.allclose(one, one[::-1])
    border = html_text.threshold(raw)
    assert (raw[:6] < border).all() and (raw >= border).sum() == 2
