"""Operators on single texts, held against plain brute-force versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clonoform.llm import html_text, pii, secret_scan, wavelet_output
from clonoform.llm.common import spans_text, table, tokenizer_path
from clonoform.llm.token_codec import TokenCodec

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "plain words"), (3, "plain words"), (None, "no id"), (4, "x" * 200_000), (5, "\n \t "), (6, "é́ ñ 中文")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def texts_of(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}


# --- tokens ---------------------------------------------------------------------------
CODEC, TINY = TokenCodec(tokenizer_path()), TokenCodec(tokenizer_path(), limit=2)


def whole(texts):
    return [np.array(CODEC.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab'stre12 .,\n\té中<|endoftx>́\x1c\x85 Iİſ", max_size=40))
def test_chunked_ids_equal_those_of_the_whole_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert CODEC.encode(text.encode()) == whole([text])[0]


def test_token_shards_hold_the_ids_of_whole_texts(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    ids = {d: b + (2).to_bytes(4, "little") for d, b in zip(texts, whole(texts.values()), strict=True)}
    shards = wavelet_output.write_token_shards(table(spark, sf_dir, "documents"), tokenizer_path(), shard_tokens=10_000)
    assert shards.count() > 8
    at = 0
    for r in wavelet_output.read_token_shards(shards).orderBy("doc_id").collect():
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own) // 4, zlib.crc32(own))
        at += len(own) // 4


def test_token_shards_of_odd_rows(spark):
    shards = wavelet_output.write_token_shards(docs_of(spark, ODD), tokenizer_path())
    rows = wavelet_output.read_token_shards(shards).collect()
    assert len(rows) == len(ODD)
    got = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:], strict=False)) and got[0][0] == 0
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[1] == 1
    assert next(r for r in rows if r["doc_id"] is None)["start"] == 0
    empty = wavelet_output.write_token_shards(docs_of(spark, []), tokenizer_path())
    assert wavelet_output.read_token_shards(empty).count() == 0


def test_token_shards_of_an_id_that_many_rows_share(spark):
    rows = [(None if i % 10 < 6 else 7 if i % 10 < 9 else i, f"text number {i}") for i in range(300)] + [(-(1 << 63), "the least id")]
    shards = wavelet_output.write_token_shards(docs_of(spark, rows), tokenizer_path())
    holds = [set(r["doc_ids"]) for r in shards.select("doc_ids").collect()]
    assert sum(None in h for h in holds) > 1
    coded = [b + (2).to_bytes(4, "little") for b in whole([t for _, t in rows])]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, zlib.crc32(np.frombuffer(coded[i], "<u4").astype("<u2").tobytes())))
    got = wavelet_output.read_token_shards(shards).orderBy("start").collect()
    assert [(r["doc_id"], r["ids_crc32"]) for r in got] == [(rows[i][0], zlib.crc32(coded[i])) for i in order]
    assert [r["start"] for r in got] == np.cumsum([0] + [len(coded[i]) // 4 for i in order])[:-1].tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=3000))
def test_wavelet_matrix_answers_like_the_sequence(ids):
    a = np.array(ids, np.uint32)
    w = wavelet_output.WaveletMatrix.from_bytes(wavelet_output.WaveletMatrix.build(a, 6).to_bytes())
    assert (w.decode() == a).all() and (w.access(np.arange(len(a))) == a).all()
    for token in (0, 7, 40, 63):
        assert w.count(token) == ids.count(token)
        assert w.count(token, len(ids) // 3, len(ids) // 2) == ids[len(ids) // 3 : len(ids) // 2].count(token)
        assert w.positions(token).tolist() == [i for i, x in enumerate(ids) if x == token]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word", "Word###", "élan&&&", "ÉLAN", "it's", "İx", "a_b", "x2", "<|endoftext|>", "a<|", "don't!!", "ǅo%%", "naïve,", "«q»", "'s'", "ß$$$", "ŉ"]), max_size=12))
def test_put_together_ids_equal_those_of_the_whole_text(words):
    for codec in (CODEC, TINY):
        assert codec.encode(" ".join(words).encode()) == whole([" ".join(words)])[0]


def test_a_shard_answers_without_being_decoded():
    rng = np.random.default_rng(4)
    ids = (rng.zipf(1.3, 300_000) % 49_408).astype(np.uint32)
    blob = wavelet_output.WaveletMatrix.build(ids, 16).to_bytes()
    w = wavelet_output.WaveletMatrix.from_bytes(blob)
    assert w.access([123_456])[0] == ids[123_456]
    assert sum(len(p.read) for p in w.planes) <= 16 < sum(len(p.chunks) for p in w.planes) == 16 * 5
    rare = int(ids[200_000])
    w = wavelet_output.WaveletMatrix.from_bytes(blob)
    where = np.flatnonzero(ids == rare)
    assert w.count(rare) == len(where) and w.positions(rare, len(where) // 2, len(where) // 2 + 1)[0] == where[len(where) // 2]
    assert sum(len(p.read) for p in w.planes) <= 16 * 3
    for token in (0, 1, 2, 500, 49_407):
        assert (w.positions(token) == np.flatnonzero(ids == token)).all() and w.count(token, 70_000, 262_144) == (ids[70_000:262_144] == token).sum()
    at = rng.integers(0, len(ids), 2_000)
    assert (w.access(at) == ids[at]).all() and (w.decode() == ids).all()
    with pytest.raises(ValueError):
        wavelet_output.WaveletMatrix.from_bytes(b"WMX1" + bytes(20))


# --- personal data ----------------------------------------------------------------------
def base_pii(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m.group())
        s = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab@.-_+0123 ()x%", max_size=60))
def test_base_identifiers_equal_the_plain_patterns(text):
    assert sorted(pii.find_identifiers(text)) == sorted(base_pii(text))


def test_pii_over_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = texts_of(spark, sf_dir)
    found = {r["doc_id"]: r for r in pii.scan_pii(table(spark, sf_dir, "documents")).collect()}
    assert found.keys() == texts.keys()
    for d, t in texts.items():
        base = base_pii(t)
        assert found[d]["base_sha256"] == hashlib.sha256(spans_text(base, pii.KINDS).encode()).hexdigest()
        assert found[d]["n_email"] == sum(s[2] == "email" for s in base)
        if not found[d]["n_added"]:
            assert found[d]["spans"] == spans_text(base, pii.KINDS)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("write to jane.doe (at) example (dot) com now", "email", "jane.doe (at) example (dot) com"),
        ("write to jane[at]example[dot]org.", "email", "jane[at]example[dot]org"),
        ("write to jane at example dot com now", "email", "jane at example dot com"),
        ("write to jane.d at example dot it now", "email", "jane.d at example dot it"),
        ("host 192[.]168[.]1[.]1 is up", "ip", "192[.]168[.]1[.]1"),
        ("host 192(dot)168(dot)1(dot)1, up", "ip", "192(dot)168(dot)1(dot)1"),
        ("host 10.0 [.] 0.7 is up", "ip", "10.0 [.] 0.7"),
        ("mail jаne@exаmple.com today", "email", "jаne@exаmple.com"),
        ("mail ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ today", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("call plus one two one two five five five zero one nine nine ok", "phone", "plus one two one two five five five zero one nine nine"),
        ("card four one one one 1111 1111 one one one one end", "card", "four one one one 1111 1111 one one one one"),
        ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, span):
    base, added = pii.find_pii(text)
    assert (text.index(span), text.index(span) + len(span), kind) in added and not any(k == kind for _, _, k in base)


@pytest.mark.parametrize(
    ("text", "kind", "span", "plain"),
    [
        ("mail jаne@example.com today", "email", "jаne@example.com", "ne@example.com"),
        ("mail x@example.cоm today", "email", "x@example.cоm", "x@example.c"),
        ("call +1 212 555 01９９ now", "phone", "+1 212 555 01９９", "+1 212 555 01"),
        ("call +1 212 555 0112 one two three five now", "phone", "+1 212 555 0112 one two three five", "+1 212 555 0112"),
    ],
)
def test_a_disguised_part_beside_a_plain_match(text, kind, span, plain):
    spans = [(text.index(x), text.index(x) + len(x), kind) for x in (plain, span)]
    assert pii.find_pii(text) == (spans[:1], spans[1:])


@pytest.mark.parametrize(
    ("span", "digits"),
    [
        ("plus fünf fünf fünf fünf fünf neuf neuf zéro zéro", "+555559900"),
        ("Plus Zéro zéro neuf neuf fünf fünf zéro fünf neuf", "+009955059"),
        ("plus uno uno dos dos tres tres cuatro cuatro cinco", "+112233445"),
        ("plus one dot 5555 555 55 dot 5", "+1.5555 555 55.5"),
        ("192 dot 168 dot 1 dot 1", "192.168.1.1"),
    ],
)
def test_each_digit_word_is_looked_for(span, digits):
    assert pii.normalise(f"say {span} now").text == f"say {digits} now"


def of(text, part, kind):
    return text.index(part), text.index(part) + len(part), kind


def test_a_span_maps_to_its_own_words():
    two = "one nine two dot one six eight dot one dot one, one zero dot zero dot zero dot one"
    assert pii.find_pii(two) == ([], [of(two, two.split(", ")[0], "ip"), of(two, two.split(", ")[1], "ip")])
    more = "at one nine two dot one six eight dot one dot one dot five ok"
    assert pii.find_pii(more) == ([], [of(more, "one nine two dot one six eight dot one dot one", "ip")])
    listed = "card four, one, one, one, 1111 1111 one, one, one, one end"
    assert pii.find_pii(listed) == ([], [of(listed, listed[5:-4], "card")])


@pytest.mark.parametrize(("before", "address"), [(130, ""), (5_000, ""), (3, "a dot b dot c dot d dot e dot f at host dot com"), (3, " dot ".join("abcdefgh" * 40) + " at mail dot host dot org")])
def test_no_length_hides_an_address(before, address):
    address = address or "x" * before + " at host dot com"
    text = "write , " + address + " now"
    assert pii.find_pii(text) == ([], [of(text, address, "email")])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*pii.DIGIT_WORDS, "7", "12", "192", "dot", "punkt", "plus", "word", "+1", "j\u0430ne", "at", "host", "com", "(at)", "[dot]", ",", "\u200b", "\uff11"]), max_size=24), st.sampled_from([" ", ", ", "-"]))
def test_mapped_spans_normalise_to_the_identifier(words, gap):
    text = gap.join(words)
    for start, end, kind in pii.find_pii(text)[1]:
        again = [x for lists in (False, True) for x in pii.find_identifiers(pii.normalise(text[start:end], lists).text) if x[2] == kind]
        whole = [pii.normalise(text[start:end], lists).text for lists in (False, True)]
        assert 0 <= start < end <= len(text) and any((0, len(w), kind) in again for w in whole)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*pii.DIGIT_WORDS, "7", "dot", "punkt", "plus", "word"]), max_size=9), st.sampled_from([" ", ", ", "-"]))
def test_the_hint_skips_no_spelled_number(words, gap):
    text = gap.join(words)
    assert [s[2:] for s in pii.normalise(text).layers[0][1]] == [e[:2] for e in pii._spelled(text)] if pii._spelled(text) else True


@pytest.mark.parametrize("text", ["look at the dot on the map", "one, two, three, four, five, six", "we met at noon. It was fine", "Посмотри на дом и сад", ""])
def test_prose_stays_clean(text):
    assert pii.find_pii(text) == ([], [])


def test_pii_of_odd_rows(spark):
    rows = pii.scan_pii(docs_of(spark, ODD)).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == "" for r in rows)
    assert pii.scan_pii(docs_of(spark, [])).count() == 0


# --- secrets ------------------------------------------------------------------------------
def base_secrets(text):
    out = []
    for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    return out + [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]


def test_secrets_over_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    kinds = tuple(r.kind for r in secret_scan.RULES)
    texts = texts_of(spark, sf_dir)
    found = {r["doc_id"]: r for r in secret_scan.scan_secrets(table(spark, sf_dir, "documents")).collect()}
    assert found.keys() == texts.keys() and any(base_secrets(t) for t in texts.values())
    for d, t in texts.items():
        base = base_secrets(t)
        assert found[d]["base_sha256"] == hashlib.sha256(spans_text(base, kinds).encode()).hexdigest()
        assert [found[d][f"n_{k}"] for k in kinds[:3]] == [sum(s[2] == k for s in base) for k in kinds[:3]]


def test_trigram_queries():
    assert secret_scan.trigram_query(r"[0-9a-f]+") is True
    assert secret_scan.trigram_query(r"AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))
    assert secret_scan.trigrams(secret_scan.trigram_query(r"(abcd|xyz)[0-9]?q+")) == {b"abc", b"bcd", b"xyz"}
    assert secret_scan.trigram_query(r"(abcd|x*)") is True
    named = {r.kind for r in secret_scan.RULES if secret_scan.trigram_query(r.pattern) is True}
    assert named == {"hex"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAkKIi_pPeEyY=: xoxb-0123456789toknTOKEN", max_size=40), max_size=6))
def test_the_index_loses_no_match(texts):
    index = secret_scan.TrigramIndex(secret_scan.RULES)
    postings = index.postings([t.encode() for t in texts])
    for rule, query in zip(secret_scan.RULES, index.queries, strict=True):
        near = set(index.candidates(query, postings, len(texts)).tolist())
        assert all(i in near for i, t in enumerate(texts) if re.search(rule.pattern, t))


@pytest.mark.parametrize("text", ["eyJ" * 300_000, "eyJ." * 200_000, "://" * 300_000, "://a:" * 200_000, "-----BEGIN " * 100_000, "token " * 200_000, "token" + " " * 900_000, "xox" * 300_000])
def test_rules_take_linear_time(text):
    import time

    began = time.perf_counter()
    for rule in secret_scan.RULES:
        secret_scan.scan_rule(rule, re.compile(rule.pattern), text)
    assert time.perf_counter() - began < 20


def test_added_kinds():
    jwt = "eyJhbGciOi.eyJzdWIi.SflKxw"
    rule = next(r for r in secret_scan.RULES if r.kind == "jwt")
    assert secret_scan.scan_rule(rule, re.compile(rule.pattern), f'"{jwt}" no-{jwt}') == [(1, 1 + len(jwt), "jwt")]


def test_clashing_columns(spark):
    """Other columns never matter, whatever their names."""
    names = ["part", "ids", "shard", "blob", "spans", "n_email", "n_hex", "base_sha256", "start", "n_tokens", "ids_crc32", "lengths", "doc_ids"]
    plain = docs_of(spark, ODD)
    docs = plain.selectExpr("*", *[f"'x' as {n}" for n in names])
    for run in (pii.scan_pii, secret_scan.scan_secrets, lambda d: wavelet_output.read_token_shards(wavelet_output.write_token_shards(d, tokenizer_path()))):
        assert sorted(map(str, run(docs).collect())) == sorted(map(str, run(plain).collect()))


def test_secrets_of_odd_rows(spark):
    assert secret_scan.scan_secrets(docs_of(spark, ODD)).count() == len(ODD)
    assert secret_scan.scan_secrets(docs_of(spark, [])).count() == 0


# --- pages --------------------------------------------------------------------------------
@pytest.mark.parametrize("text", ["look at this dot it works", "we met at paris dot it was late", "look at this dot me too", "in 300[.]1[.]1[.]1 no", "1[.]2[.]3[.]4[.]5[.]x"])
def test_prose_gives_no_address(text):
    assert [k for _, _, k in pii.find_pii(text)[1]] == ([] if "[" not in text or "300" in text else ["ip"])


def test_pages_give_their_article(spark, sf_dir):
    import html

    pages = table(spark, sf_dir, "pages").collect()
    found = {r["page_id"]: r for r in html_text.main_text(table(spark, sf_dir, "pages")).collect()}
    assert len(found) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*?)</article>", p["html"], re.DOTALL).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
        text = "\n".join(b for b in blocks if b)
        assert found[p["page_id"]]["text"] == text and found[p["page_id"]]["n_chars"] == len(text)


def test_template_goes_and_prose_stays(spark):
    page = '<html><body><div class="x"><p>Site of pages</p><ul><li>one</li></ul></div><div>{}</div><p>All rights &copy; kept</p></body></html>'
    rows = [(i, "http://a.example/" + str(i), page.format(f"<p>Story {i} &amp;\n more<br>line two</p>")) for i in range(12)]
    rows += [(50, "http://b.example/", page.format("<p>lone</p>")), (51, None, None), (52, "::", ""), (None, "http://a.example/", "<p>plain")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 & more\nline two"
    assert got[50] == "Site of pages\none\nlone\nAll rights © kept"
    assert got[51] == got[52] == "" and got[None] == "plain"
    for most in (1, 2, 3):
        split = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), most_hashes=most).collect()}
        assert split == got


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>T</h1><p>a  b\n c<p>d <b>e</b>f</article><div class='comments'>no</div>", "T\na b c\nd ef"),
        ("<body><nav>x</nav><main><p>m<script>var a='</p>'</script> n</p><aside>s</aside><form><p>f</p></form></main><footer>z</footer>", "m n"),
        ("<body><div id=sidebar>x</div><!-- <p>c</p> --><p>k &lt;b&gt; &#233;</p><p hidden>h</p><math>1</math>", "k <b> é\nh\n1"),
        ("<div class='cookie-notice'>n</div><section><header>h</header><p>q<img src='a>b'>r</p></section>", "qr"),
        ("<article><p>never closed <b>bold<p>next", "never closed bold\nnext"),
        ('<div class="post-content no-sidebar"><p>x y</p></div>', "x y"),
        ('<body><div class="content has-sidebar"><h1>h</h1><p>x</p></div><div class="ad-box">buy</div>', "h\nx"),
        ('<article><p>a</p><section id="social"><p>kept</p></section><div id="comments">no</div></article>', "a\nkept"),
        ('<p>one <a class="share">word</a> stays</p>', "one word stays"),
        ('<div class="widget-wrap"><h1>t</h1><p>body</p></div>', "t\nbody"),
        ("<h1>t</h1><p>a</p><div class='comments'><p>much more text than the article has</p></div>", "t\na"),
        ('<div class="siteFooter">f</div><div class="left-ad-free"><p>kept</p></div><p>x</p>', "kept\nx"),
    ],
)
def test_extraction_of_small_pages(page, text):
    root = html_text.parse(page)
    html_text.seal(root)
    assert html_text.article(root, set()) == text


def test_many_template_keys_do_not_reach_the_driver(spark, monkeypatch):
    page = "<html><body><div>Site of {0}</div><p>Story {1}</p></body></html>"
    rows = [(100 * h + i, f"http://host{h}.example/{i}", page.format(h, i)) for h in range(4) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r[0]: f"Story {r[0] % 100}" for r in rows}
    assert {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()} == want

    def fetched(*_):
        raise AssertionError("template keys on the driver")

    monkeypatch.setattr(type(pages), "toLocalIterator", fetched)
    assert {r["page_id"]: r["text"] for r in html_text.main_text(pages, most_hashes=2).collect()} == want


@pytest.mark.parametrize("mark", ["article", "div"])
def test_copies_of_a_page_are_not_template(spark, mark):
    page = "<html><body><div class=top><p>Site of pages</p></div><{0}><div class=content><p>{1}</p><section>{2}</section></div></{0}></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format(mark, "the one story", "its end")) for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", page.format(mark, "the one story", "its end")) for i in range(12)]
    rows += [(200 + i, f"http://b.example/x{i}", page.format(mark, f"story {i}", f"end {i}")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    top = "" if mark == "article" else "Site of pages\n"
    assert all(got[i] == top + "the one story\nits end" for i in range(12))
    assert all(got[100 + i] == "the one story\nits end" and got[200 + i] == f"story {i}\nend {i}" for i in range(12))


def test_what_few_pages_of_a_large_host_share_is_not_template(spark):
    page = "<html><body><div><p>Site of pages</p></div><h2>{}</h2><p>Story {}</p></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format("Results" if i < 15 else f"Head {i}", i)) for i in range(100)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Results\nStory {i}" if i < 15 else f"Head {i}\nStory {i}" for i in range(100)}


@pytest.mark.parametrize("body", ["<div class=content><p>one story</p></div><p>day {}</p>", "<div class=content>one story of more words</div><p>{}</p>", "<section><div><ul><li>one story</li></ul></div></section><p>day {}</p>"])
def test_a_container_of_the_article_is_not_template(spark, body):
    rows = [(i, f"http://a.example/{i}", f"<body><article>{body.format(i)}<div>Read more</div></article></body>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(t.split("\n") == (["one story", f"day {i}"] if "day" in body else ["one story of more words", str(i)]) for i, t in got.items())


def unmarked(page):
    """The page with its chrome in plain div elements that no tag or name gives away."""
    return re.sub(r"<(/?)(?:nav|header|footer|aside|article|main)\b[^>]*>", r"<\1div>", re.sub(r" class=\"[^\"]*\"", "", page or ""))


def plain_template(pages):
    """Per host the (slot, digest) pairs that are template, counted without Spark."""
    from collections import Counter, defaultdict

    contents = defaultdict(dict)
    for url, page in pages:
        host = re.match(r"[a-z]+://([^/:?#]*)", url).group(1)
        root = html_text.parse(page)
        html_text.seal(root)
        contents[host].setdefault(html_text.article(root, set()), set()).update((slot, key, large) for slot, key, large in html_text.subtrees(root))
    out = {}
    for host, own in contents.items():
        if len(own) < 3:
            continue
        n, large, slots, recurring = Counter(), Counter(), Counter(), Counter()
        for found in own.values():
            for slot, key, big in found:
                n[slot, key] += 1
                large[slot, key] += big
        often = {k for k, m in n.items() if m >= 3 and m >= len(own) * (0.01 if 2 * large[k] < m else 0.5)}
        for k, m in n.items():
            slots[k[0]] += m
            recurring[k[0]] += m if k in often else 0
        out[host] = {key for slot, key in often if 2 * recurring[slot] >= slots[slot]}
    return out


def test_the_template_decides_where_nothing_is_marked(spark):
    from pyspark.sql import functions as F

    pages = table(spark, "/root/testdata/sf0.1", "pages")
    rows = [(r["page_id"], r["url"], unmarked(r["html"])) for r in pages.collect()]
    own = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(own).collect()}
    template = plain_template([(u, h) for _, u, h in rows])
    host_ids = {r["page_id"]: r["host"] for r in own.select("page_id", F.xxhash64(html_text.host_of(F.col("url"))).alias("host")).collect()}
    changed = 0
    for i, url, page in rows:
        host, h = re.match(r"[a-z]+://([^/:?#]*)", url).group(1), host_ids[i]
        root = html_text.parse(page)
        html_text.seal(root)
        keys = {html_text._mixed(k, h) for k in template.get(host, ())} | ({html_text._mixed(html_text.KNOWN, h)} if host in template else set())
        assert got[i] == html_text.article(root, keys, h)
        changed += got[i] != html_text.article(root, set())
    assert changed > 0.9 * len(rows)
    want = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    assert all(set(want[i].split("\n")) <= set(got[i].split("\n")) for i in want)
    assert sum(got[i] == want[i] for i in want) > 0.9 * len(rows)


def test_wrappers_with_odd_names_keep_the_article(spark):
    page = '<body><div class="content has-sidebar"><h1>Head {0}</h1><p>Story {0}</p></div></body>'
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i}\nStory {i}" for i in range(6)}


def test_menus_with_other_entries_recur(spark):
    page = "<body><div><ul>{0}</ul></div><div><h1>Head {1}</h1><p>Story {1} with <a href=x>one</a> link</p><ul><li>item {1}</li></ul></div></body>"
    rows = [(i, f"http://a.example/{i}", page.format("".join(f"<li><a href=/{i}{k}>entry {i} {k}</a></li>" for k in range(3 + i % 3)), i)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i}\nStory {i} with one link\nitem {i}" for i in range(9)}


def test_the_article_tag_is_not_needed(spark):
    from pyspark.sql import functions as F

    pages = table(spark, "/root/testdata/sf0.1", "pages")
    renamed = pages.withColumn("html", F.regexp_replace("html", "<(/?)(article|main)\\b", "<$1div"))
    want, got = ({r["page_id"]: r["text"] for r in html_text.main_text(p).collect()} for p in (pages, renamed))
    assert got == want


@pytest.mark.parametrize("page", ["<div>" * 500_000 + "</section>" * 300_000, "<a " * 1_500_000, "<b>" * 400_000 + "<div></div>" * 300_000, "<i><div>" + "<b>" * 700_000 + "</i>" * 700_000, '<a ">" ' * 800_000, "<![" * 1_500_000, "<li><div>" * 300_000 + "</li>" * 300_000])
def test_large_odd_pages_take_linear_time(page):
    import time

    began = time.perf_counter()
    root = html_text.parse(page)
    html_text.seal(root)
    html_text.subtrees(root)
    html_text.article(root, {html_text._mixed(html_text.KNOWN, 0)})
    assert time.perf_counter() - began < 60


def test_subtrees_of_a_large_host_are_joined_in_parts(spark, sf_dir, monkeypatch):
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", "url", "regexp_replace(html, '<(/?)(nav|footer|article)', '<$1div') html")
    want = sorted(map(tuple, html_text.main_text(pages).collect()))
    monkeypatch.setattr(html_text, "PART", 2)
    assert sorted(map(tuple, html_text.main_text(pages).collect())) == want


def test_pages_with_clashing_columns(spark):
    rows = [(i, f"http://a.example/{i}", f"<div>Site of pages</div><p>Story {i}</p>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 host", "2 rid", "3 key", "4 salt", "5 text", "6 n_chars", "7 slot", "8 content")
    for most in (1_000_000, 1):
        assert {r["page_id"]: r["text"] for r in html_text.main_text(pages, most_hashes=most).collect()} == {i: f"Story {i}" for i in range(5)}


def test_no_pages(spark):
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
