"""Operators that work on each row alone: tokens, packing, pages, media, languages, quality."""

import collections
import hashlib
import html
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import html_extract, language_id, media, packing, quality, token_count

from .conftest import TEXTS

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = st.text(st.characters(codec="utf-8") | st.sampled_from(list(" '.,<|>stendofx\n\té́İΣ½²")), max_size=60) | st.sampled_from(["<|endoftext|>", "a<|startoftext|>b", "can't I'LL x½.", "aaaaaaa", "\x1c\x85"])


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_counts_and_ids_are_the_librarys(texts):
    expected = [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]
    assert token_count.merger(PATH).count_texts(pa.array(texts)).tolist() == [len(x) for x in expected]
    ids, bounds = packing.encoder(PATH).encode(pa.array(texts), 1)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [x + [1] for x in expected]


CUTS = st.lists(st.sampled_from(["'s", "'LL", "don't", "'", "<|", "|>", "<|endoftext|>", "<|EndOfText|>", "The", "É", "e\u0301", "Σ", "İ", "²", "١٢", "12", "...", "!?", " ", "\n", "\t", "\x85", "中", "Ж"]), max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(CUTS | ODD, min_size=1, max_size=5), st.integers(0, 8))
def test_ids_are_the_librarys_whatever_is_kept(texts, kept):
    own, texts = packing.encoder(PATH), [*texts, "x" * 100, *texts]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "KEPT_WORDS", kept)
        for part in (pa.array(texts), pa.array(["é", *texts]).slice(1)):
            ids, bounds = own.encode(part, 1)
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [TOKENIZER.encode(t, add_special_tokens=False).ids + [1] for t in texts]
            assert len(own.words) <= kept


def test_a_word_of_an_earlier_part_is_not_encoded_again():
    texts = pa.array([f"word{chr(97 + i % 26)}{chr(97 + i // 26)} Größe{i}, don't{i}" for i in range(600)])
    own = packing.ChunkEncoder(PATH)
    ids, bounds = own.encode(texts, 1)
    own.plain = own.whole = None
    again = own.encode(texts, 1)
    assert again[0].tolist() == ids.tolist() and again[1].tolist() == bounds.tolist()


def test_other_vocabularies_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, texts = Tokenizer.from_file(path), ["Hello  there, I'm é\n x 12", "", " Hello"]
    ids, bounds = packing.ChunkEncoder(path).encode(pa.array(texts), 1)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_token_counts_of_edge_rows(edge_docs, no_docs):
    rows = sorted(token_count.token_counts(edge_docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    expected = sorted(((i, len((t or "").encode()), len(TOKENIZER.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in TEXTS), key=lambda r: (r[0] is None, r[0]))
    assert [tuple(r)[:3] for r in rows] == expected
    assert [r.over_limit for r in rows] == [n > 2048 for _, _, n in expected]
    assert token_count.token_counts(no_docs).collect() == []


def check_packing(rows, docs, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
    for doc, texts in docs.items():
        ids = [TOKENIZER.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert len({tuple(x) for x in ids}) == 1
        spans = sorted((p.start, p.length) for p in by_doc[doc])
        covered = np.zeros(len(ids[0]), int)
        for a, n in spans:
            covered[a : a + n] += 1
        assert (covered == len(texts)).all()
        for p in by_doc[doc]:
            assert p.doc_tokens == len(ids[0])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[0][p.start : p.start + p.length], "<u4").tobytes())
    sizes = [sum(p.length for p in s) for s in by_sequence.values()]
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in sizes) / max(1, sum(sizes))


def test_packing(edge_docs, no_docs, documents):
    docs = {}
    for i, t, _ in TEXTS:
        docs.setdefault(i, []).append(t or "")
    check_packing(packing.pack(edge_docs).collect(), docs)
    assert packing.pack(no_docs).collect() == []
    rows = packing.pack(documents.repartition(3)).collect()
    assert check_packing(rows, {r.doc_id: [r.text or ""] for r in documents.select("doc_id", "text").collect()}) < 0.01
    with pytest.raises(ValueError):
        packing.pack(documents, capacity=1000)


def test_class_bins_take_a_fixed_number():
    assert packing.cuts(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    bins = packing.Bins(2048, 3)
    rows = [r for i in range(64) for r in bins.add((i, 0, 32, bytes(128), 32))]
    assert len(rows) == 64 and {r[5] for r in rows} == {3 << 40} and not bins.open


def test_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    for r in html_extract.extract_main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>") if "</article>" in r.html else len(r.html)]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("just text", "just text"),
        ("<div class=menu><a href=x>Home</a></div><p>Hello <i>world</i> &amp; all<p>two<br>three<div id='comments'><p>nope</div>", "Hello world & all\ntwo three"),
        ("<nav>menu<article><p>a<p>b</article>", "a\nb"),
        ("<script>var x='<p>no</p>';</script><p>yes</p><!-- <p>no</p> --><style>p{}</style>", "yes"),
        ("<form><p>Name</p></form><main><h1>T</h1><p>x &lt;b&gt;</p></main><footer>f</footer>", "T\nx <b>"),
        ("<p>un<b closed", "un<b closed"),
        ("<aside>side</aside><article><p>one</p><div class='newsletter-signup'>mail</div><p>two</p></article>", "one\ntwo"),
        ("<body><div class=top><a href=x>Start</a></div><div class=post>" + "<p>Many words stand in this paragraph here.</p>" * 9 + "<div class=ad>Buy</div><p>The end.</p></div><div class=box>Tiny</div></body>", "\n".join(["Many words stand in this paragraph here."] * 9 + ["The end."])),
        ("<ul><li><a href=a>Home page of us</a></li><li><a href=b>About the company</a></li></ul><p>" + "The story goes on. " * 9 + "</p>", ("The story goes on. " * 9).strip()),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


BODY = ["The council met on Monday and spoke about the new bridge over the river.", "It will be built next year, the mayor said after the meeting."] * 3


@pytest.mark.parametrize("hint", ["<article><h2><a href=x>Another story</a></h2><p>A short teaser.</p></article>", "<main><h1>The bridge</h1></main>"])
def test_body_outside_a_teaser_article(hint):
    page = f"<body>{hint}<div class=text>" + "".join(f"<p>{t}</p>" for t in BODY) + "</div></body>"
    assert [t for t in html_extract.main_text(page).split("\n") if t in BODY] == BODY


def test_small_parts_of_an_article_stay():
    long, short = "Many words stand in this paragraph here. " * 15, "So ends the story of the bridge over the river, and no more was said of it to this day."
    for parted in ("", "<div class=ad>Buy</div>"):
        page = f"<body><div><div><p>{short}</p></div>{parted}<section><p>{long}</p></section>{parted}<section><h2>End</h2><p>{short}</p></section></div><div class=box>Tiny</div></body>"
        assert html_extract.main_text(page) == "\n".join([short, long.strip(), "End", short])


def test_links_in_main_are_no_text():
    links = "".join(f"<li><a href=x>Some other page {i}</a></li>" for i in range(8))
    page = "<main><ul>" + links + "</ul>" + "".join(f"<p>{t}</p>" for t in BODY) + "<ul>" + links + "</ul></main>"
    assert html_extract.main_text(page) == "\n".join(BODY)


PROSE = "".join(f"<p>{t}</p>" for t in BODY)


@pytest.mark.parametrize(
    "page, text",
    [  # boxes without a telling name or class, or with one that misleads
        (f"<body><div><div><a href=/>Home</a> <a href=/n>News</a></div><div><span>Log in</span> <span>Sign up</span></div></div><div><h1>The bridge</h1>{PROSE}</div><div><h3>You may also like</h3><ul><li><a href=x>A tunnel</a></li><li><a href=y>A ferry</a></li></ul></div><div>\xa9 2024 Example Corp. All rights reserved.</div></body>", ["The bridge", *BODY]),
        (f"<body><div id=page><div><a href=/>Home</a></div><div><div><h1>The bridge</h1></div><div>{PROSE}</div></div><div>Imprint, terms and privacy. \xa9 Example</div></div></body>", ["The bridge", *BODY]),
        (f"<body><table><tr><td><a href=a>One</a><br><a href=b>Two</a></td><td>{PROSE}</td><td>Weather: 12 degrees</td></tr></table></body>", BODY),
        (f"<form id=aspnet><div class=topbar>Search here</div><div>{PROSE}</div></form>", BODY),
        (f"<div class=search>{PROSE}</div><p>Tiny</p>", BODY),
        (f"<article><div class='entry-header'><h1>Title</h1></div>{PROSE}<section class='reviews'><p>The reviews were good and many.</p></section></article>", ["Title", *BODY, "The reviews were good and many."]),
        (f"<div><h1>The bridge</h1><p>A lead of one sentence.</p><div>{PROSE}</div></div>", ["The bridge", "A lead of one sentence.", *BODY]),
        (f"<div>{PROSE}</div><div class=comments>{PROSE * 3}</div>", BODY),
        (f"<article>{PROSE}</article><article><h2><a href=x>Another story</a></h2><p>A short teaser.</p></article>", BODY),
        (f"<div>{PROSE}</div><div class=cookie-consent><p>We use cookies. They help us to make this page better for you.</p></div>", BODY),
    ],
)
def test_boxes_that_tell_nothing(page, text):
    assert html_extract.main_text(page).split("\n") == text


@pytest.mark.parametrize("part", ["<a x='", "<b c ", "<a \"<a >\"", "<div>", "<div class=ad>", "<div></x>", "<!--", "</p>", "<p>x", "<article>", "&amp", "<a x=\"'>", "<h1><ul>"])
def test_a_megabyte_of_broken_markup(part):
    began = time.perf_counter()
    html_extract.main_text(part * (1_000_000 // len(part)) + "'")
    assert time.perf_counter() - began < 20  # a second or two


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("<>/!-p diva='\"&;")), max_size=60))
def test_no_markup_breaks_it(page):
    html_extract.main_text(page)


def test_page_edge_rows(spark):
    rows = html_extract.extract_main_text(spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>x", 2), (1, None, None, 3)], "page_id long, url string, html string, text int"))
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(1, None, "", 0), (None, "u", "x", 1), (1, None, "", 0)], key=str)


def test_media(edge_docs, no_docs):
    rows = media.media_round_trip(edge_docs).collect()
    assert len(rows) == len(TEXTS) and media.media_round_trip(no_docs).collect() == []
    by_text = {}
    for r in rows:
        text = next((t or "").encode() for i, t, _ in TEXTS if i == r.doc_id)
        payload = text + b" " * (-len(text) % 192 or (0 if text else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.corrected and r.media_bytes > r.payload_bytes - 1 or r.actual == "image/png"
        assert by_text.setdefault(text, tuple(r)[1:]) == tuple(r)[1:]


def test_carving_and_correction(spark):
    payload = b"z" * 384
    files = {}
    for i in range(40):
        kind, data = media.store(payload + bytes([i]) * 192)
        files[kind] = data
    assert len(files) == 4
    both = b"noise BM GIF89a " + files["image/png"] + b" RIFF " + files["audio/wav"] + b"\xff\xd8\xff"
    assert [(k, len(files[k])) for k, _, _ in media.sniff(both)] == [(k, n) for k, _, n in media.sniff(both)] and len(media.sniff(both)) == 2
    df = spark.createDataFrame([(1, bytearray(files["image/bmp"]), "image/png"), (2, None, None), (3, bytearray(both), "text/plain"), (4, bytearray(files["image/png"][:-1]), "image/png")], "id long, b binary, declared string")
    rows = {r.id: r for r in media.sniff_column(df, "id", "b", "declared").collect()}
    assert rows[1].actual == "image/bmp" and rows[1].corrected
    assert rows[2].media == [] and rows[2].actual is None and not rows[2].corrected
    assert not rows[3].corrected and [m.type for m in rows[3].media] == ["image/png", "audio/wav"]
    assert rows[4].media == []


def test_validators():
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    assert media.sniff(b"xx" + gif + b"yy") == [("image/gif", 2, len(gif))]
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x04ab\xff\xda\0\x04ab12\xff\0\x01\xff\xd93"
    assert media.sniff(jpeg) == [("image/jpeg", 0, len(jpeg) - 1)]
    import gzip

    packed = gzip.compress(b"hello" * 50, mtime=0)
    assert media.sniff(b"a" + packed + b"b") == [("application/gzip", 1, len(packed))]
    pdf = b"%PDF-1.4 x startxref 9 %%EOF"
    assert media.sniff(pdf + b"..") == [("application/pdf", 0, len(pdf))]


def test_language(edge_docs, no_docs, documents):
    rows = language_id.held_out_language(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 2
    edge = language_id.held_out_language(edge_docs).collect()
    assert len(edge) == len(TEXTS)
    assert {r.doc_id for r in edge if r.lang_pred == "und"} == {3, 4, 5, 6} and all(r.rejected and r.score == 0 for r in edge if r.lang_pred == "und")
    assert language_id.held_out_language(no_docs).collect() == []
    model = language_id.train(documents)
    assert language_id.accepted(edge_docs, model).columns == edge_docs.columns
    far = pa.array(["Быстрая коричневая лиса прыгает через ленивую собаку у старого берега реки"])
    assert model.predict(far)[2].tolist() == [True]


def plain_kneser_ney(counts, order):
    """p(language, n-gram): the last character's probability after the others, straight from the definition."""
    letters = len({c for own in counts.values() for w in own for c in f"{w} "}) + 1
    tables = {}
    for lang, own in counts.items():
        raw, left = collections.Counter(), collections.defaultdict(set)
        for w, n in own.items():
            w = f" {w} "
            for end in range(1, len(w)):
                for size in range(1, min(order, end + 1) + 1):
                    g = w[end + 1 - size : end + 1]
                    if size == order or size == end + 1:
                        raw[g] += n
                    else:
                        left[g].add(w[end - size])
        for g, x in left.items():
            raw[g] += len(x)
        tables[lang] = raw

    def p(lang, g):
        if not g:
            return 1 / letters
        raw = {x: n for x, n in tables[lang].items() if len(x) == len(g)}
        after = [n for x, n in raw.items() if x[:-1] == g[:-1]]
        below = p(lang, g[1:])
        if not after:
            return below
        once, twice = sum(n == 1 for n in raw.values()), sum(n == 2 for n in raw.values())
        d = min(max(once / max(1, once + 2 * twice) or 0.5, 0.1), 0.95)
        return (max(raw.get(g, 0) - d, 0) + d * len(after) * below) / sum(after)

    return p


@settings(max_examples=25, deadline=None)
@given(st.lists(st.dictionaries(st.text("abc\u00e9", min_size=1, max_size=7), st.integers(1, 4), min_size=1, max_size=6), min_size=1, max_size=3), st.lists(st.text("abcdz", min_size=1, max_size=8), min_size=1, max_size=5))
def test_kneser_ney_against_its_definition(samples, words):
    counts = {f"l{k}": collections.Counter(x) for k, x in enumerate(samples)}
    words += [w for x in samples for w in x][:5]
    model = language_id.kneser_ney(counts)
    p = plain_kneser_ney(counts, language_id.ORDER)
    got = model.word_scores(words)
    for i, w in enumerate(words):
        padded = f" {w} "
        for k, lang in enumerate(model.languages):
            nats = -sum(np.log(p(lang, padded[max(0, end + 1 - language_id.ORDER) : end + 1])) for end in range(1, len(padded)))
            assert abs(nats - got[i, k]) < 1e-3 * max(1, nats)


def test_marks_are_no_letters(spark):
    model = language_id.kneser_ney({"a": collections.Counter({"abc": 3})})
    rows = [(1, "\u0301\u0302 \u0301 12"), (2, "abc"), (3, "e\u0301")]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert out[1].lang_pred == "und" and out[1].rejected and out[1].score == 0 and out[2].lang_pred == out[3].lang_pred == "a"


def test_unfinished_documents_take_no_time():
    began = time.perf_counter()
    assert media.sniff(b"%PDF-1" * 200_000) == [] and media.sniff(b"%PDF-1 startxre " * 100_000 + b"%%EOF") == []
    found = media.sniff(b"%PDF-1 startxref 0 %%EOF" * 3)
    assert [x[1:] for x in found] == [(0, 24), (24, 24), (48, 24)] and time.perf_counter() - began < 10


def test_quality(edge_docs, no_docs, spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = quality.classify(documents).join(labels, "doc_id").select("keep", labels["quality"].alias("label")).collect()
    assert sum(r.keep == bool(r.label) for r in rows) >= 0.95 * len(rows)
    edge = {r.doc_id: r for r in quality.classify(edge_docs).collect()}
    assert not any(edge[i].keep or edge[i].quality for i in (3, 4, 5)) and edge[1].quality == edge[2].quality
    assert quality.classify(no_docs).collect() == []


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.8
    votes = np.full((20000, 5), -1)
    for k in range(5):
        wrong = rng.random(20000) < np.where(good, 0.01, 0.3)
        silent = rng.random(20000) < 0.2
        votes[:, k] = np.where(silent, -1, np.where(wrong, ~good, good))
    patterns, counts = np.unique(quality.pattern_of(votes), return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float), 5)
    assert abs(model.good - 0.8) < 0.02 and abs(model.chances[:, 0, 0].mean() - 0.7) < 0.03
    assert ((model.posterior(quality.pattern_of(votes)) > 0.5) == good).mean() > 0.97


def test_em_against_a_plain_loop():
    rng = np.random.default_rng(3)
    votes = rng.choice([-1, 0, 1], size=(120, 4), p=[0.3, 0.2, 0.5])
    patterns, counts = np.unique(quality.pattern_of(votes), return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float), 4, rounds=25)
    belief = [0.001 if 0 in v else 0.98 for v in votes.tolist()]
    for _ in range(25):  # each text by itself, each heuristic by itself
        chance = [[[0.5, 0.5], [0.5, 0.5]] for _ in range(4)]
        for v, b in zip(votes.tolist(), belief):
            for k, x in enumerate(v):
                if x >= 0:
                    chance[k][0][x] += 1 - b
                    chance[k][1][x] += b
        chance = [[[x / sum(row) for x in row] for row in both] for both in chance]
        good = (sum(belief) + 1) / (len(belief) + 2)
        now = []
        for v in votes.tolist():
            p = [1 - good, good]
            for k, x in enumerate(v):
                if x >= 0:
                    p = [p[j] * chance[k][j][x] for j in (0, 1)]
            now.append(p[1] / sum(p))
        if max(abs(x - y) for x, y in zip(now, belief)) < 1e-7:
            break
        belief = now
    assert np.allclose(model.chances, chance, atol=1e-6) and abs(model.good - good) < 1e-6
    assert np.allclose(model.posterior(quality.pattern_of(votes)), now, atol=1e-6)


FOREIGN = [
    "De regering heeft gisteren besloten dat er meer geld naar het onderwijs gaat en dat scholen zelf mogen kiezen.",
    "Il governo ha deciso ieri che le scuole riceveranno piu soldi e potranno scegliere da sole come spenderli.",
    "Hallitus paatti eilen etta koulut saavat enemman rahaa ja voivat itse valita miten ne kayttavat sen.",
    "Rzad postanowil wczoraj ze szkoly otrzymaja wiecej pieniedzy i same zdecyduja jak je wydac.",
    "Regeringen beslutade att skolorna ska ha mer pengar och att de ska bestamma hur de anvands.",
    "xq zvkj wpfq jjkx vbnm qwrt zxcv plkj hgfd qzxw kjhg vvbn tgbq wwxz",
]


def test_foreign_texts_in_latin_letters_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out_condition()))
    assert model.predict(pa.array(FOREIGN))[2].all()
    texts = [r.text for r in docs.where(language_id.held_out_condition()).where("n_chars >= 300").collect()]
    assert model.predict(pa.array(texts))[2].mean() < 0.005


def test_a_language_without_tuning_texts_has_a_limit(spark):
    few = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(["one two three", "four five six", "ten"])], "doc_id long, text string, lang string")
    model = language_id.train(few)
    assert np.isfinite(model.limit).all() and model.predict(pa.array(["\u4e2d\u6587" * 30, "one two three"]))[2].tolist() == [True, False]
