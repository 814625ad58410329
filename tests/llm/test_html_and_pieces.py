import math
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from plumbline.llm import html_extract as h, piece_tokens as pt

MODEL = public_tokenizers.path("piece_bpe_32k.model")

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/a>About us, the people</a></ul></nav>
<div class="cookie-notice">We use cookies. Please, accept them all.</div><!-- ad --><div class=ad>Buy this, now.</div>
%s
<aside class="sidebar"><p>Side text, long enough to look like content. It goes on, and on.</p></aside>
<form><label>Name</label><input><button>Send</button></form>
<section id="comments"><p>I disagree, strongly. This comment is long, very long, and has commas.</p></section>
<footer>&copy; 2020, all rights.</footer></body></html>"""
BODY = "<h1>A &amp; B</h1><p>First   paragraph,\n with <b>bold</b> text.<br>And more.<p>Short<ul><li>Item one<li>Item two</ul><table><tr><td>Cell<td>Two</table><script>x='</p>'</script>"
TEXT = "A & B\nFirst paragraph, with bold text. And more.\nShort\nItem one\nItem two\nCell\nTwo"


@pytest.mark.parametrize("home", ["<article>%s</article>", "<div class='story-body'>%s</div>", "<div><div>%s</div></div>", "<main>%s</main>"])
def test_article_without_furniture(home):
    assert h.extract(PAGE % (home % BODY)) == TEXT


def test_ratios_find_unnamed_content():
    links = "".join(f"<div class=links><a href=/{k}>Link number {k} to somewhere</a></div>" for k in range(20))
    words = "<div class=txt>" + "".join(f"<p>Sentence {k}, with words, and more words. Then, another one.</p>" for k in range(5)) + "</div>"
    got = h.extract(f"<body>{links}{words}{links}</body>")
    assert got.count("\n") == 4 and "Link" not in got


REAL = "".join(f"<p>Sentence {k}, with words, and more words. Then, another one.</p>" for k in range(5))
REAL_TEXT = "\n".join(f"Sentence {k}, with words, and more words. Then, another one." for k in range(5))


@pytest.mark.parametrize("wrapper", ['<div class="page no-sidebar">%s</div>', '<div id="main-content" class="has-sidebar">%s</div>', '<div class="overflow-hidden">%s</div>', '<div class="sidebar-left">%s</div>',
                                     '<div class="w-1/2">%s</div>', '<form id="form">%s</form>', '<main class="skip"><div class="widget">%s</div></main>'])
@pytest.mark.parametrize("home", ["<article>%s</article>", "<div>%s</div>", "%s"])
def test_a_furniture_word_never_takes_the_page(wrapper, home):
    assert h.extract("<body><div class=ad>Buy this, now.</div>" + wrapper % (home % REAL) + "</body>") == REAL_TEXT


def test_subjects_named_like_furniture_stay():
    page = f"""<article><h1>T</h1>{REAL}<section id="discussion"><h2 id="related-work">Related work</h2><p>Others did so, and well.</p></section>
        <div id="legal-history"><p>It was, in short, legal. Then it was not, and so on, for years.</p></div></article>"""
    assert h.extract(page) == f"T\n{REAL_TEXT}\nRelated work\nOthers did so, and well.\nIt was, in short, legal. Then it was not, and so on, for years."


def test_paths_decide_inside_and_outside_articles():
    links = "<div class=more><ul>" + "".join(f"<li><a href=/{k}>Link number {k} to somewhere</a></li>" for k in range(20)) + "</ul></div>"
    comment = "<article class='comment'><p>I disagree, strongly. This comment is long, and has commas.</p></article>"
    assert h.extract(f"<article><header><h1>T</h1></header><div class=text>{REAL}</div>{links}</article>{comment}") == f"T\n{REAL_TEXT}"
    assert h.extract(f"<body><h1>T</h1>{REAL}{links}</body>") == f"T\n{REAL_TEXT}"
    assert h.extract("<main><a href=/>All of it, linked.</a></main>") == "All of it, linked."


def test_extract_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav><a>x</a></nav>"), (4, "u", "plain text, no tags"), (4, "u", "plain text, no tags"), (None, "u", "<p>&lt;p&gt; &#233;&nbsp;x"), (6, "u", "<" * 1000),
            (7, "u", "<p>" + "long words, " * 20000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in h.extract_pages(pages).collect()]
    assert got[:6] == [(1, "", 0), (2, "", 0), (3, "", 0), (4, "plain text, no tags", 19), (4, "plain text, no tags", 19), (None, "<p> é x", 7)]
    assert got[7][2] == 12 * 20000 - 1
    assert h.extract_pages(pages.limit(0)).count() == 0


TEXTS = ["", "a", " ", "   lead and   gaps ", "tabs\tand\nlines\r\n", "aaaaaaaaaaaaaaa", "漢字 and ☃ 𝔘nicode é", "The internationalisation of tokenisation, 2024.", "x" * 3000, "ha " * 500]


def test_ids_equal_the_library(spark):
    random.seed(3)
    texts = TEXTS + ["".join(random.choice("ab etniñ.1") for _ in range(random.randint(1, 80))) for _ in range(300)]
    v = pt.load(MODEL)
    got = [x.tolist() for x in pt.encode_texts(texts, v, {})]
    assert got == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts)
    assert [pt.decode_ids(x, v) for x in got] == texts


def test_unigram_has_the_best_score(tmp_path):
    model = proto.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    for k, piece in enumerate(model.pieces):
        if piece.type == 1:
            piece.score = -math.log(3 + k) - (k * 7919 % 1000) / 5000
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    v = pt.load(str(path))
    texts = TEXTS[3:4] + TEXTS[7:8] + ["shared prefix sharing shares shared pre"]
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    for text, ids in zip(texts, pt.encode_texts(texts, v, {})):
        score = lambda x: sum(v.scores[k] for k in x)
        assert score(ids) >= score(library.encode(text)) - 1e-4 and pt.decode_ids(ids, v) == text


def test_shared_prefixes_change_nothing():
    v = pt.load(MODEL)
    words = ["▁the", "▁thesis", "▁theses", "▁them", "▁t", "▁zebra", "xyz", "x"]
    together = dict(pt.encode_words(words, v))
    assert together == {w: next(pt.encode_words([w], v))[1] for w in words}


def test_encode_decode_frames(spark, docs):
    rows = docs([(1, "one two"), (1, "one two"), (None, None), (2, ""), (3, "one\ntwo")])
    out = pt.decode(pt.encode(rows, MODEL, keep=("source",)), MODEL, keep=("source",)).collect()
    assert [(r["doc_id"], r["text"]) for r in out] == [(1, "one two"), (1, "one two"), (None, ""), (2, ""), (3, "one\ntwo")]
    assert pt.encode(docs([]), MODEL).count() == 0
