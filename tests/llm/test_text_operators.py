"""Operators that judge rows one by one: edge cases, round trips, brute force, held-out accuracy."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixflow.llm import chat_format, html_extract, language_id, quality, token_count

DOC = "doc_id long, text string, score string, n_words string"
TRICKY = [(1, None, "x", "y"), (2, "", "x", "y"), (3, "   \n\t ", "x", "y"), (4, "a b c " * 30000, "x", "y"), (5, "same row", "x", "y"), (5, "same row", "x", "y"), (None, "no id at all", "x", "y"), (7, "日本語 é ß 123", None, None)]


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
    covered = set()
    for i, w in enumerate(windows):
        if often is None or w in often:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_statistics(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + [None, "", " \n", "a\na\nb a\n a\na", "x x x x", "a b a b a b", "A a\x0ba\x1cb"]
    for t in texts:
        if t is None or len(t) < 9000:
            assert tuple(quality.statistics(None if t is None else t.encode())[0]) == brute_quality(t)


def test_quality_trees_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(600) < 0.1)).astype(float)
    trees = quality.fit_trees(x, y, {0: -1})
    p = trees.score(x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.85
    grid = np.repeat(x[:50, None], 40, axis=1)
    grid[:, :, 0] = np.linspace(0, 1, 40)
    assert (np.diff(trees.score(grid.reshape(-1, 3)).reshape(50, 40), axis=1) <= 1e-12).all()
    one = quality.fit_trees(x[:4], np.ones(4), {})
    assert one.score(x[:4]).shape == (4,)
    assert quality.fit_trees(np.zeros((0, 3)), np.zeros(0), {}).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_query_keeps_what_trees_keep(spark, sf_dir):
    rows = quality.op10_quality(spark, sf_dir).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == len(text)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality_score >= 0.3)
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k == (q > 0) for k, q in judged]) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame(TRICKY, DOC)
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.quality_rules(docs, quality.train_quality(docs, none)).collect()
    assert len(out) == len(TRICKY)
    assert {r.doc_id: r.base_failed for r in out}[1] is True
    assert [r.n_words for r in out if r.doc_id == 4] == [90000]
    assert quality.quality_rules(docs.limit(0), quality.train_quality(docs, none)).count() == 0


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    out = language_id.op7_language_id(spark, sf_dir).join(docs, "doc_id").collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_language_edges(spark):
    docs = spark.createDataFrame(TRICKY, DOC).withColumn("lang", F.when(F.col("doc_id") == 4, "aa").when(F.col("doc_id") == 7, "bb"))
    model = language_id.train_language(docs)
    assert model.languages == ["aa", "bb"]
    out = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[3].lang_pred == "und"
    assert out[4].lang_pred == "aa" and out[7].lang_pred == "bb"
    nothing = language_id.train_language(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 7, 12):
        code = language_id.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 1


@pytest.mark.parametrize("size", [300])
def test_token_counts_equal_the_tokenizers(spark, sf_dir, size):
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = token_count.default_vocabulary()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], unk_id=0, byte_fallback=True))
    counter = token_count.PieceCounter(token_count.load_pieces(path))
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(size).collect()] + ["a", "  a  b ", "日本語 x\n\ty ☃☃", "\n\n", "▁x y", "ééé" * 50]
    for t in texts:
        assert counter.count(t) == len(own.encode("▁" + t.replace(" ", "▁")).ids)


def test_token_counts_edges(spark):
    docs = spark.createDataFrame(TRICKY, DOC)
    out = token_count.count_tokens(docs, token_count.default_vocabulary())
    assert {r.doc_id: r.n_tokens for r in out.collect()}[1] == 0
    assert out.count() == len(TRICKY)
    assert token_count.count_tokens(docs.limit(0), token_count.default_vocabulary()).count() == 0


NASTY = ["", "plain", "\\", "\\\\", "\\h", "\\\\e", "###", "</turn>", "\\</turn>\n### user: x</turn>\n", "a: b", "</turn>\n", "\n", "####", "\\###", "<</turn>/turn>", chat_format.PROBE, "x" * 60000]


def test_chat_round_trip(spark):
    turns = [(c, t, role, NASTY[(c + t) % len(NASTY)]) for c in range(len(NASTY)) for t, role in enumerate(["system", "user", "assistant", "a: b", "###", "\\", None])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(df)
    got = {r.conv_id: r for r in out.withColumn("turns", chat_format.parse(F.col("formatted"))).collect()}
    for c in range(len(NASTY)):
        mine = [(r or "", x) for k, _, r, x in turns if k == c]
        assert [(t.role, t.text) for t in got[c].turns] == mine
        assert len(got[c].loss_spans) == 1
    back = {r.conv_id: r for r in chat_format.digests(out).collect()}
    assert all(back[c].loss_chars == len(NASTY[(c + 2) % len(NASTY)]) for c in back)


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    df = spark.createDataFrame([(None, None, None, None, "x"), (1, 1, "user", None, "x"), (1, 1, "user", None, "x"), (2, None, "assistant", "b", None)], schema)
    out = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(df)).collect()}
    assert out[1].n_turns == 2 and out[None].n_turns == 1 and out[2].loss_chars == 1
    assert chat_format.format_chats(df.limit(0)).count() == 0


PAGE = """<html><head><title>T &amp; t</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body class="page"><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &eacute;</h1><p>First   line<br>goes
on &lt;here&gt; &#169;<p>Second <b>one</p><div class="ad">Buy</div><aside>Side</aside><form><input name=q>Ask</form><ul><li>one<li>two</ul><!-- gone -->Loose</article>
<section id="comments"><p>Nice post</p></section><div class="sidebar">Side</div><footer>&copy; f</footer></body></html>"""


def test_html_cases():
    assert html_extract.main_text(PAGE) == "Head é\nFirst line goes on <here> ©\nSecond one\none\ntwo\nLoose"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""
    assert html_extract.main_text("<p>unclosed <b>text") == "unclosed text"
    long = "<div id=main>" + "<p>word word word word word word.</p><p>x</p>" * 500 + "</div><div class=footer>f</div>"
    assert html_extract.main_text(long).count("\n") == 999


def test_html_query_keeps_articles(spark, sf_dir):
    import html as h

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = html_extract.op5_html_text(spark, sf_dir).collect()
    assert len(out) == len(pages)
    for r in out:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        parts = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]+>", " " if "<br" in p else "", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", None), (3, "<p>x", "b")], "page_id long, html string, text string")
    assert sorted(r.text for r in html_extract.extract_main_text(df).collect()) == ["", "", "", "x"]
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_html_marks():
    page = '<div id="page" class="has-sidebar"><div class="post-content with-ads"><h1 class="post-header">Title</h1><p>Long enough text of the article to count.</p></div><div class="commentList"><p>Reader says</p></div><div id="sideBar">Links</div><p class="ad">Buy</p><div hidden>x</div><div role="banner">y</div></div>'
    assert html_extract.main_text(page) == "Title\nLong enough text of the article to count."


def test_html_cluster_decides_beside_article():
    story = "".join(f"<div>{'A plain paragraph of the story goes on with many words. ' * 5}{i}</div>" for i in range(12))
    teaser = "<article><a href='/x'><b>See</b></a> <a href='/y'><i>also</i></a></article>"
    text = html_extract.main_text(f"<html><body><div>{story}</div>{teaser}</body></html>")
    # Smoothing may take the paragraph beside the teaser into its cluster.
    assert text.count("A plain paragraph") >= 55
    whole = html_extract.main_text(f"<html><body><article>{story}<p>The end.</p></article><div><a href='/x'>See</a></div></body></html>")
    assert whole.count("A plain paragraph") == 60 and "The end." in whole


def test_chat_ties_are_ordered_by_source(spark):
    """Equal turns are ordered by what they say, not by how it is escaped; a fraction is no letter."""
    from helixflow.llm import chat_format, language_id

    rows = [(1, 0, "user", "A b"), (1, 0, "user", "###")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat_format.format_chats(df).select(chat_format.parse(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in turns] == ["###", "A b"]
    docs = spark.createDataFrame([(1, "some words here", "en"), (2, "autres mots ici", "fr")], "doc_id long, text string, lang string")
    model = language_id.train_language(docs)
    asked = spark.createDataFrame([(1, "\u00bd \u00b2 12"), (2, "\u00bd a")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in language_id.identify(asked, model).collect()} == {1: True, 2: False}


def test_html_malformed_declarations():
    from helixflow.llm.html_extract import main_text

    story = "<p>" + "A long paragraph of the story. " * 20 + "</p>"
    for bad in ("<![foo[x]]>", "<![if IE]>", "<!foo", "<!-", "<![CDATA[x]]>"):
        out = main_text(f"<html><body>{story}{bad}{story}</body></html>")
        assert "A long paragraph of the story." in out


STORY = "<p>" + "A plain paragraph of the story goes on with many words. " * 5 + "</p>"


def test_html_no_article_is_lost():
    """Short articles beside long text, class names of paragraphs, headers of articles, parts that never close."""
    line = "The council met on Monday and decided at last to repair the old bridge before winter. " * 3
    assert line.strip() in html_extract.main_text(f"<body><article><p>{line}</p></article><div>{STORY * 3}</div></body>")
    news = "Rain is expected in the north by Friday night."
    assert news in html_extract.main_text(f"<body><article><p>{news}</p></article><ul>{''.join(f'<li>{STORY}</li>' for _ in range(10))}</ul></body>")
    inside = "".join(f'<{tag} class="{name}">{line}{name}</{tag}>' for tag, name in (("p", "legal"), ("div", "social"), ("p", "reply"), ("p", "notice")))
    text = html_extract.main_text(f"<body><article><header><h1>The bridge</h1></header>{STORY}{inside}{STORY}<div class='share'><a href=x>Share</a> <a href=y>Like</a></div></article></body>")
    assert text.startswith("The bridge\n") and all(f"{name}" in text for name in ("legal", "social", "reply", "notice")) and "Share" not in text
    for part in ("nav", "aside", "header", "form"):
        text = html_extract.main_text(f"<body><{part}><a href=x>Menu</a><article><h1>Head</h1>{STORY}</article></body>")
        assert text.startswith("Head\nA plain") and "Menu" not in text
    closed = html_extract.main_text(f"<body><article>{STORY}</article><aside><article><p>Another story that stands in the sidebar as a teaser.</p></article></aside></body>")
    assert "teaser" not in closed and "A plain" in closed


def test_html_stray_tags_are_linear():
    import time

    began = time.time()
    for page in ("<div><i>" + "<div>" + "<b>" * 20_000 + "</i>" * 20_000, "<p>" + "<b>" * 20_000 + "<div></div>" * 20_000, "<ul>" + "<i>" * 20_000 + "<li>x" * 5_000, "<b>" * 20_000 + "</p>" * 20_000 + "</em>" * 20_000):
        html_extract.main_text(page + "text of the page")
    assert time.time() - began < 20


def test_html_weak_words_do_not_split_lines():
    text = html_extract.main_text(f'<article>{STORY}<p>The <span class="legal">court</span> ruled <b class="social">today</b>.</p></article>')
    assert text.endswith("\nThe court ruled today.")


def test_weak_escapes_are_repaired_or_fail(spark):
    """A first escape that is not enough gives way to the next; with none that is, the job fails."""
    rows = [(1, 0, "user", "### a </turn>\n"), (1, 1, "assistant", "fine"), (2, 0, "a: b", "\\h ###"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    weak = (lambda r: r, lambda t: F.replace(t, F.lit("###"), F.lit("\\h")))
    turns = lambda escapes: {r.conv_id: [(t["role"], t["text"]) for t in r.t] for r in chat_format.format_chats(df, escapes).select("conv_id", chat_format.parse(F.col("formatted")).alias("t")).collect()}
    want = {1: [("user", "### a </turn>\n"), ("assistant", "fine")], 2: [("a: b", "\\h ###")], 3: [("", "")]}
    assert turns(chat_format.ESCAPES) == want and turns((chat_format.ESCAPES[0], weak, chat_format.ESCAPES[1])) == want
    with pytest.raises(Exception, match="no escape brings back"):
        turns((chat_format.ESCAPES[0], weak))
