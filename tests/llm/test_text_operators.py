"""Operators that work document by document: pages, BPE, token counts, toxicity, fingerprints."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import bpe, pages, spots, token_counts, toxicity

WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# ---- BPE


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, edges, tokenizer):
    got = bpe.encode_digests(edges, WORD_BPE).collect()
    assert len(got) == edges.count()
    by = {}
    for r in edges.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want = (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
        by.setdefault(r.doc_id, set()).add(want)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in by[r.doc_id]


def test_bpe_on_random_strings(tokenizer):
    rng = random.Random(1)
    letters = ["a", "Σ", "ß", "İ", "é", "é", "'s", "'LL", " ", "\n", "\x1c", "\x85", "　", "1", "²", "漢", "🙂", "<|endoftext|>", "!", "...", "in", "th", "tion", "aa", "haha", "​", "\x00", "ΌΣΟΣ", "_"]
    own = bpe.load(WORD_BPE)
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        ids = tokenizer.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == ids
        assert own.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_words_outlive_a_full_memory(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "MEMORY", 4)
    enc = bpe.Encoder(bpe.load(WORD_BPE))
    for text in ("one two three four five six", "six five four seven", "one seven nine"):
        assert enc.text(text)[0] == " ".join(map(str, tokenizer.encode(text, add_special_tokens=False).ids))


def test_encode_then_decode(spark, edges, no_docs, tokenizer):
    encoded = bpe.encode_documents(edges, WORD_BPE)
    got = {(r.doc_id, r.text) for r in bpe.decode_documents(encoded, WORD_BPE).collect()}
    want = {(r.doc_id, tokenizer.decode(tokenizer.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in edges.collect()}
    assert got == want
    assert bpe.encode_documents(no_docs, WORD_BPE).count() == 0


# ---- token counts


def plain_counts(tok: Tokenizer, sections: list[str], rule: str) -> list[int]:
    """Character by character from the library's own offsets, token bytes read one at a time."""
    text = "".join(sections)
    owner = [k for k, s in enumerate(sections) for _ in s]
    out = [0] * len(sections)
    first_of_byte = []
    for c, ch in enumerate(text):
        first_of_byte += [(c, i == 0) for i in range(len(ch.encode()))]
    at = 0
    letters = {x: b for b, x in enumerate(bpe.byte_letters())}
    for token in tok.encode(text, add_special_tokens=False).tokens:
        n = len([letters[x] for x in token])
        span = first_of_byte[at : at + n]
        at += n
        chars = [c for c, first in span if first] or [span[0][0]]
        homes = [owner[c] for c in chars]
        pick = {"start": homes[0], "end": homes[-1], "most": max(sorted(set(homes)), key=homes.count)}[rule]
        out[pick] += 1
    return out


@pytest.mark.parametrize("rule", ["most", "start", "end"])
def test_counts_follow_the_rule(rule):
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tok.encode_special_tokens = True
    enc, length = token_counts.load(RANKS, token_counts.PATTERN)
    rng = random.Random(3)
    for _ in range(400):
        sections = ["".join(rng.choice(["a", "é", "漢", "🙂", " ", "  ", "the", " of", "\n", "1"]) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 4))]
        got = token_counts.section_counts(lambda t: np.asarray(enc.encode_ordinary(t), np.int64), length, sections, rule)
        assert [g[3] for g in got] == plain_counts(tok, sections, rule)


def test_token_counts_over_lines_and_fields(spark, edges, no_docs, clashing):
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tok.encode_special_tokens = True
    got = token_counts.count_tokens(edges, RANKS).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).where("doc_id IS NOT NULL")
    got = {r.doc_id: r.n for r in got.collect()}
    want: dict[int, int] = {}
    for r in edges.where("doc_id IS NOT NULL").collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(tok.encode(r.text or "", add_special_tokens=False).ids)
    assert got == want
    assert token_counts.count_tokens(no_docs, RANKS).count() == 0
    fields = token_counts.count_tokens(clashing, RANKS, fields=("lang", "source", "text"))
    assert fields.count() == 3 * clashing.count()


# ---- pages


def test_pages_keep_the_article_only(spark):
    html = """<html><body class="has-sidebar"><header><h2>Site</h2></header><div id="cookie-notice">We use cookies</div>
    <nav><a>Home</a></nav><article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>&nbsp;text
    runs on.</p><div class="ad">Buy</div><p>ok<ul><li>one<li>two</ul><form>Mail <input></form><aside>By the way</aside>
    <script>var a = "<p>no</p>";</script></article><section id="comments"><p>Great!</p></section><footer>c</footer>"""
    cut = "<article><p>cut off <b>here &am"
    rows = [(1, "u", html), (2, None, None), (3, "u", ""), (None, "u", cut), (1, "u", html), (4, "u", "just text"), (5, "u", "<div><nav>menu</nav></div>")]
    got = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()
    text = {(r.page_id, r.text) for r in got}
    body = "Title & more\nFirst bold text runs on.\nok\none\ntwo"
    assert text == {(1, body), (2, ""), (3, ""), (None, "cut off here &am"), (4, "just text"), (5, "")}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.extract_pages(empty).count() == 0


def test_pages_without_an_article_use_the_ratio():
    long = "word " * 60
    html = f"<body><div><a>x</a><a>y</a><a>z</a></div><div><h1>Head</h1><p>{long}</p><p>short</p><p>{long}</p></div><div><a>p</a><a>q</a></div></body>"
    assert pages.main_text(html).split("\n") == ["Head", long.strip(), "short", long.strip()]


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div class='no-sidebar'", "section id='search-page'", "div class='sidebar'", "div class='header'"])
@pytest.mark.parametrize("body", ["<article>{}</article>", "<main>{}</main>", "{}"])
def test_pages_keep_their_text_in_named_wrappers(wrapper, body):
    long = "word " * 60
    html = f"<body><div class='site-nav'><a>Home</a></div><{wrapper}>{body.format(f'<p>{long}</p>')}</{wrapper.split()[0]}><div class='related-posts'><p>More of it</p></div></body>"
    assert pages.main_text(html) == long.strip()


def test_pages_with_an_article_use_the_ratio_too():
    """Regions outside the article are found, what has a low ratio is not, and a short article between them is whole."""
    long, more = "word " * 60, "more " * 50
    links = "".join(f"<a href='{k}'>x</a>" for k in range(9))
    html = f"<body><div>{links}</div><article><h1>A</h1><p>{long}</p><p>ok</p></article><div><h2>On</h2><p>{more}</p><p>tiny</p><p>{more}</p></div><article><h2>B</h2><p>A few words of B.</p></article><div>{links}</div></body>"
    assert pages.main_text(html).split("\n") == ["A", long.strip(), "ok", "On", more.strip(), "tiny", more.strip(), "B", "A few words of B."]


def test_pages_leave_comments_out():
    long = "word " * 30
    html = f"<body><article><p>{long}</p></article><div class='comments'><article><p>{'reply ' * 90}</p></article></div></body>"
    assert pages.main_text(html) == long.strip()


def test_pages_of_the_table(spark):
    """Against a plain reading of the tables' one page layout."""
    import html as h
    import re

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in df.select("html").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert pages.main_text(r.html) == "\n".join(b for b in blocks if b)


# ---- toxicity


def auc(score, label) -> float:
    pos, neg = [s for s, y in zip(score, label) if y], [s for s, y in zip(score, label) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(7)
    plain = [f"{a}{b}{c}" for a in "ka lo mi tu".split() for b in "ren sol tar vin".split() for c in ("", "a", "em")]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        if i % 4 == 0:
            for _ in range(2 + len(words) // 30):
                words.insert(rng.randint(0, len(words)), rng.choice(["grobnak", "zwurfelt", "quixblat"]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    train = [r for r in rows if r[0] % 5]
    model = toxicity.fit(spark.createDataFrame(train, "doc_id long, text string, toxic int"))
    held = [r for r in rows if r[0] % 5 == 0]
    got = {r.doc_id: r.score for r in toxicity.score_documents(spark.createDataFrame(held, "doc_id long, text string, toxic int"), model).collect()}
    assert auc([got[r[0]] for r in held], [r[2] for r in held]) > 0.95
    assert np.mean([(got[r[0]] >= 0.5) == r[2] for r in held]) > 0.9


def test_toxicity_edges(spark, edges, no_docs, clashing):
    labels = spark.createDataFrame([(1, "a b c", None), (2, None, 1)], "doc_id long, text string, toxic int")
    model = toxicity.fit(labels)
    got = toxicity.score_documents(edges, model).collect()
    assert len(got) == edges.count() and {r.score for r in got} == {0.0}
    one = toxicity.fit(spark.createDataFrame([(1, "a b c", 1)], "doc_id long, text string, toxic int"))
    assert one.prior == 1.0 and one.weights is None
    trained = toxicity.train([(i, f"{'awful grim ' * (i % 2)}word{i % 7} calm{i % 5} sea", i % 2) for i in range(200)])
    scores = toxicity.score_documents(clashing, trained)
    assert scores.where("score BETWEEN 0 AND 1").count() == clashing.count()
    assert toxicity.score_documents(no_docs, trained).count() == 0
    kept = toxicity.keep_ordinary(clashing, trained)
    assert kept.columns == clashing.columns and kept.count() <= clashing.count()
    same = scores.where("doc_id = 22").select("score").distinct().count()
    assert same == 1


# ---- fingerprints


def plain_signatures(text: str | None) -> set[str]:
    import re

    words = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    anchors = set(spots.ANCHORS)
    content = [(w, i) for i, w in enumerate(words) if w not in anchors]
    digest = lambda s: hashlib.md5(s.encode()).hexdigest()[:8]
    if not content:
        return {digest(" ".join(words))} if words else set()
    out = set()
    for k, (w, i) in enumerate(content):
        anchor = "^" if i == 0 else words[i - 1] if words[i - 1] in anchors else "^" if k == 0 else None
        if anchor:
            out.add(digest(" ".join([anchor, w, *(c for c, _ in content[k + 1 : k + 2])])))
    return out


def test_fingerprints_of_edge_texts(spark, edges, no_docs):
    got = spots.fingerprints(edges.where("doc_id <> 28 OR doc_id IS NULL")).collect()
    for r in got:
        assert set(r.sigs) == plain_signatures(r.text) and r.sigs == sorted(set(r.sigs))
    assert spots.edit_report(no_docs).count() == 0


def test_next_document_and_edited_text(spark, edges, clashing):
    rows = [(r.doc_id, r.text or "") for r in edges.where("doc_id IS NOT NULL").collect()]
    rows = sorted(set(rows), reverse=True)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in spots.edit_report(df).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        assert got[i].edited_sha256 == sha(edited) and got[i].n_chars == len(t)
        if "İ" not in t + following:
            a, b, c = (plain_signatures(x) for x in (t, edited, following))
            assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
            assert got[i].near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
    assert spots.edit_report(clashing).count() == clashing.count()


@pytest.mark.parametrize("ring", [1_000_000, 2])
def test_next_document_across_buckets(spark, monkeypatch, ring):
    """Ids far apart, in one and in several levels of buckets."""
    monkeypatch.setattr(spots, "RING", ring)
    ids = [5, 7, 3000, 2**22, 2**22 + 1, 2**40, 2**58, 2**58 + 2**30]
    df = spark.createDataFrame([(i, f"text number {i}") for i in ids], "doc_id long, text string")
    got = {r._id: r._next_text for r in spots.with_next(df).collect()}
    down = sorted(ids, reverse=True)
    assert got == {i: f"text number {n}" for i, n in zip(down, down[1:] + down[:1])}


def test_near_pairs_by_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(25):
        words = [rng.choice(["the", "of", "and", *(f"w{k}" for k in range(60))]) for _ in range(120)]
        texts.append(" ".join(words))
        for share in (2, 6, 20):
            other = list(words)
            for _ in range(share):
                other[rng.randrange(len(other))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(other))
    texts.append(texts[0])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.a, r.b) for r in spots.near_pairs(df, 0.8).collect()}
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(frozenset(plain_signatures(t)), i)
    items = sorted((i, s) for s, i in sets.items())
    want = {(i, j) for x, (i, a) in enumerate(items) for j, b in items[x + 1 :] if len(a & b) >= 0.8 * len(a | b)}
    assert got == want and want


@pytest.mark.parametrize("text", [" " * 5_000_000 + "a", "a" + "\n" * 5_000_000 + "b c", " " * 5_000_000, "a" * 5_000_000], ids=["blanks", "lines", "end", "letters"])
def test_token_counts_of_long_runs(text):
    enc, length = token_counts.load(RANKS, token_counts.PATTERN)
    parts = token_counts.calm_parts(text)
    assert "".join(parts) == text
    ids = [i for p in parts for i in enc.encode_ordinary(p)]
    assert length[ids].sum() == len(text)


def test_cuts_in_long_runs_change_no_token():
    enc, _ = token_counts.load(RANKS, token_counts.PATTERN)
    rng = random.Random(4)
    for _ in range(60):
        space = rng.choice([" ", "\n", " \n", "\u3000 ", "\t"])
        text = "".join(rng.choice(["a", "the end", "12", "!", "\x1c", "", "é"]) + space * rng.choice([0, 1, 2, 700, 1500]) for _ in range(6))
        assert [i for p in token_counts.calm_parts(text) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_token_counts_of_a_table_with_a_long_run(spark):
    df = spark.createDataFrame([(1, " " * 1_500_000 + "a\nb"), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.section): r for r in token_counts.count_tokens(df, RANKS).collect()}
    assert got[1, 0].n_chars == 1_500_002 and got[1, 1].n_chars == 1 and got[2, 0].n_tokens == 0


@pytest.mark.parametrize(
    "html",
    ["<div>word " * 100_000, "<div><header>" * 50_000 + "text", "<i>" * 100_000 + "<li>a</li>" * 50_000, "<b>" * 100_000 + "</x>" * 100_000 + "end", "<article>" * 60_000 + "<p>one<p>two", "<section id=ad>" * 60_000 + "t" * 100],
    ids=["open", "headers", "implied", "stray", "articles", "named"],
)
def test_deep_pages_take_linear_time(html):
    start = time.process_time()
    text = pages.main_text(html)
    assert time.process_time() - start < 20
    assert text or "header" in html


def test_pages_of_a_table_with_a_deep_and_a_missing_one(spark):
    rows = [(1, "u", "<div>" * 20_000 + "<article><p>Some words of a text, and more of it.</p></article>"), (2, None, None), (3, "v", "")]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Some words of a text, and more of it.", 2: "", 3: ""}
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
