import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, html_extract, line_dedup, quality, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "mine", "mine") for i, t, s in rows], DOCS)


# quality classifier


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def labelled(spark, n=300):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        t = prose(rng, rng.randrange(20, 200))
        rows.append((i, t if good else re.sub(r"\b(\w+)\b", lambda m: m.group().upper() + "!!", t), "s"))
        labels.append((i, int(good), 0))
    rows += [(1000, None, None), (1001, "", "s"), (None, "abc def.", "s"), (1002, "x " * 60_000, "s"), (5, rows[5][1], "s")]
    labels += [(7777, 1, 0), (None, 1, 0), (1001, None, 0)]
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    d, labels = labelled(spark)
    got = {}
    for r in quality.classify(d, labels).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        got[r.doc_id] = r
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 40 and all(r.predicted == (r.doc_id % 3 > 0) for r in held)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values() if r.doc_id is not None)
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 300} == {i for i in range(300) if i % 3}


def test_quality_never_reads_held_out_labels(spark):
    d, labels = labelled(spark, 150)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.classify(d, x).collect()} for x in (labels, flipped))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_quality_without_a_class_or_rows(spark):
    d, labels = labelled(spark, 30)
    assert {r.score for r in quality.classify(d, labels.where("quality = 1")).collect()} == {0.5}
    assert quality.classify(d.limit(0), labels).count() == 0
    assert quality.keep_good(d, labels.where("quality = 1")).count() == 0
    named = d.withColumn("Score", F.lit("mine")).withColumn("doc_", F.lit("mine"))
    kept = quality.keep_good(named, labels)
    assert kept.columns == named.columns and {r.Score for r in kept.collect()} == {"mine"}


def test_cholesky_scores_equal_direct_densities():
    rng = np.random.default_rng(0)
    n = len(quality.FEATURES)
    xs = {k: rng.normal(size=(200, n)) * (1 + k) + k for k in (0, 1)}
    sums = {k: np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel())) for k, x in xs.items()}
    m = quality.Discriminant.of(sums)
    own = [np.cov(xs[k].T, bias=True) for k in (0, 1)]
    shared = (own[0] + own[1]) / 2
    out = []
    for k in (0, 1):
        cov = (1 - quality.POOLED) * own[k] + quality.POOLED * shared
        cov = (1 - quality.IDENTITY) * cov + quality.IDENTITY * np.diag(np.diag(shared))
        away = xs[1][:5] - xs[k].mean(0)
        out.append(np.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away))
    assert np.allclose(m.raw(xs[1][:5]), out[1] - out[0])


# HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var x="</p><p>no</p>";</script></head><body>
<header class="site-header"><p>Site name</p></header><nav><ul><li><a href=1>Home</a><li><a href=2>About</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="top-ad" class="ad">Buy this</div><aside>Side text</aside><main><article><h1>Title {n}</h1><p>First   para&shy; of {n} &lt;b&gt;<p>Second <b>bold</b><br>line {n}
<ul><li>one<li>two {n}</ul><form><input value=x>Your name</form><section class="comments"><p>Nice post!</p></section></article></main><footer>&copy; Foot</footer></body></html>"""
WANT = "Title {n}\nFirst para\xad of {n} <b>\nSecond bold line {n}\none\ntwo {n}"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, token string")


def test_html(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=i)) for i in range(6)] + [(50, "http://alone.example/", PAGE.format(n=50)), (51, None, "just &eacute;  text"), (52, "http://a.example/x", None), (53, "http://b.example", "")]
    rows += [(54, "http://c.example", "<div class=menu><a href=1>m</a></div><div>Body <i>text</i></div><div>more"), (0, "http://a.example/0", PAGE.format(n=0)), (55, "http://d.example", "<p>" + "long " * 100_000)]
    got = {r.page_id: r for r in html_extract.extract(pages(spark, rows)).collect()}
    assert all(got[i].text == WANT.format(n=i) for i in (*range(6), 50))
    assert (got[51].text, got[52].text, got[53].text, got[54].text) == ("just é text", "", "", "Body text\nmore")
    assert got[55].n_chars == 499_999 and all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract(pages(spark, rows)).count() == len(rows) and html_extract.extract(pages(spark, [])).count() == 0


def test_html_template_slots(spark):
    """Without telling names, linked slots and slots with the same text on all pages are no content."""
    page = '<html><body><div id="x1"><a href=1>Home page</a> <a href=2>Contact us</a></div><div id="x2">Same words on every page</div><div id="x3"><p>Own words {n} with <a href=3>a link</a> in them</p></div></body></html>'
    rows = [(i, f"http://h.example/{i}", page.format(n=i)) for i in range(5)]
    got = html_extract.extract(pages(spark, rows)).collect()
    assert sorted(r.text for r in got) == [f"Own words {i} with a link in them" for i in range(5)]


def test_html_template_of_part_of_a_host(spark):
    """Null, empty, cut and error pages of a host do not end its template."""
    page = '<html><body><div id="x1"><a href=1>Home page</a> <a href=2>Contact us</a></div><div id="x2">Same words on every page</div><div id="x3"><p>Own words {n} with <a href=3>a link</a> in them</p></div></body></html>'
    rows = [(i, f"http://h.example/{i}", page.format(n=i)) for i in range(5)]
    rows += [(10, "http://h.example/a", None), (11, "http://h.example/b", ""), (12, "http://h.example/c", "<html><body><h1>Not found</h1></body></html>"), (13, "http://h.example/d", page[:130])]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert [got[i] for i in range(5)] == [f"Own words {i} with a link in them" for i in range(5)]
    assert (got[10], got[11], got[12]) == ("", "", "Not found") and "Home page" not in got[13]


def test_html_keeps_article_text(spark):
    """Words of classes and ids of an article's own parts, and words in other attributes, cut nothing."""
    body = (
        '<header class="entry-header"><h1>Head</h1></header><h2 id="how-to-search">Two</h2><section id="related-work">Three</section><p class="notice">Four</p>'
        '<div id="form-factor">Five</div><p title="a hidden gem">Six</p><section data-id="search">Seven</section><p>Eight <a href="/hidden-x">and</a> on</p>'
    )
    want = "Head\nTwo\nThree\nFour\nFive\nSix\nSeven\nEight and on"
    rows = [(1, "http://a.example", f'<body><div class="has-sidebar"><article class="post share-on">{body}<nav>n</nav><div class="comments">c</div></article></div>')]
    rows += [(2, "http://b.example", '<body><h2 id="how-to-search">Two</h2><p title="a hidden gem">Six</p><section data-id="search">Seven</section>')]
    rows += [(i, "http://copies.example", "<body><div><p>The one article</p></div>") for i in (3, 4, 5, 5)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == {1: want, 2: "Two\nSix\nSeven"} | dict.fromkeys((3, 4, 5), "The one article")


PLAIN_PAGE = """<html><body><div class="q1"><a href=1>{m}</a> <a href=2>Contact {m}</a></div><div class="q2">Buy {n} now, {n} times</div>
<div class="q3"><p class="k1">Opening words of number {n} that are its own</p><div class="q9">Share this with all your friends</div><p>Middle {n} of the text, with its own words again {n}</p>
<p>Rate this text</p><div class="q7"><p>Inner part {n} with words</p></div></div><div class="q4">Made by {m} in {n}</div></body></html>"""
PLAIN_WANT = "Opening words of number {n} that are its own\nMiddle {n} of the text, with its own words again {n}\nInner part {n} with words"


def test_html_by_the_template_alone(spark, monkeypatch):
    """Meaningless names, no article element, notices inside the text: classes and masses decide."""
    rows = [(i, f"http://h.example/{i}", PLAIN_PAGE.format(n=i, m="abcdefgh"[i] * 3)) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == {i: PLAIN_WANT.format(n=i) for i in range(8)}
    off = html_extract.chosen(*html_extract.parse(rows[0][2]), {})
    assert "Buy 0 now, 0 times" in off and "Share this with all your friends" in off
    monkeypatch.setattr(html_extract, "FEW_BYTES", 0)
    monkeypatch.setattr(html_extract, "PAGES", 3)
    assert {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()} == got


def test_html_layouts_of_one_host(spark):
    """Pages of two layouts, and an error page, each have the main slot of their own classes."""
    other = '<html><body><div class="z1">Short {n}</div><section class="z2"><h1>Other {n}</h1><p>Long text of the other layout, page {n}, with many words in it</p></section></body></html>'
    rows = [(i, f"http://h.example/{i}", PLAIN_PAGE.format(n=i, m="abcdefgh"[i] * 3)) for i in range(5)] + [(10 + i, f"http://h.example/o{i}", other.format(n=i)) for i in range(4)]
    rows += [(20, "http://h.example/e", "<html><body><h1>Not found</h1></body></html>"), (21, "http://h.example/n", None)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert all(got[10 + i] == f"Other {i}\nLong text of the other layout, page {i}, with many words in it" for i in range(4))
    assert all("Middle" in got[i] and "Buy" not in got[i] and "Contact" not in got[i] for i in range(5)) and (got[20], got[21]) == ("Not found", "")


def templates_by_hand(pages):
    """host: {token: (constant, linked, chars)} by occurrence vectors written out in full."""
    hosts = {}
    for i, (host, page) in enumerate(pages):
        paths, blocks = html_extract.parse(page)
        if paths:
            hosts.setdefault(host, {})[i] = (html_extract.tokens_of(paths, blocks), "\n".join(b.text for b in blocks))
    out = {}
    for host, read in hosts.items():
        vectors = {}
        for i, (tokens, _) in read.items():
            for token, t in tokens.items():
                vectors.setdefault(token, {})[i] = t[0]
        kept = {}
        for token, vector in vectors.items():
            text, on_all = html_extract.TEXT in token, vector == vectors[""]
            contents = len({read[i][1] for i in vector})
            if set(vector.values()) != {1} or not (on_all and (not text or contents >= 3) or (not text and len(vector) >= 3)):
                continue
            held = [read[i][0][token] for i in vector]
            chars, linked = sum(t[2] for t in held), sum(t[3] for t in held)
            constant = contents >= 3 and len({tuple(t[4]) for t in held}) == 1
            kept[token] = (constant, linked / chars if chars else 0.0, chars / len(vector))
        closed = lambda t: t == "" or html_extract.TEXT in t or (t in kept and closed(t.rpartition("/")[0]))
        out[host] = {t: v for t, v in kept.items() if closed(t)}
    return out


def test_html_templates_against_written_out_vectors(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows += [(1000 + i, f"http://h.example/{i}", PLAIN_PAGE.format(n=i, m="abcdefgh"[i] * 3)) for i in range(6)] + [(1000, "http://h.example/0", PLAIN_PAGE.format(n=0, m="aaa")), (1010, "http://h.example/e", "<html><body><h1>Not found</h1></body></html>")]
    frame = pages(spark, rows).withColumn("host", html_extract.host_of())
    want = templates_by_hand([(r.host, r.html) for r in frame.collect()])
    got = {}
    for r in html_extract.templates(html_extract._tokens(frame)).collect():
        got.setdefault(r.host, {})[r.token] = html_extract.Slot(r.pages, r.constant, r.linked, r.chars, r.place)
    assert got.keys() == want.keys()
    for host, rows_of in got.items():
        held = html_extract.nested(rows_of)
        assert held.keys() == want[host].keys()
        for t, (constant, linked, chars) in want[host].items():
            assert held[t].constant == constant and abs(held[t].linked - linked) < 1e-9 and abs(held[t].chars - chars) < 1e-6


def test_html_on_the_given_pages(spark, sf_dir):
    """Each page's text is that of its article element, and the template changes what comes out."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = {r.page_id: r.text for r in html_extract.extract(rows).collect()}
    changed = 0
    for r in rows.collect():
        paths, blocks = html_extract.parse(r.html)
        assert text[r.page_id] == "\n".join(b.text for b in blocks if any(s.startswith("article") for s in b.path))
        changed += text[r.page_id] != "\n".join(html_extract.chosen(paths, blocks, {}))
    assert changed > len(text) / 2


def test_html_hot_host_in_parts(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "FEW_BYTES", 0)
    monkeypatch.setattr(html_extract, "PAGES", 3)
    rows = [(i, f"http://h.example/{i}", PAGE.format(n=i)) for i in range(40)]
    assert all(r.text == WANT.format(n=r.page_id) for r in html_extract.extract(pages(spark, rows)).collect())


# token counts


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "ledger")


def test_token_ledger(spark, folder):
    texts = ["The cat sat on the mat.", None, "", "don't 123 été\n\n  x", "w" * 3000, "a " * 20_000]
    d = docs(spark, [(i, t, "s" if i % 2 else None) for i, t in enumerate(texts)])
    enc = token_counts.encoder(token_counts.TOKENIZERS, token_counts.VERSION)
    want = {s: sum(len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts) if (i % 2 == 1) == (s == "s")) for s in ("s", None)}
    show = lambda: {r.source: (r.docs, r.tokens) for r in token_counts.totals(spark, folder).collect()}
    for _ in range(2):
        token_counts.commit(token_counts.changes(inserted=d), folder, "load")
        assert show() == {"s": (3, want["s"]), None: (3, want[None])}
    revised = d.where("doc_id = 0").withColumn("old_text", F.col("text")).withColumn("text", F.lit("The cat"))
    token_counts.commit(token_counts.changes(deleted=d.where("doc_id = 4"), revised=revised), folder, "second")
    after = want[None] - len(enc.encode_ordinary(texts[4])) - len(enc.encode_ordinary(texts[0])) + len(enc.encode_ordinary("The cat"))
    assert show()[None] == (2, after)
    token_counts.commit(token_counts.changes(deleted=d.where("source = 's'")), folder, "third")
    assert set(show()) == {None}
    token_counts.compact(spark, folder, folder + "2")
    assert {r.tokens for r in token_counts.totals(spark, folder + "2").collect()} == {after}
    with pytest.raises(ValueError):
        token_counts.commit(d, folder, "../x")
    assert token_counts.changes(inserted=d.limit(0)).count() == 0


def test_token_ledger_of_the_query_is_a_recount(spark, sf_dir):
    """Loads, revisions and deletions of the whole table give what a count of the rows that are left gives."""
    from tidemark.llm.queries import op5_token_counts

    enc, want = token_counts.encoder(token_counts.TOKENIZERS, token_counts.VERSION), {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        if (r.text or "").split():
            t = want.setdefault((r.source, r.lang, token_counts.VERSION), [0, 0, 0, 0])
            for i, v in enumerate((1, len(enc.encode_ordinary(r.text)), len(r.text.encode()), len(r.text.encode().split()))):
                t[i] += v
    assert {tuple(r[:3]): list(r[3:]) for r in op5_token_counts(spark, sf_dir).collect()} == want


def test_token_ledger_columns_and_attempts(spark, folder):
    d = docs(spark, [(1, "a b", "s")]).withColumn("sign", F.lit("mine")).withColumn("docs", F.lit("mine"))
    delta = token_counts.changes(inserted=d)
    delta.write.parquet(f"{folder}/attempts/load-crashed")
    assert token_counts.commit(delta, folder, "load") and not token_counts.commit(delta, folder, "load")
    assert [(r.docs, r.words) for r in token_counts.totals(spark, folder).collect()] == [(1, 2)]


# line dedup


def test_lines(spark):
    rows = [(i, f"own line {i}\n shared by all \r\n\nrare {i % 2}", f"site{i}") for i in range(12)] + [(100, "shared by all", None), (101, None, "site1"), (102, "", "site2"), (102, "", "site2"), (103, "x\n" * 50_000 + "shared by all", "site3")]
    got = {r.doc.doc_id: r for r in line_dedup.drop_boilerplate(docs(spark, rows), 10).collect()}
    assert got[3].doc.text == "own line 3\n\nrare 1" and got[3].n_removed == 1 and got[3].doc.key == "mine"
    assert (got[100].doc.text, got[101].doc.text, got[102].doc.text, got[103].n_removed) == ("", "", "", 1)
    assert line_dedup.drop_boilerplate(docs(spark, rows), 13).where("n_removed > 0").count() == 0
    assert line_dedup.drop_boilerplate(docs(spark, []), 10).count() == 0


def test_lines_near_the_threshold_are_counted_exactly(spark):
    rows = [(k * 1000 + i, f"line {k}", f"site{i}") for k in (9, 10, 11) for i in range(k)]
    found = line_dedup.boilerplate(docs(spark, rows), 10).count()
    assert found == 2


# decontamination

ITEMS = [
    (1, "A train leaves the old station at 9 and travels 60 miles every hour before Anna meets it near the bridge"),
    (2, "Short item with six words only"),
    (3, None), (4, "one two"), (5, ""),
    (6, "Say whether Tom gave 3 apples to the girl and whether Tom then kept 5 of the other apples"),
]


def tokens_of(text):
    """(token, placeholder or lower case, value of a slot or None) of a text, by regular expressions."""
    out, end = [], 0
    for m in re.finditer(r"[^\W_]+", text or ""):
        word, opens = m.group(), not out or re.search(r'[.!?:;\n"|]', text[end : m.start()])
        end = m.end()
        if re.fullmatch(r"\d+(st|nd|rd|th)?", word.lower()):
            kind = "<num>"
        elif word.lower() in decontaminate.UNITS:
            kind = "<unit>"
        else:
            kind = "<name>" if re.fullmatch(r"[^\W\d_][^\W_]*", word) and word[0].isupper() and word[1:].islower() and not opens else word.lower()
        out.append((word, kind, word.lower() if kind[0] == "<" else None))
    return out


def leaks_by_hand(docs, items):
    """(doc_id, item_id) for a small fixture, from tuples of words, placeholders and slots."""
    unspaced = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]"
    raw = lambda ts: [x for w, _, _ in ts for x in re.split(f"({unspaced})", w.lower()) if x]
    out, read = set(), [(d, tokens_of(t)) for d, t in docs]
    for item, text in items:
        mine = tokens_of(text)
        runs, n = raw(mine), min(13, len(raw(mine)))
        held = {tuple(runs[i : i + n]) for i in range(len(runs) - n + 1)} if n else set()
        size = min(8, len(mine))
        places = [i for i in range(len(mine) - size + 1) if sum(s is None for _, _, s in mine[i : i + size]) >= min(4, size)] if size >= 5 else []
        for doc, own in read:
            low = raw(own)
            if any(tuple(low[i : i + n]) in held for i in range(len(low) - n + 1)):
                out.add((doc, item))
            met = [(j, i) for j in range(len(own) - size + 1) for i in places if [t[1] for t in own[j : j + size]] == [t[1] for t in mine[i : i + size]]]
            groups, last = [list(met)], None
            for j, i in met:
                if last is None or i <= last:
                    groups.append([])
                groups[-1].append((j, i))
                last = i
            for group in groups:
                pairs = {(mine[i + k][2], own[j + k][2]) for j, i in group for k in range(size) if mine[i + k][2] is not None}
                agree = min(len({a for a, _ in pairs}), len({b for _, b in pairs})) / len(pairs) if pairs else 1.0
                if places and len({i for _, i in group}) / len(places) >= 0.5 and agree >= 0.8:
                    out.add((doc, item))
    return out


def test_decontamination_reads_tokens_as_expressions_would():
    texts = ["", "The 3rd man. Anna met BOB and Eve's Dog: Paris 1st 2ND 3xth 12km 5 km\nTo the Moon_base x2 v1st", "Él vio a Ñandú “Ana” dijo…Eva 漢字とAbc ½ ٣ ٣rd", "a" * 3000 + " Bb " + "9" * 3000, "\ud800 Xy z", "Ab", "!?", "one\ttwo\x0bThree\u00a0Four|Five"]
    joined = decontaminate.Texts(texts)
    plain = joined.plain()
    codes = joined.canonical(plain).code
    place = {1: "<num>", 2: "<unit>", 3: "<name>"}
    got = [[] for _ in texts]
    for d, a, b, c in zip(plain.doc, plain.start, plain.end, codes):
        word = joined.whole[a:b]
        got[d].append((word, place.get(int(c), word.lower()), word.lower() if int(c) in place else None))
    assert got == [tokens_of(t) for t in texts]
    one = decontaminate.Texts([texts[1]])
    assert (one.plain().code == plain.code[plain.doc == 1]).all()


def test_decontamination(spark):
    rng = random.Random(2)
    item = ITEMS[0][1]
    rows = [
        (0, prose(rng, 50) + ". " + item + ". " + prose(rng, 30), "s"), (1, item.replace("9", "11").replace("60", "75").replace("Anna", "Maria").replace("miles", "km"), "s"), (2, item.upper() + " " + prose(rng, 9), "s"),
        (3, prose(rng, 400), "s"), (4, None, "s"), (5, " ", "s"), (6, "here: short item, with SIX words only!", "s"), (7, " ".join(item.split()[:6]), "s"), (None, item, "s"),
        (8, "Say whether Bob gave 7 apples to the girl and whether Bob then kept 9 of the other apples", "s"), (9, "Say whether Bob gave 7 apples to the girl and whether Ann then kept 7 of the other apples", "s"), (0, item, "s"), (10, prose(rng, 20_000) + " " + item, "s"),
    ]
    d, b = docs(spark, rows), spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string")
    for few in (10**9, 0):
        found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b, few).collect()}
        assert found == {(0, 1), (1, 1), (2, 1), (6, 2), (8, 6), (10, 1)}
    single = [r for r in rows if r[0] not in (None, 0)]
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, single), b).collect()} == leaks_by_hand([r[:2] for r in single], ITEMS)
    left = decontaminate.drop_contaminated(d, b)
    assert left.columns == d.columns and sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(map(str, [3, 4, 5, 7, 9, None]))
    assert decontaminate.contaminated(docs(spark, []), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_decontamination_of_a_question_held_twice(spark):
    first, second = (ITEMS[5][1].replace("Tom", n).replace("3", a).replace("5", b) for n, a, b in (("Bob", "7", "9"), ("Joe", "8", "6")))
    rows = [(0, first + ". And now " + second, "s"), (1, ITEMS[5][1] + ". " + first, "s"), (2, first.replace("then kept", "then soon kept") + ". " + second.replace("7", "1"), "s"), (3, first.replace("whether Bob then", "whether Ann then"), "s")]
    b = spark.createDataFrame(ITEMS + ITEMS[5:], "item_id long, text string")
    for d in (docs(spark, rows), docs(spark, rows + rows)):
        found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}
        assert found == {(0, 6), (1, 6), (2, 6)} == leaks_by_hand([r[:2] for r in rows], ITEMS)


def test_decontamination_finds_verbatim_copies(spark):
    """Items that are short, dense in numbers or names, or without spaces, and long excerpts of long items."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(59)]
    items = [(1, "Two plus two"), (2, "12 + 30 = 42, 7 + 8 = 15, 9 + 1 = 10"), (3, "Anna Berg, Carl Dorn, Eva Falk, Gus Holm, Ida Jung"), (4, "今天天气很好我们一起去公园散步"), (5, " ".join(words)), (6, None), (7, "!?")]
    rows = [(1, "so two plus two it is"), (2, "see 12 + 30 = 42, 7 + 8 = 15, 9 + 1 = 10 there"), (3, "here: " + items[2][1]), (4, "他说今天天气很好我们一起去公园散步吧"), (5, "x y " + " ".join(words[10:35]) + " z")]
    rows += [(6, "see 13 + 30 = 42, 7 + 8 = 15, 9 + 1 = 11 there"), (7, " ".join(words[:12])), (8, "两个 plus"), (9, None), (10, "")]
    d, b = docs(spark, [(*r, "s") for r in rows]), spark.createDataFrame(items, "item_id long, text string")
    for few in (10**9, 0):
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b, few).collect()} == {(i, i) for i in range(1, 6)} == leaks_by_hand(rows, items)


# chat


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("line", F.lit("mine"))


def conversation(rng, conv, n):
    say = lambda k: "\n".join(prose(rng, rng.randrange(3, 20)) for _ in range(k))
    rows = [(conv, 0, "system", say(1))] if rng.random() < 0.4 else []
    for i in range(len(rows), n):
        user = not rows or rows[-1][2] != "user"
        rows.append((conv, i, "user" if user else "assistant", say(1) + "?" if user else say(rng.randrange(1, 5))))
    return rows


def test_chat_round_trip_and_hot_conversation(spark):
    rng = random.Random(7)
    rows = [r for c in range(30) for r in conversation(rng, c, rng.randrange(2, 9))] + conversation(rng, 99, 400)
    got = sorted(chat.format_chats(turns(spark, rows), 16).collect(), key=lambda r: (r.conv_id, r.turn, r.line))
    assert "".join(r.rendered for r in got) == "".join(f"<|{role}|>\n{text}\n" for _, _, role, text in sorted(rows))


def test_chat_recovers_missing_markers_as_one_pass_would(spark):
    rng = random.Random(8)
    rows = [r for c in range(40) for r in conversation(rng, c, 6)]
    model = chat.train(turns(spark, rows))
    raw = [(1, i, 0, 0, line) for i, line in enumerate(["Human: hello there?", "fine, it is a long day and a long way to go from here to there.", "Q: and you?", "[assistant]: well", "more of it", "USER> bye?"] * 12)]
    lines = spark.createDataFrame(raw, "conv_id long, turn long, part long, line int, text string")
    scores = model.scores(np.array([chat.observed(r[4]) for r in raw])[:, [0, 2, 3]])
    whole = model.paths(scores, np.array([0]), np.array([len(raw)]), np.array([True]), np.array([0]))
    got = sorted(chat.decode(chat.observe(lines), model, 5).collect(), key=lambda r: r.turn)
    states = []
    for r in got:
        role = chat.ROLES.index(r.role)
        states += [role + (3 if r.continued else 0)] + [role + 3] * (r.n_lines - 1)
    score = lambda path: model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:])) + sum(scores[i, s] for i, s in enumerate(path))
    assert abs(score(states) - score(whole)) < 1e-9
    assert [r.role for r in got if not r.continued][:2] == ["user", "user"] or got[0].role == "user"


def test_chat_markers_on_whole_lines():
    assert chat.marker(" " * 76 + "user's are many") == (0, 0) and chat.marker("\t" * 85 + "user: hi") == (2, 91)
    for line, role, rest in (("[assistant]: well", 3, "well"), ("USER> bye?", 2, "bye?"), ("**Human** : x", 2, "x"), ("<|system|>", 1, ""), ("A: yes", 3, "yes"), ("a long way", 0, "a long way"), ("user", 0, "user"), ("user  ", 0, "user  "), ("#user :", 2, ""), ("", 0, ""), ("bot|] hm", 3, "hm")):
        mark, at = chat.marker(line)
        assert (mark, line[at:]) == (role, rest), line
    assert chat.marker("user" + " " * 200_000 + "x") == chat.marker(" " * 200_000) == chat.marker("[" * 200_000) == (0, 0)


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, None, None, "x"), (None, 0, "robot", "a\nb"), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, 0, "user", "y" * 50_000)]
    got = chat.format_chats(turns(spark, rows)).collect()
    assert sum(r.n_lines for r in got) == 7 and all(r.role in chat.ROLES for r in got)
    assert chat.format_chats(turns(spark, [])).count() == 0
