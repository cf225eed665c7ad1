"""What the template does by itself, and the given pages read by another parser."""

from html.parser import HTMLParser

from tidemark.llm import html_extract


class Article(HTMLParser):
    """All text of a page's article elements, but for what scripts and styles hold."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.off, self.texts = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.off += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.off -= tag in ("script", "style")

    def handle_data(self, data):
        if self.depth > 0 and not self.off:
            self.texts.append(data)


def squeezed(text):
    return "".join(text.split())


def read(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("host", html_extract.host_of())
    held = {}
    for r in html_extract.templates(html_extract._tokens(rows)).collect():
        held.setdefault(r.host, {})[r.token] = html_extract.Slot(r.pages, r.constant, r.linked, r.chars, r.place)
    return rows.collect(), {h: html_extract.nested(t) for h, t in held.items()}


def test_texts_are_those_of_another_parser(spark, sf_dir):
    got = {r.page_id: r.text for r in html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        other = Article()
        other.feed(r.html)
        assert squeezed(got[r.page_id]) == squeezed("".join(other.texts))


def test_the_template_without_words_and_words_without_it(spark, sf_dir, monkeypatch):
    """Without class words the template gives the article on nearly every page; a template of its root alone then gives it on none."""
    rows, templates = read(spark, sf_dir)
    parsed = [(r.host, *html_extract.parse(r.html)) for r in rows]
    article = ["\n".join(b.text for b in blocks if any(s.startswith("article") for s in b.path)) for _, _, blocks in parsed]
    roots = {h: {"": t[""]} for h, t in templates.items()}
    same = lambda held: sum("\n".join(html_extract.chosen(paths, blocks, held[h])) == a for (h, paths, blocks), a in zip(parsed, article))
    with_words = same(roots)
    monkeypatch.setattr(html_extract, "_says_no", lambda *_: False)
    monkeypatch.setattr(html_extract, "_says_no_in_main", lambda *_: False)
    counts = {"words alone": with_words, "template alone": same(templates), "neither": same(roots)}
    print(counts, len(rows))
    assert counts["template alone"] >= 0.95 * len(rows) and counts["neither"] == 0
