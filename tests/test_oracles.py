"""Every query of the engine against its SQL on the smallest tables."""

import hashlib
import html.parser

import pytest

from lorespark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(name, spark, sf, duck, same):
    df = registry.QUERIES[name](spark, sf)
    got = duck.execute(registry.ORACLE[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert same(df.columns, [tuple(r) for r in df.collect()]) == same(columns, got.fetchall())


class Blocks(html.parser.HTMLParser):
    """Headings and paragraphs of a page, in order."""

    ENDS = {*(f"h{i}" for i in range(1, 7)), "p", "article", "div", "body", "html", "footer", "ul", "table"}

    def __init__(self):
        super().__init__()
        self.found, self.kind, self.text, self.hidden = [], None, "", 0

    def close_block(self):
        if self.kind and (text := " ".join(self.text.split())):
            self.found.append((self.kind, text))
        self.kind, self.text = None, ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "nav"):
            self.hidden += 1
        if tag in self.ENDS:
            self.close_block()
        if tag == "p" or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.kind = "text" if tag == "p" else "title"
        elif self.kind:
            self.text += " "

    def handle_endtag(self, tag):
        if tag in ("script", "style", "nav"):
            self.hidden -= 1
        if tag in self.ENDS:
            self.close_block()
        elif self.kind:
            self.text += " "

    def handle_data(self, data):
        if self.kind and not self.hidden:
            self.text += data


def test_html_blocks_by_a_parser(spark, sf):
    got = {}
    for r in registry.QUERIES["src_07_html_blocks"](spark, sf).orderBy("document_id", "reading_order").collect():
        got.setdefault(r.document_id, []).append((r.type, r.text))
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = {}
    for r in pages:
        p = Blocks()
        p.feed(r.html)
        p.close_block()
        if p.found:
            want[str(r.page_id)] = [(k, hashlib.md5(t.encode()).hexdigest()) for k, t in p.found]
    assert got == want and got


def test_every_query_has_sql_or_a_test():
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"src_07_html_blocks"}
