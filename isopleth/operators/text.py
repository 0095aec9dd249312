"""Web pages to records: links, titles, dates, markdown."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.functions.scalar import slug

#: English month names, in order.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def without(html: Column, *tags: str) -> Column:
    """Markup without whole elements of these names."""
    for t in tags:
        html = F.regexp_replace(html, rf"(?is)<{t}\b[^>]*>.*?</{t}>", "")
    return html


def links(pages: DataFrame, drop: tuple[str, ...] = ("aside",)) -> DataFrame:
    """(page_id, pos, href): links in order, each once a page, those in dropped elements left out."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(without(F.col("html"), *drop), F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return found.groupBy("page_id", "href").agg(F.min("pos").alias("pos"))


def unescape(s: Column) -> Column:
    """The five entities that markup needs."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def title(html: Column) -> Column:
    return unescape(F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)))


def long_date(text: Column) -> Column:
    """The first "Month DD, YYYY" of a text as a date; null without one."""
    pattern = rf"({'|'.join(MONTHS)}) (\d{{1,2}}), (\d{{4}})"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(1))
    return F.to_date(F.concat(part(3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(2), 2, "0")))


def plain(html: Column) -> Column:
    """The text of markup: no tags, the five entities read, white space joined."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, "<[^>]*>", " ")), r"\s+", " "))


def classed(html: Column, names: str) -> Column:
    """The text of the first element one of whose classes holds one of the names (a|b); null without one."""
    return F.nullif(plain(F.regexp_extract(html, rf'(?is)<(\w+)\b[^>]*\bclass="[^"]*(?:{names})[^"]*"[^>]*>(.*?)</\1>', 2)), F.lit(""))


#: The pattern of a date in words.
DATE_WORDS = r"[A-Z][a-z]+ \d{1,2}, \d{4}"


def posts(pages: DataFrame, at_most: int = 200) -> DataFrame:
    """(page_id, title, iso_date, date, author, categories) of blog posts (page_id, html); a part that isn't there is an empty text.

    The title is the entry's, else the first heading's, else made of the id. The date is the first one in words of what the
    page says about its posting, else all of that. Categories are the texts of links to categories, each once, sorted. The
    author is the by-line, else what follows "Author:" or "Authors:" in the text up to a full stop.
    """
    html, none = F.coalesce("html", F.lit("")), F.lit("")
    h1 = F.nullif(plain(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)), none)
    said = F.coalesce(classed(html, "posted-on|entry-date"), F.nullif(plain(F.regexp_extract(html, r"(?is)<time\b[^>]*>(.*?)</time>", 1)), none), none)
    dated = F.coalesce(F.nullif(F.regexp_extract(said, DATE_WORDS, 0), none), F.trim(F.regexp_replace(said, r"^Posted on\s*", "")))
    links_ = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*\bhref="[^"]*(?:\?cat=|/category/)[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    byline = F.substring(F.trim(F.regexp_replace(classed(html, "author|byline"), r"^(?:Author|By)\s*", "")), 1, 120)
    named = F.substring(F.trim(F.regexp_extract(unescape(F.regexp_replace(html, r"(?i)<br\s*/?>|</p>|<[^>]*>", "\n")), r"Authors?:\s*([^\n.]+)", 1)), 1, at_most)
    return pages.select(
        "page_id", F.coalesce(classed(html, "entry-title"), h1, F.concat(F.lit("post-"), F.col("page_id").cast("string"))).alias("title"),
        F.regexp_extract(html, r'(?is)<time\b[^>]*\bdatetime="(\d{4}-\d{2}-\d{2})', 1).alias("iso_date"), dated.alias("date"),
        F.coalesce(F.nullif(byline, none), named).alias("author"), F.array_sort(F.array_distinct(F.transform(links_, plain))).alias("categories"),
    )


def words(text: Column) -> Column:
    """How many words a text has."""
    t = F.trim(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


class _Markdown(HTMLParser):
    skipped = {"script", "style", "nav", "aside", "footer", "head"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line, self.depth, self.mark, self.href = "", 0, "", ""

    def close_line(self) -> None:
        if text := " ".join(self.line.split()):
            self.out.append(self.mark + text)
        self.line = self.mark = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.skipped:
            self.depth += 1
        elif self.depth:
            pass
        elif tag in {"p", "div", "article", "ul", "ol", "br", "blockquote"}:
            self.close_line()
        elif tag[0] == "h" and tag[1:].isdigit():
            self.close_line()
            self.mark = "#" * int(tag[1:]) + " "
        elif tag == "li":
            self.close_line()
            self.mark = "- "
        elif tag in {"b", "strong"}:
            self.line += "**"
        elif tag == "a":
            self.href = dict(attrs).get("href") or ""
            self.line += "["

    def handle_endtag(self, tag):
        if tag in self.skipped:
            self.depth = max(0, self.depth - 1)
        elif self.depth:
            pass
        elif tag in {"b", "strong"}:
            self.line += "**"
        elif tag == "a":
            self.line += f"]({self.href})"
        elif tag in {"p", "div", "article", "li"} or tag[0] == "h" and tag[1:].isdigit():
            self.close_line()

    def handle_data(self, data):
        if not self.depth:
            self.line += data


def to_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close_line()
    return "\n\n".join(parser.out)


def markdown(html: Column) -> Column:
    """Blocks of a page as Markdown, by a Python function over Arrow batches."""

    @F.pandas_udf("string")
    def made(pages):
        return pages.map(to_markdown)

    return made(html)


def front_matter(pages: DataFrame) -> DataFrame:
    """(page_id, file, words, head): file name, size and the header lines of a page's record."""
    body = F.regexp_replace(without(F.col("html"), "script", "style", "nav", "footer", "head"), "<[^>]*>", " ")
    rows = pages.select("page_id", "url", title(F.col("html")).alias("title"), words(body).cast("int").alias("words"))
    name = F.concat(F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit("-"), slug(F.col("title"), 40), F.lit(".md"))
    return rows.select("page_id", name.alias("file"), "words", F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), "title"), F.concat(F.lit("url: "), "url"), F.lit("---")).alias("head"))
