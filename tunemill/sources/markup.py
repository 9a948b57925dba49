"""HTML to text, forum posts, links and attachments, with the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_SILENT = {"script", "style", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """A light tree: nodes are [tag, attributes, children], text is str."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _strings(node: list, skip: frozenset[str] = frozenset()) -> Iterator[str]:
    stack = [iter(node[2])]
    while stack:
        for child in stack[-1]:
            if isinstance(child, str):
                if child.strip():
                    yield child.strip()
            elif child[0] not in _SILENT and not (skip & set(child[1].get("class", "").split())):
                stack.append(iter(child[2]))
                break
        else:
            stack.pop()


def _nodes(node: list) -> Iterator[list]:
    stack = [iter(node[2])]
    while stack:
        for child in stack[-1]:
            if not isinstance(child, str):
                yield child
                stack.append(iter(child[2]))
                break
        else:
            stack.pop()


def _classes(node: list) -> set[str]:
    return set(node[1].get("class", "").split())


def clean(html: str) -> tuple[str, str]:
    """Title and text of a page: no scripts and styles, a line for each piece, blank runs as one."""
    root = _Tree(html).root
    title = next((" ".join(_strings(n)) for n in _nodes(root) if n[0] == "title"), "")
    body = next((n for n in _nodes(root) if n[0] == "body"), root)
    text = "\n".join(s for s in _strings(body)) if body is not root else "\n".join(s for n in [root] for s in _strings(n) if s != title)
    return title, re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text))


#: Classes of a post, its author, its body and what to leave out of it, by forum software.
LAYOUTS = {
    "phpbb": ({"post", "postbody"}, {"username", "username-coloured", "postauthor"}, {"content"}, frozenset()),
    "xenforo": ({"message"}, {"message-name", "username"}, {"message-body", "bbWrapper"}, frozenset({"bbCodeBlock--quote", "quote"})),
    "vbulletin": ({"postcontainer", "postbit"}, {"bigusername", "username"}, {"post_message", "postcontent"}, frozenset({"quote"})),
    "invision": ({"ipsComment", "post_block"}, {"ipsType_break", "author"}, {"ipsType_richText", "post"}, frozenset({"ipsQuote"})),
}


def posts(html: str, layout: str) -> list[tuple[int, str, str | None, str]]:
    """(number, author, date, text) of the posts of a thread page."""
    outer, author, body, skip = LAYOUTS[layout]
    out: list[tuple[int, str, str | None, str]] = []
    done: set[int] = set()
    for n in _nodes(_Tree(html).root):
        if not (_classes(n) & outer) or id(n) in done:
            continue
        inside = list(_nodes(n))
        done |= {id(x) for x in inside if _classes(x) & outer}
        content = next((x for x in inside if _classes(x) & body), n)
        text = "\n".join(_strings(content, skip))
        if text:
            who = next((" ".join(_strings(x)) for x in inside if _classes(x) & author), "") or "?"
            when = next((x[1].get("datetime") for x in inside if x[0] == "time"), None)
            out.append((len(out) + 1, who, when, text))
    return out


def links(html: str) -> list[tuple[str, str]]:
    """(href, text) of every link, session ids taken off, the first of each href."""
    seen: dict[str, str] = {}
    for n in _nodes(_Tree(html).root):
        if n[0] == "a" and n[1].get("href"):
            seen.setdefault(re.sub(r"[?&](?:sid|s)=[0-9a-f]{32}", "", n[1]["href"]), " ".join(_strings(n)))
    return list(seen.items())


def page_text():
    @pandas_udf("struct<title:string,text:string>")
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clean(h) if h is not None else (None, None) for h in html], columns=["title", "text"])

    return run


def posts_of(layout: str):
    @pandas_udf("array<struct<no:int,author:string,date:string,text:string>>")
    def run(html: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else [dict(zip(("no", "author", "date", "text"), p)) for p in posts(h, layout)] for h in html])

    return run


def page_links():
    @pandas_udf("array<struct<href:string,text:string>>")
    def run(html: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else [{"href": a, "text": b} for a, b in links(h)] for h in html])

    return run


def html_documents(pages: DataFrame, min_chars: int = 600) -> DataFrame:
    """(url, title, text) of pages(url, html) with enough text."""
    rows = pages.select("url", page_text()("html").alias("p")).select("url", "p.title", "p.text")
    return rows.where(F.length("text") >= min_chars)


def threads(pages: DataFrame, layout: str) -> DataFrame:
    """(thread_id, text, posts): pages(thread_id, page, html) of a thread as one document, posts numbered through."""
    each = pages.select("thread_id", "page", F.explode(posts_of(layout)(F.col("html"))).alias("p"))
    line = F.concat(F.lit("--- post "), F.lit("{}"), F.lit(" ---"))
    packed = each.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("page", F.col("p.no").alias("no"), F.col("p.author").alias("author"), F.col("p.text").alias("text")))).alias("x"))
    text = F.array_join(F.transform("x", lambda x, i: F.concat(F.replace(line, F.lit("{}"), (i + 1).cast("string")), F.lit("\n"), x["author"], F.lit("\n"), x["text"])), "\n\n")
    return packed.select("thread_id", text.alias("text"), F.size("x").alias("posts"))


def discovered(page_rows: DataFrame, known: DataFrame, keywords: list[str], reject: list[str], most: int) -> DataFrame:
    """(thread_id, href, title) of new threads on listing pages(html): titles that pass, ids not known, at most `most`."""
    from tunemill.operators.corpus import title_ok

    found = page_rows.select(F.explode(page_links()("html")).alias("a")).select("a.href", F.col("a.text").alias("title"))
    ids = found.withColumn("thread_id", thread_id(F.col("href"))).where(F.col("thread_id").isNotNull() & title_ok(F.col("title"), keywords, reject))
    first = ids.groupBy("thread_id").agg(F.min(F.struct("href", "title")).alias("x")).select("thread_id", "x.href", "x.title")
    return first.join(known.select("thread_id").distinct(), "thread_id", "left_anti").orderBy("thread_id").limit(most)


def thread_id(href: Column) -> Column:
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(href, r"[?&]t=(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(href, r"\.(\d+)/?", 1), F.lit("")), F.nullif(F.regexp_extract(href, r"/topic/(\d+)", 1), F.lit(""))), F.lit(""))


def last_page(hrefs: Column) -> Column:
    """The highest page number among links, 1 if none has one."""
    numbers = F.transform(hrefs, lambda h: F.coalesce(F.expr("cast(null as int)"), F.nullif(F.regexp_extract(h, r"(?:page[-=]|&page=)(\d+)", 1), F.lit("")).cast("int")))
    return F.coalesce(F.array_max(numbers), F.lit(1))


#: Image files, archives, and what in an archive's name speaks for an image.
_IMAGE = r"(?i)\.(srf|hex|bin|rom|mot|s19)$"
_ARCHIVE = r"(?i)\.(zip|7z|rar|gz)$"
_HINT = r"(?i)\brom\b|fxt|wrx|\bsti\b|legacy|forester|impreza|outback|baja|stock|\becu\b|tune|base\s*map|basemap|4eat|5mt|6mt|[0-9A-Fa-f]{10,16}"


def is_image_name(name: Column) -> Column:
    return name.rlike(_IMAGE) | (name.rlike(_ARCHIVE) & name.rlike(_HINT))
