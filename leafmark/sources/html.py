"""HTML to text lines: script, style and nav go with all they hold; text nodes are lines."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmark.functions import text as T

DROPPED = frozenset(("script", "style", "nav"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.inside = [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.out.append("\n")
        if tag in DROPPED:
            self.inside.append(tag)

    def handle_endtag(self, tag: str) -> None:
        self.out.append("\n")
        if tag in self.inside:
            del self.inside[self.inside.index(tag) :]

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.out.append(data)

    def handle_comment(self, data: str) -> None:
        self.out.append("\n")


def text_lines(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    return "\n".join(x for x in (line.strip() for line in "".join(p.out).split("\n")) if x)


def _parsed(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for page in pages:
        yield page.map(text_lines)


def parsed_html(c: Column | str) -> Column:
    """The general path: a parser, in Arrow batches."""
    return F.pandas_udf(_parsed, "string")(c)


def native_html(c: Column | str) -> Column:
    """The fast path, for pages whose script, style and nav elements are closed and not nested: no Python, whole-stage code.
    References other than these six stay as they are."""
    s = F.regexp_replace(T.text_of(c), r"(?is)<(script|style|nav)\b.*?</\1\s*>", "\n")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->|<[^>]*>", "\n")
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        s = F.regexp_replace(s, f"&{name};?", char)
    lines = F.filter(F.transform(F.split(s, "\n"), T.strip), lambda x: x != "")
    return F.array_join(lines, "\n")
