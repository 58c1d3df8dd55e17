"""Templates of wiki text: nested braces, one text to many listings, and their words as plain text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

_MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")


def parse(text: str) -> Iterator[tuple[int, str, dict[str, str]]]:
    """(place, name, parameters) of every template of a text, inner ones too, by where they begin.

    One pass with a stack of what is open. A bar belongs to the innermost template or link. Closing braces end the
    innermost template, with what links are open in it; closing brackets end a link only if it is the innermost.
    Closers that end nothing are text. A template that is never closed ends with the text. Names are lower case and
    trimmed; a part without "=" is no parameter; of equal keys the last counts."""
    open_: list[list] = []  # [is template, where its inside begins, bars]
    found = []

    def close(frame: list, end: int) -> None:
        cuts = [*frame[2], end]
        parts = [text[a:b] for a, b in zip([frame[1], *(c + 1 for c in frame[2])], cuts, strict=True)]
        pairs = (p.split("=", 1) for p in parts[1:] if "=" in p)
        found.append((frame[1] - 2, " ".join(parts[0].split()).lower(), {k.strip().lower(): v.strip() for k, v in pairs}))

    for m in _MARK.finditer(text):
        mark = m.group()
        if mark in ("{{", "[["):
            open_.append([mark == "{{", m.end(), []])
        elif mark == "|":
            if open_:
                open_[-1][2].append(m.start())
        elif mark == "]]":
            if open_ and not open_[-1][0]:
                open_.pop()
        elif any(f[0] for f in open_):
            while not open_[-1][0]:
                open_.pop()
            close(open_.pop(), m.start())
    for frame in open_:
        if frame[0]:
            close(frame, len(text))
    yield from sorted(found, key=lambda f: f[0])


def listings(docs: DataFrame, kinds: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, nth (from 0), kind, params (map): the templates of these kinds in each text, whole texts at a time.

    A name counts up to its first word that is a kind, as "see" or "infobox station". Null texts have none. Rows that
    repeat an id number their own."""
    ship(docs.sparkSession)
    wanted = sorted({" ".join(k.lower().split()) for k in kinds}, key=len, reverse=True)

    def kind_of(name: str) -> str | None:
        return next((k for k in wanted if name == k or name.startswith(k + " ")), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                if text is not None and "{{" in text:
                    hits = [(k, p) for _, name, p in parse(text) if (k := kind_of(name)) is not None]
                    rows += [(i, nth, k, p) for nth, (k, p) in enumerate(hits)]
            ids, nth, kind, params = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pd.DataFrame({"id": pd.Series(ids, dtype=pdf["id"].dtype), "nth": pd.Series(nth, dtype="int32"), "kind": pd.Series(kind, dtype="object"), "params": pd.Series(list(params), dtype="object")})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, nth int, kind string, params map<string,string>")
    return out.withColumnRenamed("id", id_col)


def unescape():
    """A column function: character references written out."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else html.unescape(x))

    return run


def clean(text: Column) -> Column:
    """The words of wiki text: without references, templates, tags and quotes; links by what they show."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"<ref[^>]*/>|(?s)<ref.*?</ref>", "")
    for _ in range(3):
        s = F.regexp_replace(s, r"\{\{[^{}]*\}\}", "")
    for pattern, to in ((r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"), (r"\[https?://\S+\s([^\]]+)\]", "$1"), (r"\[https?://\S+\]", ""), (r"'{2,}", ""), (r"<[^>]+>", "")):
        s = F.regexp_replace(s, pattern, to)
    s = F.regexp_replace(F.trim(unescape()(s)), r"^#\d+[.:)]?\s*", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def shorten(text: Column, limit: int = 170) -> Column:
    """At most ``limit`` letters: up to the last sentence that ends behind the 70th, else up to the last blank, and
    three dots."""
    cut = F.substring(text, 1, limit)
    whole = F.regexp_extract(cut, r"(?s)^(.*\.) ", 1)
    words = F.regexp_replace(cut, r"(?s)^(.*) .*$", "$1")
    return F.when(F.length(text) <= limit, text).when(F.length(whole) > 71, whole).otherwise(F.concat(words, F.lit("…")))
