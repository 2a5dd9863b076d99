"""HTML pages to transcripts and links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import text, times

# Tags that hold no text of their own, and the content containers to try.
NOISE_TAGS = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript")
CONTAINERS = (
    ("", "article", ()),
    ("div", "", ("col-xs-12", "col-sm-8", "col-md-8")),
    ("", "content", ()),
    ("article", "", ()),
    ("", "", ("entry-content",)),
    ("main", "", ()),
    ("div", "", ("field-docs-content",)),
)
STATEMENT_PATH = r"/newsevents/pressreleases/monetary(\d{8})a\.htm"
SPEECH_PATH = r"/newsevents/speech/([a-z]+)(\d{8})[a-z]?\.htm"

VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
# An opening tag of the left kind closes an open one of the right kinds first.
IMPLIED_END = {"li": {"li"}, "p": {"p"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
MIN_WORDS = 50


class _Page(HTMLParser):
    """Collects the text inside each wanted container, the first ``h1`` and the body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[int]]] = []
        self.noise = 0
        self.texts: dict[int, list[str]] = {}
        self.body: list[str] = []
        self.fields: dict[str, list[str]] = {}

    def _wanted(self, tag: str, attrs: dict[str, str | None]) -> list[int | str]:
        classes = set((attrs.get("class") or "").split())
        found: list[int | str] = []
        for i, (name, ident, need) in enumerate(CONTAINERS):
            if i not in self.texts and (not name or name == tag) and (not ident or attrs.get("id") == ident) and classes.issuperset(need):
                self.texts[i] = []
                found.append(i)
        for field, hit in (("h1", tag == "h1"), ("speaker", "speaker" in classes), ("time", "article__time" in classes)):
            if hit and field not in self.fields:
                self.fields[field] = []
                found.append(field)
        return found

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        closes = IMPLIED_END.get(tag)
        if closes and self.open and self.open[-1][0] in closes:
            self._close()
        found = self._wanted(tag, dict(attrs))
        if self.noise:
            # nothing inside a noise tag can be a container
            for f in found:
                if isinstance(f, int):
                    del self.texts[f]
            found = [f for f in found if not isinstance(f, int)]
        self.open.append((tag, found))
        if tag in NOISE_TAGS:
            self.noise += 1

    def _close(self) -> None:
        tag, _ = self.open.pop()
        if tag in NOISE_TAGS:
            self.noise -= 1

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        piece = data.strip()
        if not piece:
            return
        for _, found in self.open:
            for f in found:
                if not isinstance(f, int):
                    self.fields[f].append(piece)
                elif not self.noise:
                    self.texts[f].append(piece)
        if not self.noise and not any(t == "head" for t, _ in self.open):
            self.body.append(piece)


def read_page(html: str) -> tuple[str, str, str, str]:
    """(title, body, speaker, time text) of one page."""
    page = _Page()
    page.feed(html or "")
    page.close()
    best, size = page.body, 0
    for i in sorted(page.texts):
        n = sum(map(len, page.texts[i]))
        if n > size:
            best, size = page.texts[i], n
    return ("".join(page.fields.get("h1", [])), " ".join(best), "".join(page.fields.get("speaker", [])),
            "".join(page.fields.get("time", [])))


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with title, main text, speaker and time text in place of their HTML.

    The longest of the known containers is the text, else the body; noise tags hold none.
    """
    keep = [f for f in pages.schema.fields if f.name != html]
    names = [f.name for f in keep]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            parts = [read_page(h) for h in batch[html]]
            for i, name in enumerate(("title", "body", "speaker", "time_text")):
                out[name] = [p[i] for p in parts]
            yield out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep]
                       + [f"{n} string" for n in ("title", "body", "speaker", "time_text")])
    rows = pages.mapInPandas(parse, schema)
    return rows.withColumn("body", text.squeeze(F.col("body")))


def transcript_rows(pages: DataFrame, source: str, default_speaker: str, date_digits: Column,
                    min_words: int = MIN_WORDS) -> DataFrame:
    """Parsed pages (``url`` and the columns of ``main_text``) to corpus rows.

    The date is the long date on the page, else the digits given, usually cut from the URL.
    """
    date = F.coalesce(times.long_date_to_seconds(F.col("time_text")), times.digits_to_seconds(date_digits))
    rows = pages.withColumns({"n_words": text.word_count(F.col("body")), "date_ts": date}).filter(
        (F.col("n_words") >= min_words) & F.col("date_ts").isNotNull())
    speaker = F.when(F.col("speaker") != "", F.col("speaker")).otherwise(default_speaker)
    return rows.select(
        text.short_hash(F.lit(source), F.col("url"), F.col("title")).alias("doc_id"), speaker.alias("speaker"),
        F.lit("speech").alias("format"), F.col("title").alias("occasion"), "date_ts", F.lit(source).alias("source"),
        "url", "n_words", F.col("body").alias("text"))


def statement_rows(pages: DataFrame, source: str, speaker: str, min_words: int = MIN_WORDS) -> DataFrame:
    """Statement pages to corpus rows: fixed speaker, occasion named by the month."""
    digits = F.regexp_extract("url", STATEMENT_PATH, 1)
    date = times.digits_to_seconds(digits)
    occasion = F.concat(F.lit("FOMC statement — "), F.date_format(F.timestamp_seconds(date), "MMMM yyyy"))
    rows = pages.withColumns({"n_words": text.word_count(F.col("body")), "date_ts": date, "occasion": occasion}).filter(
        (F.col("n_words") >= min_words) & F.col("date_ts").isNotNull())
    return rows.select(
        text.short_hash(F.lit(source), F.col("url"), F.col("occasion")).alias("doc_id"), F.lit(speaker).alias("speaker"),
        F.lit("speech").alias("format"), "occasion", "date_ts", F.lit(source).alias("source"), "url", "n_words", F.col("body").alias("text"))


def statement_links(pages: DataFrame) -> DataFrame:
    """Distinct statement paths, latest first."""
    return pages.select(F.explode(F.regexp_extract_all("html", F.lit(STATEMENT_PATH), F.lit(0))).alias("path")).distinct().orderBy(F.desc("path"))


def speech_links(pages: DataFrame) -> DataFrame:
    """Distinct speech paths with their speaker slug and date digits."""
    paths = pages.select(F.explode(F.regexp_extract_all("html", F.lit(SPEECH_PATH), F.lit(0))).alias("path")).distinct()
    return paths.select("path", F.regexp_extract("path", SPEECH_PATH, 1).alias("slug"), F.regexp_extract("path", SPEECH_PATH, 2).alias("digits"))


def links(pages: DataFrame, pattern: str, group: int = 1, page_id: str = "page_id") -> DataFrame:
    """Distinct matches of a link pattern per page."""
    return pages.select(page_id, F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(group))).alias("link")).distinct()


class TranscriptSource(Protocol):
    """A feed of corpus rows; anything that yields a DataFrame under the corpus contract (F2)."""

    def load(self, spark: SparkSession) -> DataFrame: ...


def corpus_of(spark: SparkSession, sources: list[TranscriptSource]) -> DataFrame:
    """All sources' rows under the corpus contract."""
    from tapeline.operators.dedup import union_all
    from tapeline.schemas import CORPUS

    return CORPUS.conform(union_all(*[s.load(spark) for s in sources]))
