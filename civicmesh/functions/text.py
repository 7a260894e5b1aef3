"""Text: links, mentions, personal data, citations, titles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"https?://[^\s<>\"')\]]+"
#: Personal data, in the order of the findings (fixed values).
PII = {
    "phone number detected": r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "email address detected": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "SSN pattern detected": r"\b\d{3}-\d{2}-\d{4}\b",
    "street address detected": r"\b\d{1,5}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:St|Ave|Blvd|Dr|Ln|Rd|Way|Ct|Pl|Cir|Ter)\b",
}
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def links(html: Column) -> Column:
    """Absolute links anywhere in a page, in the order first seen."""
    return F.array_distinct(all_matches(html, LINK))


def hrefs(html: Column) -> Column:
    return F.array_distinct(all_matches(html, r"href=\"([^\"]*)\"", 1))


def resolved(href: Column, base: Column) -> Column:
    """An href against the page's url, for absolute, rooted and simple relative ones."""
    root = F.regexp_extract(base, r"^([a-z]+://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(://[^/]*/(?:.*/)?)[^/]*$", "$1")
    return F.when(href.rlike("^[a-z]+:"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))


def mentions(text: Column) -> Column:
    return F.array_distinct(F.transform(all_matches(text, r"(?U)@([\w.]+)", 1), F.lower))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.transform(all_matches(text, r"(?U)#(\w+)", 1), F.lower))


def topic_tag(topic: Column) -> Column:
    """A topic as a hashtag: its words joined, each with a capital."""
    return F.regexp_replace(F.initcap(F.regexp_replace(topic, "[^A-Za-z0-9]+", " ")), " ", "")


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def og_tag(html: Column, name: str) -> Column:
    """An Open Graph property in either order of attributes; null if there is none. Previews are only looked for in a page's first 50,000 characters."""
    head = F.substring(html, 1, 50_000)
    a = F.regexp_extract(head, rf"(?is)<meta[^>]*property=\"og:{name}\"[^>]*content=\"([^\"]*)\"", 1)
    b = F.regexp_extract(head, rf"(?is)<meta[^>]*content=\"([^\"]*)\"[^>]*property=\"og:{name}\"", 1)
    return F.when(a != "", a).when(b != "", b)


def preview_title(html: Column) -> Column:
    return F.coalesce(og_tag(html, "title"), F.nullif(title(html), F.lit("")))


def pii(text: Column) -> Column:
    """Kinds of personal data in a text."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in PII.items())))


def plain(html: Column) -> Column:
    """A page's text: no scripts, styles or tags, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))


def slug(text: Column) -> Column:
    return F.array_join(F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]", " "), " "), lambda s: s != ""), "-")


def shortened(text: Column, n: int, mark: str = "…") -> Column:
    """The first n characters and a mark, if the text has more than n bytes."""
    return F.when(F.octet_length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def citations(text: Column) -> Column:
    return all_matches(text, rf"\[signal:({UUID})\]", 1)


def uncited_claim(text: Column, names_within: int | None = None) -> Column:
    """Whether a sentence of four words or more states a number or a name and cites nothing.

    Names are looked for in the whole sentence, or, as some contracts fix, among its first ``names_within`` words."""

    def claims(s: Column) -> Column:
        words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
        named = F.exists(F.slice(words, 2, F.size(words) if names_within is None else F.lit(names_within - 1)), lambda w: w.rlike("^[A-Z]"))
        return (F.size(words) >= 4) & ~s.contains("[signal:") & (s.rlike("[0-9]") | named)

    return F.exists(F.split(text, "[.!?]"), claims)


def unfenced(text: Column) -> Column:
    """A reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-z]*\s*", ""), r"\s*```$", ""))


def parsed_time(text: Column) -> Column:
    """A time with an offset or Z, else the same without one as UTC, else null."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))
    return F.coalesce(zoned, F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?$"), F.try_to_timestamp(F.concat(text, F.lit("Z")))))


def one_of(text: Column, names: tuple[str, ...], otherwise: str) -> Column:
    """A name in any case if it is one of ``names``, else the default."""
    return F.when(F.lower(text).isin(*names), F.lower(text)).otherwise(F.lit(otherwise))


def normalized_title(text: Column) -> Column:
    return F.lower(F.trim(text))


def words(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two word sets; zero if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def gap_type(context: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(context, r"\| Gap: ([^|]*)\|", 1)), F.lit(""))


def gap_heat(context: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(context, r"(?:heat=|cause_heat: |heat: )([0-9]+\.?[0-9]*)", 1), F.lit("")), F.lit("9.99")).cast("double")


def count_label(n: Column, what: str) -> Column:
    """12, 1.5k or 2.0M of something."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM " + what, F.floor(n / 1e5 + 0.5) / 10)).when(n >= 1000, F.format_string("%.1fk " + what, F.floor(n / 1e2 + 0.5) / 10)).otherwise(F.concat(n.cast("long").cast("string"), F.lit(" " + what)))


def _fnv(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """FNV-1a of many texts in step: the longest first, so that those still going on are the first ones."""
    for batch in texts:
        raw = [None if t is None else t.encode() for t in batch]
        order = sorted((i for i, r in enumerate(raw) if r is not None), key=lambda i: -len(raw[i]))
        out: list[str | None] = [None] * len(raw)
        for k in range(0, len(order), 256):
            part = order[k : k + 256]
            sizes = np.array([len(raw[i]) for i in part])
            at = np.zeros((len(part), sizes[0]), np.uint8)
            for row, i in enumerate(part):
                at[row, : sizes[row]] = np.frombuffer(raw[i], np.uint8)
            state, alive = np.full(len(part), 0xCBF29CE484222325, np.uint64), len(part)
            for p, column in enumerate(np.ascontiguousarray(at.T)):
                while sizes[alive - 1] <= p:
                    alive -= 1
                state[:alive] = (state[:alive] ^ column[:alive]) * np.uint64(0x100000001B3)
            for i, h in zip(part, state.tolist(), strict=True):
                out[i] = f"{h:x}"
        yield pd.Series(out, dtype=object)


def content_hash(text: Column) -> Column:
    """FNV-1a over UTF-8 bytes, 64 bits, as unpadded lower-case hexadecimal; null gives null. An Arrow function, as no built-in one computes it."""
    return F.pandas_udf(_fnv, "string")(text)
