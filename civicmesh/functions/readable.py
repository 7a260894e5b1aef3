"""Readable text of web pages: the main part of an HTML page as markdown.

A page is read once, into blocks of text that know the container they lie in; containers are numbered as they open, so all
that one holds is a range of numbers. Containers score by the text of their blocks that lies outside links; the best one
is the main part. Per page, memory is that of its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements left out with all they hold, elements without content, containers, blocks, and words in classes and
#: ids of parts that are no content.
LEFT_OUT = frozenset("script style noscript template svg canvas iframe object nav footer aside form button select head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div blockquote ul ol table td th dd figure".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li pre tr dt dl header thead tbody caption figcaption address".split())
NO_CONTENT = frozenset("ad ads advert advertisement banner sidebar menu nav footer share social promo cookie related newsletter".split())
MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`"}
#: Characters of a block that count as text, what a comma adds, share of links from which a block is no text, and what of a
#: block's score its container and those around it get.
LEAST, COMMA, LINKED, PASSED_ON = 25, 10, 0.5, (1.0, 0.5, 0.25)
#: Bytes of markdown in an output batch.
BATCH_BYTES = 4 << 20


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.parent, self.last, self.open = [0], [0], [0]  # containers: the one around, the last number inside, those open
        self.left_out, self.depth = "", 0
        self.blocks: list[tuple[str, int, str, int, int]] = []  # form, container, markdown, characters, those in links
        self.parts: list[str] = []
        self.size = self.linked = 0
        self.lists: list[int] = []
        self.links: list[tuple[int, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.left_out:
            self.depth += tag == self.left_out
            return
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append("\n" if "pre" in self.stack else " ")
            return
        named = dict(attrs)
        words = re.split(r"[^a-z]+", f"{named.get('class') or ''} {named.get('id') or ''}".lower())
        if tag in LEFT_OUT or (tag in CONTAINERS and tag not in ("html", "body") and NO_CONTENT.intersection(words)):
            self.flush()
            self.left_out, self.depth = tag, 1
            return
        if tag in BLOCKS:
            self.flush()
            for ended in ("p", *(("li",) if tag == "li" else ()), *(("td", "th", "tr") if tag == "tr" else ("td", "th") if tag in ("td", "th") else ())):
                self.end_implied(ended, tag)
        self.stack.append(tag)
        if tag in CONTAINERS:
            self.parent.append(self.open[-1])
            self.last.append(len(self.last))
            self.open.append(len(self.parent) - 1)
        if tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else -1)
        elif tag == "li" and self.lists and self.lists[-1] >= 0:
            self.lists[-1] += 1
        elif tag in MARKS and "pre" not in self.stack:
            self.parts.append(MARKS[tag])
        elif tag == "a":
            self.links.append((len(self.parts), named.get("href") or ""))

    def end_implied(self, ended: str, by: str) -> None:
        """What the beginning of an element ends: the open one of that kind in the same container."""
        for place in range(len(self.stack) - 1, -1, -1):
            if self.stack[place] == ended:
                self.leave(place)
                return
            if self.stack[place] in CONTAINERS and not (self.stack[place] in ("td", "th") and by in ("tr", "td", "th")):
                return

    def leave(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.stack.pop()
            if tag in MARKS and "pre" not in self.stack:
                self.parts.append(MARKS[tag])
            elif tag == "a" and self.links:
                start, href = self.links.pop()
                text = "".join(self.parts[start:]).strip()
                if text:
                    self.linked += len(text)
                    self.parts[start:] = [f"[{text}]({href})" if href else text]
            elif tag in BLOCKS:
                self.stack.append(tag)
                self.flush()
                self.stack.pop()
            if tag in CONTAINERS:
                self.last[self.open.pop()] = len(self.parent) - 1
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()

    def handle_endtag(self, tag: str) -> None:
        if self.left_out:
            self.depth -= tag == self.left_out
            if not self.depth:
                self.left_out = ""
        elif tag in self.stack:
            self.leave(len(self.stack) - 1 - self.stack[::-1].index(tag))

    def handle_data(self, data: str) -> None:
        if not self.left_out:
            self.parts.append(data)
            self.size += len(data.strip())

    def flush(self) -> None:
        """Ends the block of text so far."""
        text = "".join(self.parts)
        preformatted = "pre" in self.stack
        text = text.strip("\n") if preformatted else " ".join(text.split()).replace("****", "").replace("** **", " ")
        if text.strip(" *_`"):
            inner = next((t for t in reversed(self.stack) if t in BLOCKS), "p")
            if preformatted:
                text = f"```\n{text}\n```"
            elif inner[0] == "h" and inner[1:].isdigit():
                text = "#" * int(inner[1:]) + " " + text.replace("**", "")
            elif self.lists and inner in ("li", "p"):
                mark = "-" if self.lists[-1] < 0 else f"{self.lists[-1]}."
                inner, text = "li", "  " * (len(self.lists) - 1) + f"{mark} {text}"
            elif "blockquote" in self.stack:
                text = "> " + text
            self.blocks.append((inner, self.open[-1], text, self.size, min(self.linked, self.size)))
        self.parts, self.links, self.size, self.linked = [], [], 0, 0

    def markdown(self) -> str:
        self.leave(0)
        self.flush()
        scores = [0.0] * len(self.parent)
        for _, container, text, size, linked in self.blocks:
            if size >= LEAST and linked <= LINKED * size:
                gain, at = size - linked + COMMA * text.count(","), container
                for part in PASSED_ON:
                    scores[at] += part * gain
                    if not at:
                        break
                    at = self.parent[at]
        best = max(range(len(scores)), key=scores.__getitem__) if any(scores) else 0
        end = self.last[best] if best else len(self.parent)
        out, before = [], ""
        for form, container, text, _, _ in self.blocks:
            if best <= container <= end:
                out.append(("\n" if form == before and form in ("li", "td", "th") else "\n\n") if out else "")
                out.append(text)
                before = form
        return "".join(out)


def readable(html: str | None) -> str:
    """The main part of a page as markdown; null and pages without text: empty."""
    page = _Page()
    page.feed(html or "")
    page.close()  # what is left in the parser's buffer
    return page.markdown()


def with_markdown(pages: DataFrame, html: str = "html", name: str = "markdown") -> DataFrame:
    """``pages`` without ``html``, with the readable text of each; rows pass in Arrow batches, out in batches of BATCH_BYTES."""
    keep = [c for c in pages.columns if c not in (html, name)]
    source = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html}`").cast("string").alias("__html"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, out = 0, 0, []
            for i in range(batch.num_rows):
                out.append(readable(batch.column(batch.num_columns - 1)[i].as_py()))
                size += len(out[-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(start, len(out))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.string())], names=[*keep, name])
                    start, size, out = i + 1, 0, []

    return source.mapInArrow(run, schema)
