"""Where models plug in: embedders, extractors, judges. The engine has none of its own."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

EXTRACTED = "page_id long, node_type string, title string, source_url string, confidence double"


class TextEmbedder(Protocol):
    """Unit vectors of texts, a batch at a time."""

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class SignalExtractor(Protocol):
    """Typed signals of a page's text."""

    def extract(self, url: str, text: str) -> Iterable[dict]: ...


class Judge(Protocol):
    """Whether a candidate response answers a tension, and how well."""

    def verify(self, tension: str, response: str) -> tuple[bool, float]: ...


def extracted(pages: DataFrame, extractor: SignalExtractor) -> DataFrame:
    """Signals of pages (page_id, url, html); null html gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"page_id": i, **x} for i, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True) if html for x in extractor.extract(url, html)]
            yield pd.DataFrame(rows, columns=["page_id", "node_type", "title", "source_url", "confidence"])

    return pages.mapInPandas(run, EXTRACTED)
