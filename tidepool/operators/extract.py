"""HTML extraction over a table, in one Arrow pass."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import html as page
from tidepool.runtime import ensure_workers

RESULT = "title string, description string, markdown string, links array<string>, extract_error string"


def extract_pages(pages: DataFrame, *, key: str = "url", base: str = "url", html: str = "html", limits: page.Limits = page.Limits()) -> DataFrame:
    """(key, title, description, markdown, links, extract_error); no other column goes to Python, and html doesn't come back."""
    ensure_workers(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, b, h in zip(batch["k"], batch["b"], batch["h"]):
                try:
                    p = page.extract(h or "", b or "", limits)
                    out.append((k, p.title, p.description, p.markdown, p.links, None))
                except page.ExtractError as e:
                    out.append((k, None, None, None, None, e.kind))
                except Exception as e:  # noqa: BLE001 - one page must not end the job
                    out.append((k, None, None, None, None, f"internal: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["k", "title", "description", "markdown", "links", "extract_error"])

    chosen = pages.select(F.col(key).alias("k"), F.col(base).alias("b"), F.col(html).alias("h"))
    return chosen.mapInPandas(run, f"k {kind}, {RESULT}").withColumnRenamed("k", key)
