"""op3: main text of all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkprobe.llm.html_text import extract_text
from inkprobe.llm.registry import query, table


@query("op3_html_text")
def op3_html_text(spark, sf_dir):
    """Extracted by the paths that win in each host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = extract_text(pages, keep=["page_id", "url"])
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
