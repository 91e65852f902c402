"""Paper sources: feed entries, feed files, existing PDFs, stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import arxiv_id_from_filename

TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"
#: Characters of a PDF's text that a crawled paper keeps.
FULL_TEXT_CHARS = 5000


def parse_entries(entries: DataFrame) -> DataFrame:
    """Papers from feed entries (id, title, summary, published, updated, tags, authors)."""
    line = lambda c: F.trim(F.replace(F.col(c), F.lit("\n"), F.lit(" ")))
    return entries.select(
        F.element_at(F.split("id", "/abs/"), -1).alias("arxiv_id"),
        line("title").alias("title"),
        line("summary").alias("summary"),
        F.transform("authors", lambda a: a["name"]).alias("authors"),
        F.transform("tags", lambda t: t["term"]).alias("categories"),
        F.to_timestamp_ntz("published", F.lit(TIME)).alias("published"),
        F.to_timestamp_ntz("updated", F.lit(TIME)).alias("updated"),
        F.concat(F.replace("id", F.lit("/abs/"), F.lit("/pdf/")), F.lit(".pdf")).alias("pdf_url"),
        F.lit(False).alias("pdf_downloaded"),
        F.lit(False).alias("pdf_processed"),
    )


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Papers from staged Atom files; entries that don't parse are dropped one by one."""
    raw = spark.read.format("xml").option("rowTag", "entry").option("mode", "DROPMALFORMED").schema("id string, title string, summary string, published string, updated string, category array<struct<_term: string>>, author array<struct<name: string>>").load(path)
    return parse_entries(raw.select("id", "title", "summary", "published", "updated", F.transform("category", lambda c: F.struct(c["_term"].alias("term"))).alias("tags"), F.col("author").alias("authors")))


def list_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path, name, arxiv_id of the PDF files in a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), arxiv_id_from_filename(name).alias("arxiv_id"), "modificationTime", "length")


def papers_from_pdfs(files: DataFrame) -> DataFrame:
    """A default paper for each PDF whose name tells its id."""
    return files.where("arxiv_id is not null").select(
        "arxiv_id",
        F.concat(F.lit("Existing Paper "), "arxiv_id").alias("title"),
        F.lit("").alias("summary"),
        F.array().cast("array<string>").alias("authors"),
        F.array(F.lit("cs.AI")).alias("categories"),
        F.col("path").alias("pdf_path"),
        F.lit(True).alias("pdf_downloaded"),
        F.lit(False).alias("pdf_processed"),
    )


def extract_pdf_text(files: DataFrame, pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """path, full_text: page texts joined by line breaks, stripped; empty or unreadable is null.

    ``files`` has path and content.  ``pages`` turns a file's bytes into page
    texts; the default needs a PDF library on the executors.
    """

    def default(content: bytes) -> list[str]:
        import io

        from pypdf import PdfReader  # optional

        return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]

    reader = pages or default

    def text(content: bytes | None) -> str | None:
        try:
            return "\n".join(reader(bytes(content))).strip() or None if content else None
        except ImportError:
            raise
        except Exception:  # one broken file doesn't end the scan
            return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "full_text": part["content"].map(text)})

    return files.select("path", "content").mapInPandas(run, "path string, full_text string")


def truncated(papers: DataFrame, chars: int = FULL_TEXT_CHARS) -> DataFrame:
    return papers.withColumn("full_text", F.substring("full_text", 1, chars))


def embedding_text(papers: DataFrame, chars: int = 3000) -> DataFrame:
    """Title, summary and the first characters of the text, as the text to embed."""
    part = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.substring(F.coalesce("full_text", F.lit("")), 1, chars))
    return papers.withColumn("embedding_text", part)


def model_text(papers: DataFrame, chars: int = 1000, text: str = "text") -> DataFrame:
    """Title, a full stop and the first characters: 1000 to classify, 500 to cluster."""
    return papers.withColumn("model_text", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.substring(F.coalesce(F.col(text), F.lit("")), 1, chars)))


def coerce_categories(papers: DataFrame) -> DataFrame:
    """A single category given as a string becomes a list of one."""
    return papers if papers.schema["categories"].dataType.typeName() == "array" else papers.withColumn("categories", F.array("categories"))
