"""Schemas of the paper tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

PAPER = StructType.fromDDL(
    "arxiv_id string not null, title string, summary string, authors array<string>, categories array<string>, published timestamp_ntz, "
    "updated timestamp_ntz, pdf_url string, scraped_at timestamp_ntz, pdf_downloaded boolean, pdf_processed boolean, pdf_path string, full_text string"
)
FEED_ENTRY = StructType.fromDDL("id string, title string, summary string, published string, updated string, tags array<struct<term: string>>, authors array<struct<name: string>>")
SECTION = StructType.fromDDL("doc_id bigint, name string, content string, start_pos int, end_pos int, level int, confidence double")
CHUNK = StructType.fromDDL("arxiv_id string, chunk_id int, section string, text string, char_count int, word_count int, section_confidence double, paper_title string, categories array<string>, quality_score double")
DATASET_PAPER = StructType.fromDDL("arxiv_id string, title string, text string, categories array<string>, quality_score double")
EMBEDDING = StructType.fromDDL("key string, embedding array<float>, metadata map<string, string>")
