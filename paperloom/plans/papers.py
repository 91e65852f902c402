"""Paper tables built from the documents table, identically for Spark and DuckDB.

The raw documents hold no headers, references or artifacts, so the queries of
the cleaning operators run on a decorated text.  The expressions are valid in
both SQL dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import read_texts

NL = "chr(10)"
_FRONT = f"concat('Preprint arXiv:2301.01234v2 [cs.AI] 5 Jan 2023', {NL}, 'Contact author.name@uni.example.org or https://example.org/paper?id=1', {NL}, 'Abstract', {NL}, 'We propose a method and show the results. The represen-', {NL}, 'tation uses ', chr(92), 'cite{{abc}} and train- ing data (Smith et al., 2020) [1, 2].', {NL}, substr(text, 1, 1800))"
_MIDDLE = f"concat({NL}, ' 12 ', {NL}, '1. Introduction', {NL}, text, {NL}, case when doc_id % 3 = 0 then concat('2. Methods', {NL}, text, {NL}) else '' end, '3. Results', {NL}, substr(text, 1, 4000), {NL}, 'Conclusion', {NL}, substr(text, 1, 900))"
_END = f"concat({NL}, 'References', {NL}, '[1] John Smith, Ann B. Lee (', cast(2000 + doc_id % 25 as string), ') \"A study of many things\". Journal of Data 12(3): 45-67. doi: 10.1000/x', cast(doc_id as string), {NL}, '[2] Mary Jones. Learning in 1998, vol. 4, pp. 10-20, arXiv: 2301.12345', {NL}, '[3] Workshop on Words, 2011. https://example.org/w', {NL}, case when doc_id % 4 = 0 then concat('Appendix', {NL}, 'More text follows here.') else '' end)"
FULL_TEXT = f"concat({_FRONT}, {_MIDDLE}, {_END})"
TITLE = "concat('Paper ', cast(doc_id as string))"
CATEGORY = "case doc_id % 5 when 0 then 'cs.AI,cs.LG' when 1 then 'cs.DB' when 2 then '' when 3 then 'physics.gen-ph' else 'cs.CL' end"
PUBLISHED = "cast('2020-01-01' as timestamp) + interval '1' day * cast(doc_id % 900 as int)"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arxiv_id, title, authors, categories, published, full_text, cleaned_text (the raw text), lang, source."""
    docs = read_texts(spark, sf_dir)
    return docs.select(
        F.col("doc_id").alias("arxiv_id"),
        F.expr(TITLE).alias("title"),
        F.array(F.concat(F.lit("Author "), F.col("source"))).alias("authors"),
        F.filter(F.split(F.expr(CATEGORY), ","), lambda c: c != "").alias("categories"),
        F.expr("date_add(date'2020-01-01', cast(doc_id % 900 as int))").alias("published"),
        F.expr(FULL_TEXT).alias("full_text"),
        F.col("text").alias("cleaned_text"),
        "lang",
        "source",
    )


PAPERS_SQL = f"""papers AS (
  SELECT doc_id AS arxiv_id, {TITLE} AS title, ['Author ' || source] AS authors,
         list_filter(string_split({CATEGORY}, ','), lambda c: c <> '') AS categories,
         DATE '2020-01-01' + (doc_id % 900)::INT AS published, {FULL_TEXT} AS full_text, text AS cleaned_text, lang, source
  FROM documents)"""
