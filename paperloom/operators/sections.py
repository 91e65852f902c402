"""Sections of papers: header lines, contents, summaries and chunks.

Headers and sections are found within a paper's row; where lines are exploded,
every window is partitioned by the paper's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import settings as S
from paperloom.functions.text import strip, word_count
from paperloom.scratch import cut


def header_pattern(rule: S.SectionRule) -> str:
    """What a stripped line must match, ignoring case.  An abstract may go on behind a colon."""
    numbered = rule.numbered or rule.titles
    more = r"|abstract\s*[:\-].*" if rule.name == "abstract" else ""
    return rf"(?i)^(?:(?:{rule.titles})\s*$|\d+\.?\s*(?:{numbered})\s*${more})"


def _rule_value(name: Column, field: str) -> Column:
    out = None
    for rule in S.SECTION_RULES:
        value = F.lit(getattr(rule, field))
        out = F.when(name == rule.name, value) if out is None else out.when(name == rule.name, value)
    return out


def lines(papers: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, at (from 0), pos (characters before it), total lines."""
    split = papers.select(key, F.split(text, "\n").alias("all"))
    rows = split.select(key, F.size("all").alias("total"), F.posexplode("all").alias("at", "line"))
    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("pos", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))


def header_list(text: Column) -> Column:
    """Array of struct<name, pos, line_num, confidence>: the header lines of a text, in order.

    Only lines that may be headers are looked at closely; the characters before
    such a line are counted for it alone.  Nothing leaves the row.
    """
    any_title = "|".join(r.titles for r in S.SECTION_RULES)

    def may_be(x: Column) -> Column:
        return (F.length(x["head"]) > 0) & (F.length(x["head"]) <= 200) & x["head"].rlike(rf"(?i)^(?:\d+\.?\s*)?(?:{any_title})")

    def of_line(lines: Column, x: Column) -> Column:
        head, at = x["head"], x["at"]
        names = F.array_compact(F.array(*[F.when(head.rlike(header_pattern(r)), F.lit(r.name)) for r in S.SECTION_RULES]))
        before = F.aggregate(F.slice(lines, 1, at), F.lit(0), lambda n, line: n + F.length(line) + 1)

        def confidence(name: Column) -> Column:
            apart = F.abs(_rule_value(name, "position") - at / F.greatest(F.size(lines), F.lit(1)))
            sure = (
                F.lit(0.5)
                + F.when(apart < 0.1, 0.3).when(apart < 0.3, 0.1).otherwise(-0.2)
                + F.when((F.upper(head) == head) & (F.lower(head) != head), 0.1).otherwise(0.0)
                + F.when(head.rlike(r"^[1-9]\."), 0.2).otherwise(0.0)
                + F.when(F.length(head) < 50, 0.1).otherwise(0.0)
                - F.when(F.lower(head).rlike(r"figure|table|eq\.|equation"), 0.4).otherwise(0.0)
            )
            return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))

        placed = lambda pos: F.transform(names, lambda name: F.struct(name.alias("name"), pos.alias("pos"), at.alias("line_num"), confidence(name).alias("confidence")))
        return F.transform(F.array(before), placed)[0]

    stripped = lambda lines: F.transform(lines, lambda line, i: F.struct(i.alias("at"), strip(line).alias("head")))
    return F.transform(F.array(F.split(text, "\n")), lambda lines: F.flatten(F.transform(F.filter(stripped(lines), may_be), lambda x: of_line(lines, x))))[0]


def section_headers(papers: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, name, pos, line_num, confidence of every header line."""
    return papers.select(key, F.inline(header_list(F.col(text))))


def extract_sections(papers: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, name, content, start_pos, end_pos, level, confidence of the sections of each paper.

    Of several headers of a name the first counts.  A section that is too short
    or too long is left out, yet still ends the one before.  A paper without any
    is one body; text of substance before the first header is an unlabelled
    introduction.  Blank papers have no sections.  All of it is done within the
    row: no text is exchanged.
    """
    sure = F.filter(header_list(F.col(text)), lambda h: h["confidence"] > 0.3)
    ordered = F.array_sort(F.transform(sure, lambda h: F.struct(h["pos"].alias("pos"), (-h["confidence"]).alias("rank"), h["name"].alias("name"))))
    firsts = F.transform(F.array(ordered), lambda all_: F.filter(all_, lambda h, i: ~F.exists(F.slice(all_, 1, i), lambda e: e["name"] == h["name"])))[0]
    # a generator of one row, so that the list is made once
    whole = papers.where(F.col(text).rlike(r"\S")).select(key, F.col(text).alias("_text"), F.explode(F.array(firsts)).alias("heads"))
    ends = F.transform("heads", lambda h, i: F.coalesce(F.get("heads", i + 1)["pos"], F.length("_text")))

    def section(h: Column, end: Column) -> Column:
        body = F.substring(F.col("_text"), h["pos"] + 1, end - h["pos"])
        rest = F.when(F.contains(body, F.lit("\n")), strip(F.substr(body, F.locate("\n", body) + 1))).otherwise(F.lit(""))
        return F.struct(h["name"].alias("name"), rest.alias("content"), h["pos"].alias("start_pos"), end.alias("end_pos"), F.lit(1).alias("level"), (-h["rank"]).alias("confidence"))

    every = F.zip_with("heads", ends, section)
    fits = lambda s: F.exists(F.array(word_count(s["content"])), lambda n: n.between(_rule_value(s["name"], "min_words"), _rule_value(s["name"], "max_words")))
    kept = whole.withColumn("kept", F.explode(F.array(F.filter(every, fits))))
    front = F.substring(F.col("_text"), 1, F.get("heads", F.lit(0))["pos"])
    extra = lambda name, content, end, confidence: F.array(F.struct(F.lit(name).alias("name"), content.alias("content"), F.lit(0).alias("start_pos"), end.alias("end_pos"), F.lit(1).alias("level"), F.lit(confidence).alias("confidence")))
    first_pos = F.get("heads", F.lit(0))["pos"]
    unlabelled = F.coalesce((first_pos > 100) & (word_count(strip(front)) > 50), F.lit(False))
    sections = F.when(F.size("kept") == 0, extra("body", strip(F.col("_text")), F.length("_text"), 0.8)).when(unlabelled, F.concat("kept", extra("introduction_unlabeled", strip(front), first_pos, 0.6))).otherwise(F.col("kept"))
    return kept.select(key, F.inline(sections))


def section_summary(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each paper: counts, names in order, mean confidence, which key sections it has."""
    has = lambda *names: F.coalesce(F.bool_or(F.col("name").isin(*names)), F.lit(False))
    return sections.groupBy(key).agg(
        F.count("*").alias("total_sections"),
        F.sum(word_count(F.col("content"))).alias("total_words"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("name") == "introduction_unlabeled", 1).otherwise(0).alias("late"), "start_pos", "name"))), lambda s: s["name"]).alias("sections_found"),
        F.avg("confidence").alias("avg_confidence"),
        has("abstract").alias("has_abstract"),
        has("introduction", "introduction_unlabeled").alias("has_introduction"),
        has("conclusion").alias("has_conclusion"),
        has("references").alias("has_references"),
    )


def summaries(papers: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The section summary of every paper; a blank one has none of anything."""
    found = section_summary(extract_sections(papers, key, text), key)
    out = papers.select(key).distinct().join(found, key, "left")
    empty = {"total_sections": F.lit(0), "total_words": F.lit(0), "sections_found": F.array().cast("array<string>"), "avg_confidence": F.lit(0.0)}
    return out.select(key, *[F.coalesce(c, empty.get(c, F.lit(False))).alias(c) for c in found.columns if c != key])


def pack_sentences(content: Column, limit: int = S.CHUNK_CHARS) -> Column:
    """Chunks of whole sentences, at most ``limit`` characters unless one sentence is longer."""
    pieces = F.split(content, r"(?<=[.!?])\s+")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def add(acc: Column, piece: Column) -> Column:
        full = (acc["n"] + F.length(piece) > limit) & (F.size(acc["now"]) > 0)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(piece)).otherwise(F.concat(acc["now"], F.array(piece))).alias("now"),
            (F.when(full, F.lit(0)).otherwise(acc["n"]) + F.length(piece) + 1).alias("n"),
        )

    packed = F.aggregate(pieces, start, add, lambda acc: F.transform(F.concat(acc["done"], F.array(acc["now"])), lambda c: F.array_join(c, " ")))
    return F.when(F.length(content) <= limit, F.array(content)).otherwise(packed)


def chunk_sections(sections: DataFrame, key: str = "doc_id", limit: int = S.CHUNK_CHARS, confidence: float | None = None) -> DataFrame:
    """key, chunk_id, section, text, char_count, word_count, section_confidence.

    Sections in their fixed order; chunk ids count from 0 within a paper.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in S.SECTION_ORDER]), F.col("name"))
    known = sections.withColumn("_order", order).where("_order > 0")
    sure = F.col("confidence") if confidence is None else F.lit(confidence)
    rows = known.select(key, "_order", F.col("name").alias("section"), sure.alias("section_confidence"), F.posexplode(pack_sentences(F.col("content"), limit)).alias("_part", "text"))
    rows = rows.withColumn("char_count", F.length("text")).withColumn("word_count", word_count(F.col("text")))  # before rows are exchanged: a caller may drop the text
    number = F.row_number().over(Window.partitionBy(key).orderBy("_order", "_part")) - 1
    return rows.select(key, number.alias("chunk_id"), "section", "text", "char_count", "word_count", "section_confidence")


def number_batches(chunks: DataFrame, key: str, then: str, size: int = S.CHUNK_BATCH, ranges: int = 256) -> DataFrame:
    """Add batch: the number of the thousand that a chunk falls in, by (key, then).

    ``key`` is numeric.  Its quantiles cut the rows into ordered ranges (literals
    in the plan, so every pass cuts alike); ranges are counted, and rows are
    numbered inside their range, so no task sees all rows.  The chunks are made
    once, into files that the three passes read.
    """
    chunks = cut(chunks, "chunks")
    shares = [k / ranges for k in range(1, ranges)]
    bounds = chunks.agg(F.percentile_approx(key, shares, 1000).alias("b")).first()["b"] or []
    cuts = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<long>")
    ranged = chunks.withColumn("_range", F.size(F.filter(cuts, lambda b: b < F.col(key))))
    inside = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(key, then)))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    out = inside.join(F.broadcast(starts), "_range")
    return out.withColumn("batch", F.floor((F.col("_start") + F.col("_in") - 1) / size).cast("int")).drop("_range", "_in", "_start")


def simple_sections(papers: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, header, content: the simple splitter.  A line is a header if it is, begins or ends
    with one of the known titles; of a header met again the last content stays."""
    low = F.lower(strip(F.col("line")))
    header = F.coalesce(*[F.when((low == h) | low.startswith(h + " ") | low.endswith(" " + h), F.lit(h)) for h in S.SIMPLE_HEADERS])
    rows = lines(papers, key, text).select(key, "at", "line", header.alias("header"))
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("run", F.sum(F.col("header").isNotNull().cast("int")).over(upto)).withColumn("name", F.coalesce(F.last("header", ignorenulls=True).over(upto), F.lit("body")))
    body = runs.where(F.col("header").isNull() & F.col("line").rlike(r"\S"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    made = body.groupBy(key, "name", "run").agg(strip(content).alias("content"))
    return made.groupBy(key, F.col("name").alias("header")).agg(F.max_by("content", "run").alias("content"))
