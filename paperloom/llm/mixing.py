"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut
from paperloom.llm.ranks import running_sum, seeded, source_key

WORD = r"[^\x20\x09-\x0D]+"
#: ASCII symbols and digits; much of them marks junk.
SYMBOLS = r"[#$%&*+/<=>@\\^_`{|}~0-9]"
WEIGHTS = (5, 2, 1)
#: A source's words are taken this often at most.
REPEATS = 3
SEED = "mix-1"


def quality_weight(text: Column) -> Column:
    """1 for clean text, down to 0.1 as symbols and digits make up its characters."""
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(4.0) * F.regexp_count(text, F.lit(SYMBOLS)) / F.greatest(F.length(text), F.lit(1)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, repeats: int = REPEATS) -> DataFrame:
    """key, source_size, target of each source, from (key, source_size).

    Targets share ``share`` of all words by weight, none above ``repeats`` times
    its source; the excess is shared again by weight.  In the order of their
    ratio cap / weight, sources stop at their cap until the level that the rest
    would get lies below the next ratio; one pass of running sums finds it.
    A row for each source: the table is as small as the list of sources.
    """
    place = F.row_number().over(Window.orderBy("key")) - 1
    listed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    listed = listed.withColumn("cap", F.col("source_size") * repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(onward)
    levelled = listed.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("w") <= F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("key"), F.col("level")))).over(everything)
    return levelled.withColumn("final", final["level"]).select("key", "source_size", F.when(F.col("capped") | F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("final")).alias("target"))


def _drawn(docs: DataFrame, carried: list[Column], weights: tuple[int, ...], share: float, repeats: int, seed: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(*carried, "doc_id", "source", size.alias("size"), F.coalesce(quality_weight(F.col("text")), F.lit(0.1)).alias("quality"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    rows = rows.withColumn("key", source_key(F.col("source")))
    if not carried:
        rows = cut(rows, "mix")
    # a row for each source, in a file: the planner sees its size and joins accordingly
    targets = cut(source_targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share, repeats), "targets")
    u = (seeded(seed, F.col("doc_id"), F.col("crc")) + F.lit(0.5)) / F.lit(float(1 << 60))
    rows = rows.withColumn("draw", -F.log(u) / F.col("quality"))
    rows = rows.withColumn("bucket", F.floor(F.log1p(F.col("draw") * 4) * 512).cast("int"))
    order = [F.col(c) for c in ("draw", "doc_id", "crc", "size")]
    out = running_sum(rows, ["key"], "bucket", order, F.col("size"), "before").join(targets, "key")
    out = out.withColumn("goal", F.floor(F.col("target") + F.lit(0.5)))
    out = out.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)).cast("long"))
    left = F.col("goal") - F.col("epochs") * F.col("source_size")
    return out.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("before"))).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, part, taken of each row of ``docs``.

    size counts the words of the text.  A source whose target holds it e times
    over gives e whole epochs; what is left of the target is filled by rows in
    the order of -ln(u) / quality, u from a seeded hash, until the running sum
    of their sizes meets it.  ``part`` is the number of words of that last,
    partial pass: the size, 0, or for the row at the cut its first words, so a
    source gives its target to the word.  taken = epochs * size + part.

    Null or blank texts have size 0 and are never drawn; the null source is a
    source of its own, last.  Repeated rows are drawn one by one.  Other columns
    are ignored.  Reruns agree.
    """
    out = _drawn(docs, [], weights, share, repeats, seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def draw_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a row for each epoch and one for
    the partial pass.  A text at the cut ends after its last word taken (n_chars, if there,
    follows).  Rows of size 0 give no row."""
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    out = _drawn(docs, [F.struct(*docs.columns).alias("row")], weights, share, repeats, seed)
    copies = F.when(F.col("size") > 0, F.col("epochs") + (F.col("part") > 0).cast("long")).otherwise(F.lit(0))
    rows = out.where(copies > 0).select("row", "size", "part", "epochs", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))
    pieces = F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("part").cast("int"))
    short = (F.col("copy") > F.col("epochs")) & (F.col("part") < F.col("size"))
    rows = rows.withColumn("text", F.when(short, F.regexp_replace(F.array_join(pieces, ""), r"[\x20\x09-\x0D]+$", "")).otherwise(F.col("row.text")))
    chosen = {"text": F.col("text"), "n_chars": F.when(short, F.length("text").cast(kind)).otherwise(F.col("row.n_chars")) if kind else None}
    return rows.select(*[chosen[c].alias(c) if chosen.get(c) is not None else F.col("row")[c].alias(c) for c in docs.columns])
