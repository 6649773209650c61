"""Session blocks of a report's body: by header lines, by severity, or the whole text. Windows and aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.functions.text import stripped
from scoria.operators.pages import ordered_text, text_lines
from scoria.profiles import PLUGIN_HEADER

#: Header lines of the two report kinds, and of the severity field.
HEADER = r"(?i)^(?:\d+\.\d+\.\d+\s+)?(Critical|High|Medium|Low|Log)\s+(\d+|general)/([a-zA-Z0-9_-]+)"
PORT_LINE = r"(?i)^(\d+|general)/([a-zA-Z0-9_-]+)"
SEVERITY_FIELD = r"(?i)^\s*SEVERITY\s+(CRITICAL|HIGH|MEDIUM|LOW|INFO)\s*$"
BUCKETS = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def _part(line: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, n), F.lit(""))


def header_context(summaries: DataFrame) -> DataFrame:
    """Per document the last header line of its summary: ``severity``, ``port``, ``protocol`` and ``context``, the up to five lines that end there.

    Without a header line the context is the last five lines, and the attributes are null. Blank lines don't count.
    """
    lines = text_lines(summaries).select("doc_id", stripped(F.col("line")).alias("line"), "line_no").filter("line <> ''")
    numbered = lines.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    head = F.when(F.col("line").rlike(HEADER), F.struct("n", "line"))
    found = numbered.groupBy("doc_id").agg(F.max(head).alias("h"), F.max("n").alias("last"))
    end = F.coalesce(F.col("h.n"), F.col("last"))
    near = numbered.join(found.select("doc_id", "h", end.alias("end")), "doc_id").filter((F.col("n") <= F.col("end")) & (F.col("n") > F.col("end") - 5))
    out = near.groupBy("doc_id").agg(F.first("h.line").alias("h"), ordered_text("n", "line").alias("context"))
    return out.select("doc_id", *(_part(F.col("h"), HEADER, k).alias(n) for k, n in enumerate(("severity", "port", "protocol"), 1)), "context")


def header_blocks(bodies: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """OpenVAS-like: a header line begins a block, and its severity, port and protocol hold until the next.

    ``doc_id``, ``block_id`` (from 1), ``severity``, ``port``, ``protocol``, ``text``. Before the first header the
    attributes are those of the line two above the first NVT: line, or the context's. The context, if there is one,
    stands above the first block, set off by ---.
    """
    lines = text_lines(bodies).withColumn("bare", stripped(F.col("line")))
    in_order = Window.partitionBy("doc_id").orderBy("line_no")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy("doc_id")
    lines = lines.withColumn("head", F.col("bare").rlike(HEADER)).withColumn("above", F.lag("bare", 2).over(in_order))
    first_nvt = F.min(F.when(F.col("bare").startswith("NVT:"), F.struct("line_no", "above"))).over(everything)
    lines = lines.withColumn("early", first_nvt["above"])
    # a header as the text's first line begins block 1; anything before the first header is block 1 by itself
    lines = lines.withColumn("block_id", F.greatest(F.sum(F.col("head").cast("int")).over(so_far) + (~F.first("head").over(in_order)).cast("int"), F.lit(1)))
    values = {}
    for k, name in enumerate(("severity", "port", "protocol"), 1):
        early = _part(F.col("early"), HEADER, k)
        if name != "severity":
            early = F.coalesce(early, F.when(~F.col("early").rlike(HEADER), _part(F.col("early"), PORT_LINE, k - 1)))
        values[name] = F.coalesce(F.last(F.when(F.col("head"), _part(F.col("bare"), HEADER, k)), True).over(so_far), early)
    lines = lines.withColumns(values)
    blocks = lines.groupBy("doc_id", "block_id").agg(*(F.max(n).alias(n) for n in values), ordered_text("line_no", "line").alias("text"))
    if context is None:
        return blocks.select("doc_id", "block_id", "severity", "port", "protocol", "text")
    with_context = blocks.alias("b").join(context.alias("c"), "doc_id", "left")
    first = F.col("b.block_id") == 1
    text = F.when(first & F.col("c.context").isNotNull(), F.concat("c.context", F.lit("\n---\n"), "b.text")).otherwise(F.col("b.text"))
    return with_context.select("doc_id", "b.block_id", *(F.coalesce(F.col(f"b.{n}"), F.when(first, F.col(f"c.{n}"))).alias(n) for n in values), text.alias("text"))


def severity_blocks(bodies: DataFrame) -> DataFrame:
    """Tenable-like: lines go to the severity of the last plugin header; one block per severity, from CRITICAL down.

    Lines before the first header are kept, in front, if one of them is a severity field; its first value takes them.
    Port and protocol are null. Texts without any header have no blocks.
    """
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy("doc_id")
    lines = text_lines(bodies).withColumn("own", F.upper(_part(F.col("line"), f"(?i){PLUGIN_HEADER}", 1)))
    lines = lines.withColumn("severity", F.last("own", True).over(so_far))
    early = F.min(F.when(F.col("severity").isNull() & F.col("line").rlike(SEVERITY_FIELD), F.struct("line_no", F.upper(_part(F.col("line"), SEVERITY_FIELD, 1)).alias("s")))).over(everything)["s"]
    lines = lines.withColumn("any", F.count("own").over(everything) > 0).withColumn("severity", F.coalesce("severity", early)).filter("any AND severity IS NOT NULL")
    rank = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("severity")).cast("int")
    blocks = lines.groupBy("doc_id", "severity").agg(ordered_text("line_no", "line").alias("text"))
    nothing = F.lit(None).cast("string")
    return blocks.select("doc_id", rank.alias("block_id"), "severity", nothing.alias("port"), nothing.alias("protocol"), "text")


def whole_blocks(bodies: DataFrame) -> DataFrame:
    """Other scanners: the whole text is one block without attributes."""
    nothing = F.lit(None).cast("string")
    return bodies.select("doc_id", F.lit(1).alias("block_id"), nothing.alias("severity"), nothing.alias("port"), nothing.alias("protocol"), "text")


SEGMENTERS = {"openvas": header_blocks, "tenable": lambda bodies, context=None: severity_blocks(bodies)}


def session_blocks(bodies: DataFrame, scanner: str, context: DataFrame | None = None) -> DataFrame:
    """By the scanner's exact name; any other has one whole block per document."""
    segment = SEGMENTERS.get(scanner)
    return segment(bodies, context) if segment else whole_blocks(bodies)
