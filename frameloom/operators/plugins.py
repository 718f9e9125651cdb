"""Parsers that users bring: table functions of a contract, chosen by a table of plugins, beside the built-in rule tables.

A parser is a Python class with `analyze`, which tells from the arguments what columns it gives, and `eval` and `terminate`,
which see the rows of one frame in order. Spark deals frames out and runs parsers where the frames are; the built-in parsers
stay SQL expressions and start no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from . import lookups

#: What every parser is given of a region, and what it has to give beside columns of its own.
GIVEN = ("stream", "frame", "idx", "text", "confidence", "x", "y", "w", "h")
LEAST = ("stream", "frame", "idx", "semantic_type", "confidence")


def frame_by_frame(schema: StructType) -> AnalyzeResult:
    """The result of analyze() for a parser that sees one frame at a time, in order of idx."""
    missing = [c for c in LEAST if c not in schema.fieldNames()]
    if missing:
        raise ValueError(f"a parser's columns lack {', '.join(missing)}")
    return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("stream"), PartitioningColumn("frame")], orderBy=[OrderingColumn("idx")])


class ShortLineBlocks:
    """A parser of the contract: runs of short lines as one structured element each, with the box around them all.

    most: characters of a short line, under. columns: names of text columns that the first lines of a block fill, if any.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, most: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
        types = {f.name: f.dataType for f in table.dataType.fields}
        own = [StructField(c, StringType()) for c in (columns.value or "").split(",") if c]
        box = [StructField(c, DoubleType()) for c in "xywh"]
        fixed = [StructField("stream", types["stream"]), StructField("frame", types["frame"]), StructField("idx", LongType()), StructField("semantic_type", StringType()), StructField("confidence", DoubleType()), StructField("lines", ArrayType(StringType()))]
        return frame_by_frame(StructType([*fixed, *box, *own]))

    def __init__(self):
        self.key, self.held, self.done = None, [], []

    def eval(self, row, most: int, columns: str):
        self.key, self.columns = (row["stream"], row["frame"]), len([c for c in (columns or "").split(",") if c])
        if row["text"] and row["text"].strip() and len(row["text"]) < most:
            self.held.append(row)
        else:
            yield from self._block()

    def terminate(self):
        yield from self._block()

    def _block(self):
        rows, self.held = self.held, []
        if len(rows) < 2:
            return
        left, top = min(r["x"] for r in rows), min(r["y"] for r in rows)
        right, bottom = max(r["x"] + r["w"] for r in rows), max(r["y"] + r["h"] for r in rows)
        lines = [r["text"] for r in rows]
        yield (*self.key, rows[0]["idx"], "block", sum(r["confidence"] for r in rows) / len(rows), lines, left, top, right - left, bottom - top, *[lines[k] if k < len(lines) else None for k in range(self.columns)])


def parsed(regions: DataFrame, plugins: DataFrame, parsers: dict[str, tuple], bundle: str = "app") -> DataFrame:
    """What the enabled user parsers give of the regions that are routed to them: plugin, the contract's columns, and the
    others as JSON in `more`.

    plugins: plugin, pattern, enabled. parsers: by plugin a parser class and its arguments. Of plugins without a parser here
    (the built-in ones) nothing is read. Parsers run in tasks, a frame at a time; a table of no rows gives none.
    """
    active = plugins.where("enabled").select("plugin", "pattern")
    routed = lookups.plugin_routes(regions.withColumnRenamed(bundle, "bundle"), active)
    out = []
    for name, (parser, *arguments) in parsers.items():
        own = routed.where(F.col("plugin") == name).select(*GIVEN)
        made = F.udtf(parser)(own.asTable(), *map(F.lit, arguments))
        more = [c for c in made.columns if c not in LEAST]
        out.append(made.select(F.lit(name).alias("plugin"), *LEAST, F.to_json(F.struct(*more)).alias("more")))
    return reduce(DataFrame.unionByName, out)
