"""Terminal sessions as an automaton over sorted lines: sessions, directories, and commands with their output."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import parsers

#: Fixed value: where a session begins.
HOME = "~"


def moved(at: str, before: str, to: str) -> str:
    """The directory after cd: home without a name or with ~, the last one with -, else by the parts of the name."""
    if to in ("", HOME):
        return HOME
    if to == "-":
        return before
    root, parts = ("/", []) if to.startswith("/") else (HOME, []) if to.startswith(HOME + "/") else (at[:1], [p for p in at[1:].split("/") if p])
    for p in to.removeprefix(HOME).split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts = [*parts, p]
    return root.rstrip("/") + "/" + "/".join(parts) if parts else root


def _ended() -> Column:
    return F.expr(parsers.any_of("logout", "exit", "connection closed", "session ended", "terminal session closed"))


def executions(lines: DataFrame) -> DataFrame:
    """A row per command: stream, session, number in it, frame, idx, command, directory it ran in, n_output lines, failed.

    Over the lines of a stream in order of (frame, idx): a line that ends a session begins the next one, at home; cd moves;
    lines that are no commands are output of the command before, which failed if one of them tells of an error. Output
    before the first command belongs to nothing. One pass holds the open command and two directories, however long a
    stream is; empty lines are left out.
    """
    r = parsers._read(lines, None)
    words = F.filter(F.split(F.regexp_replace("t", "^[$%#] ", ""), " "), lambda w: w != "")
    at = F.when(F.get(words, F.lit(0)) == "sudo", 2).otherwise(1)
    is_command = F.expr(parsers.COMMAND_LINE)
    r = r.select(
        "stream", F.col("frame").cast("long").alias("frame"), F.col("idx").cast("long").alias("idx"), F.when(is_command, F.col("cmd")).alias("command"), F.coalesce(F.get(words, at), F.lit("")).alias("to"),
        F.expr(parsers.TERMINAL_ERROR).alias("error"), _ended().alias("ends"))

    def run(batches):
        stream, state, held, first = None, None, None, True
        names = ["stream", "session", "number", "frame", "idx", "command", "directory", "n_output", "failed"]

        def closed():
            return [tuple(held)] if held else []

        out = []
        for batch in batches:
            for of, frame, idx, command, to, error, ends in zip(*(batch.column(c).to_pylist() for c in ("stream", "frame", "idx", "command", "to", "error", "ends"))):
                if first or of != stream:
                    out += closed()
                    first, stream, held = False, of, None
                    state = {"session": 1, "number": 0, "at": HOME, "before": HOME}
                if command is not None:
                    out += closed()
                    state["number"] += 1
                    held = [of, state["session"], state["number"], frame, idx, command, state["at"], 0, False]
                    if command == "cd":
                        state["at"], state["before"] = moved(state["at"], state["before"], to), state["at"]
                elif held:
                    held[7] += 1
                    held[8] = held[8] or bool(error)
                if ends:
                    out += closed()
                    held = None
                    state = {"session": state["session"] + 1, "number": 0, "at": HOME, "before": HOME}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), pa_schema)], names=names)
                out = []
        out += closed()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), pa_schema)], names=names)

    key = lines.schema["stream"].dataType
    schema = r.select("stream").schema.add("session", "integer").add("number", "integer").add("frame", "long").add("idx", "long").add("command", "string").add("directory", "string").add("n_output", "integer").add("failed", "boolean")
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(key), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
    pa_schema = [pa.field(str(k), t) for k, t in enumerate(types)]
    return r.repartition("stream").sortWithinPartitions("stream", "frame", "idx").mapInArrow(run, schema)


def sessions(done: DataFrame) -> DataFrame:
    """Per session: first and last command's time, commands, how many a minute (null at once), shares of productive and of
    failed ones, the last directory, and the first workflow patterns."""
    minutes = (F.max("frame") - F.min("frame")) / 60
    g = done.groupBy("stream", "session").agg(
        F.min("frame").alias("start"), F.max("frame").alias("end"), F.count("*").alias("commands"), minutes.alias("minutes"), F.round(F.avg(F.col("command").isin(*parsers.PRODUCTIVE).cast("double")), 6).alias("productivity"),
        F.round(F.avg(F.col("failed").cast("double")), 6).alias("error_rate"), F.max_by("directory", "number").alias("directory"), F.sum("n_output").alias("n_output"))
    return g.withColumn("per_minute", F.round(F.when(F.col("minutes") > 0, F.col("commands") / F.col("minutes")), 6)).drop("minutes")


def repeated_sequences(done: DataFrame, length: int = 2, least: int = 2) -> DataFrame:
    """Sequences of consecutive commands that a stream shows `least` times or more within its sessions, and how often."""
    w = Window.partitionBy("stream", "session").orderBy("number")
    said = F.array(F.col("command"), *[F.lead("command", k).over(w) for k in range(1, length)])
    s = done.withColumn("sequence", said).where(F.col("sequence")[length - 1].isNotNull())
    return s.groupBy("stream", "sequence").agg(F.count("*").alias("n")).where(F.col("n") >= least)
