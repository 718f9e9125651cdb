"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = r"[A-Za-z0-9._%+-]"
#: An IPv4 part of at most 255, leading zeros allowed.
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Characters looked at on either side of a span.
CONTEXT = 40
#: Offsets are summed over blocks of so many matches, which keeps texts with very many matches cheap.
BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. The patterns are possessive and anchored by what stands before them, so that each finds
    what its plain leftmost, non-overlapping form finds, less what `confirm` would drop, without backtracking.

    hint: what a text holds if it holds a span at all. needs_context: a span counts only near one of the words.
    """

    name: str
    pattern: str
    hint: str
    confirm: object
    words: str
    score: float
    base: bool = True
    needs_context: bool = False


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Whether an IBAN's number, its first four characters moved to the end and letters as 10 to 35, leaves 1 mod 97."""
    code = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    return F.length(code).between(15, 34) & (F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1)


KINDS = (
    # a run of local characters starts where the last match ended, or after another character
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), r"mail|contact|write to|kontakt|correo|courriel", 0.9),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}", ".", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), r"\bip\b|host|server|address|adresse|login", 0.7),
    Kind("card", r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", "", lambda m: F.call_function("luhn_check", _digits(m)), r"card|visa|master|credit|karte|carte|tarjeta|pay", 0.8),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", lambda m: F.length(_digits(m)).between(10, 15), r"phone|tel|call|mobile|fax|fon", 0.7),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", _mod97, r"iban|account|konto|compte|cuenta|bank", 0.8, base=False),
    Kind("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_=-])", "", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), r"token|secret|key|passw|pwd|credential|bearer|auth", 0.7, base=False, needs_context=True),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", lambda m: F.lit(True), r"ssn|social security", 0.5, base=False, needs_context=True),
)


def _add(a: Column, x: Column) -> Column:
    return a + x


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The confirmed spans of every whole text: id, text and spans, an array of (start, rank, end, kind, score) in order.

    Offsets count code points and the end is exclusive. A null text counts as empty and has no spans. Rows stay as they
    are, repeated ones and null ids too; other columns are ignored. The score is the kind's own, more by 0.1 if a context
    word stands within CONTEXT characters, up to the neighbouring spans of its kind, less by 0.2 if not.
    """
    names = [k.name for k in kinds]
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    found = {k.name: F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)) for k in kinds}
    df = df.select("id", "text", *[(F.when(F.contains("text", F.lit(k.hint)), found[k.name]).otherwise(none) if k.hint else found[k.name]).alias(f"m_{k.name}") for k in kinds])
    # what stands between the matches: one piece more than matches
    df = df.select("*", *[F.when(F.size(f"m_{k.name}") > 0, F.split("text", k.pattern, -1)).otherwise(none).alias(f"g_{k.name}") for k in kinds])

    def chunks(n: str) -> Column:
        steps = F.transform(f"m_{n}", lambda m, i: F.length(F.get(f"g_{n}", i)) + F.length(m))
        last = F.floor(F.size(steps) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))

    def before(n: str) -> Column:
        totals = F.transform(f"c_{n}", lambda c: F.aggregate(c, F.lit(0), _add))
        return F.transform(totals, lambda t, i: F.aggregate(F.slice(totals, F.lit(1), i), F.lit(0), _add))

    df = df.select("*", *[F.when(F.size(f"m_{n}") > 0, chunks(n)).alias(f"c_{n}") for n in names])
    df = df.select("*", *[F.when(F.size(f"m_{n}") > 0, before(n)).alias(f"b_{n}") for n in names])

    def spans(rank: int, k: Kind) -> Column:
        gap = lambda i: F.get(f"g_{k.name}", i)

        def one(m: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            within = F.aggregate(F.slice(F.get(f"c_{k.name}", block), F.lit(1), i % BLOCK), F.lit(0), _add)
            start = F.get(f"b_{k.name}", block) + within + F.length(gap(i))
            around = F.lower(F.concat(F.substring(gap(i), -CONTEXT, CONTEXT), F.lit(" "), F.substring(gap(i + 1), 1, CONTEXT)))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), k.confirm(m).alias("ok"), around.rlike(k.words).alias("near"))

        kept = F.filter(F.transform(f"m_{k.name}", one), lambda s: s["ok"] & s["near"] if k.needs_context else s["ok"])
        score = lambda s: F.when(s["near"], k.score + 0.1).otherwise(k.score - 0.2)
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(k.name).alias("kind"), score(s).alias("score")))

    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    df = df.select("id", "text", *[F.when(F.size(f"m_{k.name}") > 0, spans(r, k)).otherwise(empty).alias(f"x_{k.name}") for r, k in enumerate(kinds)])
    return df.select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.array_sort(F.concat(*[f"x_{n}" for n in names])).alias("spans"))


def redact(found: DataFrame, text_col: str = "text") -> Column:
    """The text of a row of find() with each span, but those inside an earlier one, replaced by its kind in angle brackets."""
    text, spans = F.col(text_col), F.col("spans")

    def step(state: Column, s: Column) -> Column:
        put = F.concat(state["text"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("<"), s["kind"], F.lit(">"))
        inside = s["start"] < state["at"]
        return F.struct(F.when(inside, state["text"]).otherwise(put).alias("text"), F.when(inside, state["at"]).otherwise(s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda s: F.concat(s["text"], F.substring(text, s["at"] + 1, F.length(text))))


def _of(kind: str):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame, id_col: str = "doc_id", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Per row of find(): id, n_<kind> of each base kind, base_sha256, spans as text, scores as text in the same order, and
    n_<kind> of the other kinds."""
    base, added = [k.name for k in kinds if k.base], [k.name for k in kinds if not k.base]
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        id_col,
        *[F.size(F.filter("spans", _of(n))).cast("long").alias(f"n_{n}") for n in base],
        F.sha2(written(own), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
        *[F.size(F.filter("spans", _of(n))).cast("long").alias(f"n_{n}") for n in added],
    )
