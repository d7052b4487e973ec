"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust their score.

DataFrame expressions only.  The patterns are possessive and begin where a run of their characters begins, so they run in
time proportional to the text, however long a run is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds every match of which counts; the others need ``LEAST_SCORE``.
BASE = ("email", "ip", "card", "phone")
LEAST_SCORE = 0.5
#: Code points before and after a span in which context words count.
BEFORE, AFTER = 48, 24
#: Matches whose places are added up together.
CHUNK = 256


@dataclass(frozen=True)
class Kind:
    """A pattern, a cheap sign without which it can't match, a check of ``hit``, a score, and context words that raise or lower it."""

    name: str
    pattern: str
    check: str
    score: float
    context: str
    against: str = "example|sample|test|dummy|version|invoice number|order number"
    sign: str | None = None


_DIGITS = "regexp_replace(hit, '[^0-9]', '')"
_LUHN = (f"aggregate(transform(sequence(1, length({_DIGITS})), i -> cast(substr(reverse({_DIGITS}), i, 1) as int) * (2 - i % 2)),"
         " 0, (s, x) -> s + if(x > 9, x - 9, x)) % 10 = 0")
_MOVED = "concat(substr(upper(replace(hit, ' ', '')), 5), substr(upper(replace(hit, ' ', '')), 1, 4))"
_MOD97 = (f"aggregate(transform(sequence(1, length({_MOVED})), i -> ascii(substr({_MOVED}, i, 1))), 0,"
          " (s, c) -> if(c >= 65, s * 100 + c - 55, s * 10 + c - 48) % 97) = 1")
#: ``\G`` is the end of the match before: a run may be taken up again there.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.9,
         "e-?mail|mail to|contact|write to", sign="@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         "forall(split(hit, '[.]'), p -> p rlike '^0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')", 0.6,
         "ip|address|host|server|login|from", sign="."),
    # Just the chains of 16 to 19 digits; a chain begins behind neither a digit nor a digit and a separator.
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", _LUHN, 0.8,
         "card|credit|visa|mastercard|payment|pay|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 8 and 15", 0.7,
         "phone|call|tel|mobile|fax|telefon|appelez|llame", sign="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _MOD97, 0.8,
         "iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         "substr(hit, 1, 3) not in ('000', '666') and substr(hit, 1, 1) <> '9' and substr(hit, 5, 2) <> '00' and substr(hit, 8) <> '0000'",
         0.3, "ssn|social security|tax id", sign="-"),
    Kind("local_phone", r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])", "true", 0.3,
         "phone|call|tel|mobile|fax|telefon|appelez|llame"),
)
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: Kind) -> str:
    """SQL for the spans of ``kind`` from the columns ``text``, ``hits_<kind>`` and ``gaps_<kind>`` (what lies between the hits).

    Places are sums of lengths, added up in chunks and then over chunks, so many matches don't cost their square.
    """
    hits, gaps = f"hits_{kind.name}", f"gaps_{kind.name}"
    steps = f"zip_with({hits}, slice({gaps}, 1, size({hits})), (h, g) -> named_struct('gap', length(g), 'len', length(h)))"
    chunk = (f"aggregate(slice(steps, c * {CHUNK} + 1, {CHUNK}), named_struct('at', 0L, 'ends', cast(array() as array<bigint>)),"
             " (s, x) -> named_struct('at', s.at + x.gap + x.len, 'ends', concat(s.ends, array(s.at + x.gap + x.len))))")
    chunks = f"transform(sequence(0, (size(steps) - 1) div {CHUNK}), c -> {chunk})"
    offsets = ("aggregate(chunks, named_struct('at', 0L, 'all', cast(array() as array<bigint>)),"
               " (s, x) -> named_struct('at', s.at + x.at, 'all', concat(s.all, array(s.at)))).all")
    ends = f"flatten(zip_with(chunks, {offsets}, (x, o) -> transform(x.ends, e -> e + o)))"
    # Names for parts of an expression: a transform over an array of one.
    ends = f"transform(array({chunks}), chunks -> {ends})[0]"
    ends = f"transform(array({steps}), steps -> {ends})[0]"
    near = (f"lower(concat_ws(' ', substr(text, cast(greatest(e - length(hit) - {BEFORE}, 0) as int) + 1,"
            f" cast(least(e - length(hit), {BEFORE}) as int)), substr(text, cast(e as int) + 1, {AFTER})))")
    score = (f"transform(array({near}), near -> round(least(1D, greatest(0D, {kind.score}D"
             f" + if(near rlike {_literal(f'(?<![a-z])(?:{kind.context})(?![a-z])')}, 0.3D, 0D)"
             f" - if(near rlike {_literal(f'(?<![a-z])(?:{kind.against})(?![a-z])')}, 0.2D, 0D))), 3))[0]")
    found = (f"zip_with({hits}, {ends}, (hit, e) -> if({kind.check}, named_struct('kind', {_literal(kind.name)}, 'start', e - length(hit),"
             f" 'end', e, 'score', {score}), null))")
    least = "" if kind.name in BASE else f" and x.score >= {LEAST_SCORE}"
    return f"if(size({hits}) = 0, cast(array() as {_SPAN}), filter({found}, x -> x is not null{least}))"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
               kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(id, *keep, text, spans) per row, over the whole text; a null text is empty.

    ``spans`` lists kind, start, end (code points, end exclusive) and score, by kind as in ``kinds``, then start.  Within a kind matches
    are the leftmost that don't overlap, and those that fail their check are dropped without another try; spans of
    different kinds may overlap.  All base kinds stay whatever their score.  Repeated rows and null ids stay, an empty table gives none; nothing is shuffled.
    """
    rows = docs.select(F.col(id_col), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = [id_col, *keep]

    def hits(kind: Kind) -> Column:
        found = F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))
        return found if kind.sign is None else F.when(F.contains("text", F.lit(kind.sign)), found).otherwise(
            F.array().cast("array<string>"))

    rows = rows.select(*names, "text", *(hits(k).alias(f"hits_{k.name}") for k in kinds))
    rows = rows.select("*", *(F.when(F.size(f"hits_{k.name}") > 0, F.split("text", k.pattern, -1)).alias(f"gaps_{k.name}") for k in kinds))
    return rows.select(*names, "text", F.concat(*(F.expr(_spans(k)) for k in kinds)).alias("spans"))


def redact(found: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``text`` with every span replaced by its kind, as ``<EMAIL>``; overlapping spans become one, named by the first."""
    order = ("array_sort(spans, (a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1"
             " when a.end > b.end then -1 when a.end < b.end then 1 else 0 end)")
    kind = "struct<start:bigint,end:bigint,kind:string>"
    merged = (f"aggregate({order}, cast(array() as array<{kind}>), (m, x) -> if(size(m) > 0 and x.start < m[size(m) - 1].end,"
              " concat(slice(m, 1, size(m) - 1), array(named_struct('start', m[size(m) - 1].start,"
              " 'end', greatest(m[size(m) - 1].end, x.end), 'kind', m[size(m) - 1].kind))),"
              " concat(m, array(named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))))")
    rows = found.select(*columns, "text", F.when(F.size("spans") > 0, F.expr(merged)).alias("__merged"))
    parts = ("concat(array_join(transform(__merged, (x, i) -> concat(substr(text, cast(if(i = 0, 0L, __merged[i - 1].end) as int) + 1,"
             " cast(x.start - if(i = 0, 0L, __merged[i - 1].end) as int)), '<', upper(x.kind), '>')), ''),"
             " substr(text, cast(__merged[size(__merged) - 1].end as int) + 1))")
    return rows.select(*columns, F.when(F.col("__merged").isNull(), F.col("text")).otherwise(F.expr(parts)).alias("text"))
