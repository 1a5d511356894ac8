"""Personal data in texts, with Spark's own functions alone.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for IBANs, ranges
for addresses), and words nearby move the score. Positions come from the gaps between the matches:
``split`` and ``regexp_extract_all`` walk the same matches, so a match starts where the lengths of
the gaps and matches before it end. The lengths are summed block by block of ``BLOCK`` matches, and then the
blocks, so a text with very many matches stays cheap. All lengths are in code points.

The patterns are written so that Java's matcher neither recurses nor rescans: possessive quantifiers,
and a look-behind that lets a match begin only at the start of a run or where the last match ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """``likely``: a cheap test that a text can hold a match. ``valid`` and ``prior`` are SQL over the match ``m``."""

    name: str
    likely: str
    pattern: str
    valid: str
    prior: float
    context: str
    least: float = 0.0


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = f"""aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) ->
    IF(i % 2 = 0, int(c), IF(int(c) > 4, 2 * int(c) - 9, 2 * int(c)))), 0, (a, c) -> a + c) % 10 = 0"""
#: The first four characters go to the end, letters count 10 to 35, and the remainder by 97 must be 1.
_MOD97 = """aggregate(split(concat(substring(replace(m, ' ', ''), 5), substring(replace(m, ' ', ''), 1, 4)), ''), 0, (a, c) ->
    IF(c >= 'A', (a * 100 + ascii(c) - 55) % 97, (a * 10 + int(c)) % 97)) = 1"""

#: Length of an IBAN by its country, from the public registry. Fixed values.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}


def _iban(edges: bool = True) -> str:
    """Country, two digits, and groups of four up to the country's length; without look-around if not ``edges``."""
    made = []
    for n, countries in IBAN_LENGTHS.items():
        whole, rest = divmod(n - 4, 4)
        made.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{whole}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    return f"(?<![A-Za-z0-9])(?:{'|'.join(made)})(?![A-Za-z0-9])" if edges else f"(?:{'|'.join(made)})"


#: In the order of the contract; those after the fourth are added by the method.
KINDS = (
    Kind(
        "email",
        "contains(t, '@')",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true",
        0.8,
        "mail|contact|write|adres|correo",
    ),
    Kind(
        "ip",
        "t rlike '[0-9][.][0-9]'",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
        "forall(split(m, '[.]'), p -> length(ltrim('0', p)) < 3 OR (length(ltrim('0', p)) = 3 AND ltrim('0', p) <= '255'))",
        0.6,
        "ip|address|host|server|login",
    ),
    Kind(
        "card",
        "t rlike '[0-9][ -]?[0-9]'",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
        _LUHN,
        0.7,
        "card|visa|credit|karte|tarjeta|carte",
    ),
    Kind(
        "phone",
        "contains(t, '+')",
        r"\+[0-9][ ().0-9-]+[0-9]",
        f"length({_DIGITS}) BETWEEN 10 AND 15",
        0.6,
        "tel|phone|call|mobil|fax",
    ),
    Kind(
        "iban",
        "t rlike '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'",
        _iban(),
        _MOD97,
        0.8,
        "iban|bank|account|konto|cuenta|compte",
        0.5,
    ),
    Kind(
        "ssn",
        "t rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        "true",
        0.3,
        "ssn|social|security|tax",
        0.5,
    ),
)
BASE = tuple(k.name for k in KINDS[:4])
SPAN = "struct<kind:string,start:long,end:long,score:double>"


#: Matches whose places are summed one after another.
BLOCK = 128
#: Code points of a piece of text, in `redact`.
PIECE = 1024


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _places(kind: Kind) -> str:
    """``struct<s,e,m,i>`` of each match: start, end, match, number. Reads the matches ``{name}_m`` and gaps ``{name}_g``."""
    m, g = f"{kind.name}_m", f"{kind.name}_g"
    found = "array<struct<s:long,e:long,m:string,i:int>>"
    one = f"""aggregate(slice({m}, b * {BLOCK} + 1, {BLOCK}), struct(0L AS at, int(b * {BLOCK}) AS i, cast(array() AS {found}) AS found),
        (a, x) -> struct(
            a.at + length({g}[a.i]) + length(x) AS at,
            a.i + 1 AS i,
            concat(a.found, array(struct(a.at + length({g}[a.i]) AS s, a.at + length({g}[a.i]) + length(x) AS e, x AS m, a.i AS i))) AS found))"""
    blocks = f"transform(sequence(0, (size({m}) - 1) div {BLOCK}), b -> {one})"
    moved = f"""aggregate({blocks}, struct(0L AS at, cast(array() AS array<{found}>) AS found),
        (a, x) -> struct(a.at + x.at AS at, concat(a.found, array(transform(x.found, y -> struct(y.s + a.at AS s, y.e + a.at AS e, y.m AS m, y.i AS i)))) AS found),
        a -> flatten(a.found))"""
    return f"IF(size({m}) > 0, {moved}, cast(array() AS {found}))"


def _scored(kind: Kind, reach: int) -> str:
    """The spans of the matches ``{name}_p`` that are valid."""
    g = f"{kind.name}_g"
    valid = kind.valid.replace("(m,", "(x.m,").replace("replace(m ", "replace(x.m ").replace("split(m,", "split(x.m,")
    near = f"lower(concat(right({g}[x.i], {reach}), ' ', left({g}[x.i + 1], {reach})))"
    score = f"least(1.0D, {kind.prior}D + IF({near} rlike '{kind.context}', 0.2D, 0.0D))"
    made = f"""transform(filter({kind.name}_p, x -> {valid}),
        x -> named_struct('kind', '{kind.name}', 'start', x.s, 'end', x.e, 'score', {score}))"""
    return f"filter({made}, y -> y.score >= {kind.least}D)" if kind.least else made


def _located(docs: DataFrame, id_col: str, text_col: str, reach: int) -> DataFrame:
    """``doc_id, t, spans``: the text, and its spans by start, then kind as listed."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    none = "cast(array() AS array<string>)"
    d = d.select("*", *[F.expr(f"IF({k.likely}, regexp_extract_all(t, {_quoted(k.pattern)}, 0), {none})").alias(f"{k.name}_m") for k in KINDS])
    d = d.select("*", *[F.expr(f"IF(size({k.name}_m) > 0, split(t, {_quoted(k.pattern)}, -1), {none})").alias(f"{k.name}_g") for k in KINDS])
    d = d.select("*", *[F.expr(_places(k)).alias(f"{k.name}_p") for k in KINDS])
    d = d.select("doc_id", "t", *[F.expr(_scored(k, reach)).alias(k.name) for k in KINDS])
    listed = F.array(*[F.lit(k.name) for k in KINDS])
    placed = F.transform(F.concat(*[F.col(k.name) for k in KINDS]), lambda s: F.struct(s["start"].alias("start"), F.array_position(listed, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))
    return d.select("doc_id", "t", F.array_sort(placed).alias("spans"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 40) -> DataFrame:
    """``doc_id`` and ``spans``: kind, start, end (code points, end exclusive) and score, by start, then kind as listed.

    Null and empty texts have no spans. One row for each row of ``docs``, repeated or with null ids; other
    columns are left out, so their names can't clash. Matches of different kinds may overlap; all are told.
    Scores are at most 1: a prior of the kind, and 0.2 more if a context word stands within ``reach``
    code points beside the match. Only kinds beyond the base ones have a least score.
    """
    return _located(docs, id_col, text_col, reach).select("doc_id", "spans")


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 40) -> DataFrame:
    """``doc_id, text`` with the spans of `find_pii` replaced by their kinds; for texts whose offsets nobody needs any more.

    Spans that overlap go as one, by the name of the first. Null and empty texts come out empty; repeated rows and null
    ids are kept, other columns left out. No rows give none.
    """
    d = _located(docs, id_col, text_col, reach)
    # Code points in pieces, so that what stands between two spans is cut from the pieces there and not from the whole text.
    d = d.withColumn("pieces", F.expr(f"IF(size(spans) > 0, regexp_extract_all(t, '(?s).{{1,{PIECE}}}', 0), cast(array() AS array<string>))"))
    # The end of all spans before each block of spans.
    ends = f"transform(sequence(0, (size(spans) - 1) div {BLOCK}), b -> array_max(transform(slice(spans, b * {BLOCK} + 1, {BLOCK}), s -> s.end)))"
    before = f"""aggregate({ends}, struct(0L AS at, cast(array() AS array<bigint>) AS found), (a, x) ->
        struct(greatest(a.at, x) AS at, concat(a.found, array(a.at)) AS found), a -> a.found)"""
    d = d.withColumn("before", F.expr(f"IF(size(spans) > 0, {before}, cast(array() AS array<bigint>))"))
    # Spans that begin where no earlier one goes on, and where the text before them begins.
    own = f"""aggregate(slice(spans, b * {BLOCK} + 1, {BLOCK}), struct(at AS at, cast(array() AS array<struct<after:bigint,start:bigint,kind:string>>) AS found), (a, s) -> struct(
        greatest(a.at, s.end) AS at,
        IF(s.start < a.at, a.found, concat(a.found, array(struct(a.at AS after, s.start AS start, s.kind AS kind)))) AS found), a -> a.found)"""
    d = d.withColumn("own", F.expr(f"flatten(transform(before, (at, b) -> {own}))"))
    cut = lambda a, b: f"substring(array_join(slice(pieces, int({a} div {PIECE}) + 1, int({b} div {PIECE} - {a} div {PIECE} + 1)), ''), int({a} % {PIECE}) + 1, int({b} - {a}))"
    d = d.withColumn("last", F.expr("coalesce(array_max(transform(spans, s -> s.end)), 0L)"))
    made = f"concat(array_join(transform(own, k -> concat({cut('k.after', 'k.start')}, '<', k.kind, '>')), ''), {cut('last', 'length(t)')})"
    return d.select("doc_id", F.expr(f"IF(size(spans) > 0, {made}, t)").alias("text"))
