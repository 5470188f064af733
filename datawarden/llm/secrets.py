"""Secret scans, with Spark expressions only.

Two kinds of findings, as spans of code points, end exclusive:

- assignments, access keys and hex strings, found by their patterns;
- strings that look random. Candidates are runs of token characters, cut into runs of each character
  class. A window slides along a run; the counts of its characters are kept up as one character
  enters and one leaves, and with them the sum of c * log2(c), from which the window's Shannon
  entropy follows. The union of overlapping windows above the class's threshold is a span, unless
  an allow-list knows the run, or the span lies within a finding of the first kind.

Sums are whole numbers (micro-bits), so that long runs do not drift. Every row stands for itself:
nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datawarden.llm.common import narrow

#: Kinds, patterns and least lengths of the base. A run of one class is matched whole
#: from its first character, so its least length can stand in the pattern.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 6
VALUE = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")

WINDOW = 20
TOKEN = r"[A-Za-z0-9+/_=-]"


@dataclass(frozen=True)
class CharacterClass:
    """Runs of `chars` that match all of `needs` are scanned for windows of at least `bits`."""

    kind: str
    chars: str
    needs: tuple[str, ...]
    bits: float


CLASSES = (
    CharacterClass("entropy-hex", "[0-9A-Fa-f]", ("[0-9]", "[A-Fa-f]"), 3.05),
    CharacterClass("entropy-lower36", "[0-9a-z]", ("[0-9]", "[a-z]"), 3.45),
    CharacterClass("entropy-upper36", "[0-9A-Z]", ("[0-9]", "[A-Z]"), 3.45),
    CharacterClass("entropy-base64", TOKEN, ("[0-9]", "[a-z]", "[A-Z]"), 3.65),
)

#: Runs that match one of these are no secrets: words and numbers joined by signs (paths, slugs,
#: constants), UUIDs, spelled-out alphabets, placeholders, digests of the empty text.
ALLOW = (
    r"^([A-Za-z]+|[0-9]+)?([+/_=-]+([A-Za-z]+|[0-9]+)?)*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(0123456789|1234567890|[Aa][Bb][Cc][Dd][Ee][Ff][Gg])",
    r"([Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]|[Xx]{6})",
    r"^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709)$",
)

_FIRST, _CODES = ord("+"), ord("z") - ord("+") + 1
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_PART = 256


def micro_bits(window: int) -> list[int]:
    """c * log2(c) for c up to the window's length, in millionths."""
    return [0] + [round(c * math.log2(c) * 1_000_000) for c in range(1, window + 1)]


def most_micro_bits(window: int, bits: float) -> int:
    """The largest sum of c * log2(c) over a window with at least that entropy."""
    return math.floor(window * (math.log2(window) - bits) * 1_000_000)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda total, n: total + n)


def _running(lengths: Column) -> Column:
    """Sums before each element. Parts of fixed length have their own sums, so that the work for
    many elements does not grow with their square."""
    last = F.floor((F.size(lengths) - 1) / _PART).cast("int")
    sums = F.transform(F.sequence(F.lit(0), last), lambda b: _total(F.slice(lengths, b * _PART + 1, F.lit(_PART))))
    heads = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def before(known: Column) -> Column:
        return F.transform(
            lengths,
            lambda _, i: F.get(known, F.floor(i / _PART).cast("int"))
            + _total(F.slice(lengths, F.floor(i / _PART).cast("int") * _PART + 1, i % _PART)),
        )

    return F.when(F.size(lengths) > 0, _let(heads, before)).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, pattern: str, make: Callable[[Column, Column], Column], kind: str) -> Column:
    """An array of `make(start, match)` over the leftmost matches that do not overlap; `kind` is its
    type. Their starts are the lengths of all that lies before them."""

    def located(found: Column) -> Column:
        def placed(pieces: Column) -> Column:
            gaps = F.transform(found, lambda _, i: F.length(F.get(pieces, i)))
            steps = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
            starts = F.zip_with(_let(steps, _running), gaps, lambda before, gap: before + gap)
            return F.zip_with(starts, found, make)

        return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), placed)).otherwise(F.array().cast(kind))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))


def _whole(kind: int) -> Callable[[Column, Column], Column]:
    return lambda start, match: _span(start, kind, start + F.length(match))


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """Spans (start, kind, end) of assignments, access keys and hex strings."""
    long_enough = lambda match: F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_CHARS
    with_value = _matches(
        text,
        ASSIGN,
        lambda start, match: F.struct(_whole(0)(start, match).alias("span"), long_enough(match).alias("counts")),
        "array<struct<span:struct<start:int,kind:int,end:int>,counts:boolean>>",
    )
    # no assignment has a value of that length elsewhere, and most texts hold none
    found = F.when(F.rlike(text, F.lit(VALUE)), with_value)
    assign = F.transform(F.filter(found, lambda x: x["counts"]), lambda x: x["span"])
    return F.coalesce(assign, F.array().cast(_SPAN)), _matches(text, ACCESS, _whole(1), _SPAN), _matches(text, HEX, _whole(2), _SPAN)


def _random_windows(run: Column, start: Column, kind: int, window: int, bits: float) -> Column:
    """Spans of the windows of a run whose entropy is high enough, joined where they overlap."""
    table = F.array(*(F.lit(v).cast("long") for v in micro_bits(window)))
    limit = F.lit(most_micro_bits(window, bits))

    def slide(codes: Column) -> Column:
        none = F.lit(-1)

        def step(state: Column, i: Column) -> Column:
            enters = F.get(codes, i)
            leaves = F.when(i >= window, F.get(codes, i - window)).otherwise(none)

            def counted(out: Column) -> Column:
                same = F.when(enters == leaves, 1).otherwise(0)
                held = F.get(state["counts"], enters) - same
                gained = F.get(table, held + 1) - F.get(table, held)
                lost = F.when(leaves >= 0, F.get(table, out) - F.get(table, out - 1)).otherwise(F.lit(0).cast("long"))
                return state["sum"] - lost + gained

            total = _let(F.coalesce(F.get(state["counts"], F.greatest(leaves, F.lit(0))), F.lit(0)), counted)

            def advanced(now: Column) -> Column:
                counts = F.transform(
                    state["counts"],
                    lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0),
                )
                first, end = start + i + 1 - window, start + i + 1
                joins = F.coalesce(F.element_at(state["ends"], -1) >= first, F.lit(False))
                opened = F.when(joins, state["starts"]).otherwise(F.concat(state["starts"], F.array(first)))
                kept = F.when(joins, F.slice(state["ends"], F.lit(1), F.size(state["ends"]) - 1)).otherwise(state["ends"])
                hit = (i + 1 >= window) & (now <= limit)
                return F.struct(
                    counts.alias("counts"),
                    now.alias("sum"),
                    F.when(hit, opened).otherwise(state["starts"]).alias("starts"),
                    F.when(hit, F.concat(kept, F.array(end))).otherwise(state["ends"]).alias("ends"),
                )

            return _let(total, advanced)

        empty = F.struct(
            F.array_repeat(F.lit(0), _CODES).alias("counts"),
            F.lit(0).cast("long").alias("sum"),
            F.array(F.lit(0)).alias("starts"),
            F.array(F.lit(-1)).alias("ends"),  # a span before all others, for `element_at`
        )
        places = F.sequence(F.lit(0), F.size(codes) - 1)
        return F.aggregate(
            places,
            empty,
            step,
            lambda s: F.slice(F.zip_with(s["starts"], s["ends"], lambda a, b: _span(a, kind, b)), F.lit(2), F.size(s["starts"])),
        )

    return _let(F.transform(F.split(run, ""), lambda c: F.ascii(c) - _FIRST), slide)


def random_spans(
    text: Column,
    classes: Sequence[CharacterClass] = CLASSES,
    allow: Sequence[str] = ALLOW,
    window: int = WINDOW,
    kind: int = len(BASE),
) -> Column:
    """Spans of strings that look random; `kind` numbers the first class."""
    longest = f"(?<!{TOKEN}){TOKEN}{{{window},}}+"

    def allowed(run: Column) -> Column:
        known = F.lit(False)
        for pattern in allow:
            known = known | F.rlike(run, F.lit(pattern))
        return known

    def of_class(k: int, c: CharacterClass) -> Callable[[Column, Column], Column]:
        def scan(start: Column, candidate: Column) -> Column:
            def of_run(at: Column, run: Column) -> Column:
                wanted = ~allowed(run)
                for need in c.needs:
                    wanted = wanted & F.rlike(run, F.lit(need))
                return F.when(wanted, _random_windows(run, start + at, kind + k, window, c.bits)).otherwise(
                    F.array().cast(_SPAN)
                )

            return F.flatten(_matches(candidate, f"{c.chars}{{{window},}}", of_run, f"array<{_SPAN}>"))

        return scan

    def scanned(start: Column, candidate: Column) -> Column:
        found = F.concat(*(of_class(k, c)(start, candidate) for k, c in enumerate(classes)))
        return F.when(allowed(candidate), F.array().cast(_SPAN)).otherwise(found)

    return F.flatten(_matches(text, longest, scanned, f"array<{_SPAN}>"))


def secrets(
    docs: DataFrame,
    classes: Sequence[CharacterClass] = CLASSES,
    allow: Sequence[str] = ALLOW,
    window: int = WINDOW,
) -> DataFrame:
    """(doc_id, assign, access, hex, random) for each row of `docs` (doc_id, text): arrays of spans
    (start, kind, end), kinds numbered as in BASE and then `classes`.

    The span of an assignment is its whole match. Base spans may overlap those of other kinds; no
    random span lies within one. A null text is empty and has none; repeated rows repeat; rows without
    doc_id are scanned like others; an empty table gives no rows. Other columns are ignored.
    """
    rows = narrow(docs, doc_id="long", text="string")
    text = F.coalesce("text", F.lit(""))
    assign, access, hexes = base_spans(text)
    found = rows.select(
        "doc_id", assign.alias("assign"), access.alias("access"), hexes.alias("hex"),
        random_spans(text, classes, allow, window).alias("found"),
    )
    base = F.concat("assign", "access", "hex")
    apart = F.filter("found", lambda x: ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))
    return found.select("doc_id", "assign", "access", "hex", apart.alias("random"))


def spelled(spans: Column, kinds: Sequence[str]) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in kinds))
    listed = F.transform(
        F.sort_array(spans),
        lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")),
    )
    return F.array_join(listed, ",")


KINDS = (*BASE, *(c.kind for c in CLASSES))


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *(F.size(c).cast("long").alias(f"n_{c}") for c in BASE),
        F.sha2(spelled(base, KINDS), 256).alias("base_sha256"),
        spelled(F.concat(base, "random"), KINDS).alias("spans"),
    )


def _sql() -> str:
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"

    def located(source: str, text: str, pattern: str, keys: str, group: str = "") -> str:
        """Matches of a pattern in each row of `source`, with their starts."""
        p = quoted(pattern)
        more = f", unnest(regexp_extract_all({text}, {p}, 2)) AS value" if group else ""
        return f"""
  SELECT {keys}, match{", value" if group else ""}, (sum(length(gap) + length(match)) OVER (PARTITION BY {keys} ORDER BY i) - length(match))::BIGINT AS start FROM (
    SELECT {keys}, unnest(regexp_extract_all({text}, {p}, 0)) AS match{more},
      unnest(regexp_split_to_array({text}, {p})[:-2]) AS gap, unnest(range(len(regexp_extract_all({text}, {p}, 0)))) AS i
    FROM {source} WHERE regexp_matches({text}, {p}))"""

    plain = ASSIGN.replace("(?i:(password|passwd|secret|token|api_?key))", "(" + "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")
    ) + ")")
    known = lambda run: " OR ".join(f"regexp_matches({run}, {quoted(p)})" for p in ALLOW)
    table = "[" + ", ".join(str(v) for v in micro_bits(WINDOW)) + "]"
    runs = " UNION ALL ".join(
        f"SELECT row, {len(BASE) + k} AS kind, begin + start AS begin, match AS run, {most_micro_bits(WINDOW, c.bits)} AS most FROM ("
        + located("candidates", "candidate", f"{c.chars}{{{WINDOW},}}", "row, begin, candidate")
        + ") WHERE "
        + " AND ".join(f"regexp_matches(match, {quoted(n)})" for n in c.needs)
        + f" AND NOT ({known("match")})"
        for k, c in enumerate(CLASSES)
    )
    names = "[" + ", ".join(quoted(k) for k in KINDS) + "]"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT row, 0 AS kind, start, start + length(match) AS stop FROM ({located("docs", "text", plain, "row", "value")}) WHERE length(value) >= {ASSIGN_CHARS}
  UNION ALL SELECT row, 1, start, start + length(match) FROM ({located("docs", "text", ACCESS, "row")})
  UNION ALL SELECT row, 2, start, start + length(match) FROM ({located("docs", "text", HEX, "row")})
), candidates AS (
  SELECT row, start AS begin, match AS candidate FROM ({located("docs", "text", f"{TOKEN}{{{WINDOW},}}", "row")})
  WHERE NOT ({known("match")})
), runs AS ({runs}),
windows AS (SELECT row, kind, begin, most, unnest(range(length(run) - {WINDOW - 1})) AS place, run FROM runs),
letters AS (SELECT row, kind, begin, most, place, unnest(string_split(run[place + 1:place + {WINDOW}], '')) AS letter FROM windows),
counted AS (SELECT row, kind, begin, most, place, letter, count(*) AS c FROM letters GROUP BY ALL),
hits AS (
  SELECT row, kind, begin, begin + place AS start, begin + place + {WINDOW} AS stop FROM counted
  GROUP BY row, kind, begin, most, place HAVING sum({table}[c + 1]) <= most
), opened AS (
  SELECT *, CASE WHEN lag(stop) OVER (PARTITION BY row, kind, begin ORDER BY start) >= start THEN 0 ELSE 1 END AS opens FROM hits
), grouped AS (SELECT *, sum(opens) OVER (PARTITION BY row, kind, begin ORDER BY start) AS span FROM opened),
random AS (SELECT row, kind, min(start) AS start, max(stop) AS stop FROM grouped GROUP BY row, kind, begin, span),
spans AS (
  SELECT *, true AS is_base FROM base UNION ALL
  SELECT *, false FROM random r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = r.row AND b.start <= r.start AND r.stop <= b.stop)
), texts AS (SELECT *, {names}[kind + 1] || ':' || start || ':' || stop AS shown FROM spans),
found AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(shown, ',' ORDER BY start, kind, stop) FILTER (is_base) AS base, string_agg(shown, ',' ORDER BY start, kind, stop) AS spans
  FROM texts GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (row)
"""


SQL = _sql()
