r"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Everything is a column expression. A pattern's matches come from ``regexp_extract_all`` and
what lies between them from ``split`` on the same pattern; running lengths of both give the
places, in code points. Patterns are written so that none can back up over a long run
(possessive repeats, and a look behind where a match could start inside a run), hence they
take time in proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL_CHARS = "A-Za-z0-9._%+-"
#: kind -> pattern. The first four are the base; none of them may lose a span to the score.
BASE = {
    "email": rf"(?:(?<![{EMAIL_CHARS}])|\G)[{EMAIL_CHARS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
MORE = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A document without this cannot match: a cheap test before the pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score before context, then what a context word within NEAR characters adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": r"mail|contact|write|address",
    "ip": r"\bip\b|host|server|address|login",
    "card": r"card|visa|mastercard|amex|credit|debit|payment",
    "phone": r"phone|tel|call|mobile|fax|contact",
    "iban": r"iban|account|bank|transfer|swift|\bbic\b",
    "ssn": r"ssn|social security|taxpayer|national id",
}
NEAR, LIFT, LEAST = 40, 0.2, 0.55


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda x: x != "")


def luhn(s: Column) -> Column:
    """Of the digits in s: do they pass the Luhn check?"""
    d = F.transform(_chars(F.reverse(_digits(s))), lambda x: x.cast("int"))
    weighed = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x < 5, 2 * x).otherwise(2 * x - 9))
    return F.aggregate(weighed, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(s: Column) -> Column:
    """Does s, an IBAN with or without spaces, leave 1 when divided by 97?"""
    c = F.regexp_replace(s, " ", "")
    values = F.transform(_chars(F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))), lambda x: F.when(x < "A", F.ascii(x) - 48).otherwise(F.ascii(x) - 55))
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v < 10, a * 10 + v).otherwise(a * 100 + v) % 97) == 1


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")
    if kind == "card":
        return F.length(_digits(s)).between(16, 19) & luhn(s)
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(s, " ", "")).between(15, 34) & mod97(s)
    return F.lit(True)


SPAN = "struct<kind:string,start:int,stop:int,value:string,score:double>"
#: Matches are walked in runs of so many, so that a text with very many takes no square of steps.
RUN = 256


def _placed(kind: str, pattern: str, text: Column) -> Column:
    """array<struct<start, stop, value>> of the matches in text, before any check."""
    kinds = "array<struct<start:int,stop:int,value:string>>"
    empty = F.array().cast(kinds)
    steps = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda g, m: F.struct(F.coalesce(F.length(g), F.lit(0)).alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("m"), m.alias("v")),
    )

    def walk(run: Column) -> Column:
        return F.aggregate(
            run,
            F.struct(F.lit(0).alias("upto"), empty.alias("spans")),
            lambda a, x: F.struct(
                (a["upto"] + x["g"] + x["m"]).alias("upto"),
                F.when(x["v"].isNull(), a["spans"])
                .otherwise(F.concat(a["spans"], F.array(F.struct((a["upto"] + x["g"]).alias("start"), (a["upto"] + x["g"] + x["m"]).alias("stop"), x["v"].alias("value")))))
                .alias("spans"),
            ),
        )

    def runs(all_steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / RUN).cast("int")), lambda r: walk(F.slice(all_steps, r * RUN + 1, RUN)))

    def joined(walked: Column) -> Column:
        at = F.aggregate(walked, F.array(F.lit(0)), lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + r["upto"])))
        return F.flatten(
            F.zip_with(walked, at, lambda r, o: F.transform(F.coalesce(r["spans"], empty), lambda x: F.struct((x["start"] + o).alias("start"), (x["stop"] + o).alias("stop"), x["value"].alias("value"))))
        )

    # one-element arrays name an intermediate result once inside an expression
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    possible = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
    return F.when(possible & text.rlike(pattern), let(steps, lambda all_steps: let(runs(all_steps), joined))).otherwise(empty)


def _scored(kind: str, found: Column, text: Column) -> Column:
    def near(x: Column) -> Column:
        before = F.greatest(x["start"] - NEAR, F.lit(0))
        return F.lower(text.substr(before + 1, x["stop"] - before + NEAR)).rlike(CONTEXT[kind])

    checked = F.filter(found, lambda x: _valid(kind, x["value"]))
    return F.transform(
        checked,
        lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"), F.when(near(x), F.lit(round(PRIOR[kind] + LIFT, 2))).otherwise(F.lit(PRIOR[kind])).alias("score")),
    ).cast(f"array<{SPAN}>")


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and an array column for each kind (``pii_email``, ...): its spans by start, in code
    points, end exclusive, with value and score. Spans of the base kinds stay whatever their
    score; the further kinds need LEAST. A null text counts as an empty one: empty arrays.
    Equal rows get equal spans; columns of docs named like a result are replaced."""
    made = [f"pii_{k}" for k in (*BASE, *MORE)]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made or c.startswith("_at_")])
    t = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select("*", *[_placed(k, p, t).alias(f"_at_{k}") for k, p in (BASE | MORE).items()])
    spans = {k: _scored(k, F.col(f"_at_{k}"), t) for k in (*BASE, *MORE)}
    spans |= {k: F.filter(spans[k], lambda x: x["score"] >= LEAST) for k in MORE}
    return placed.select(*docs.columns, *[c.alias(f"pii_{k}") for k, c in spans.items()])


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its text replaced by the kind in angle brackets. Spans that
    overlap are masked together under the name of the first. A null text stays null."""
    found = with_spans(docs, text)
    every = F.array_sort(F.concat(*[F.transform(f"pii_{k}", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))) for k in (*BASE, *MORE)]))
    t = F.col(text)
    walked = F.aggregate(
        every,
        F.struct(F.lit(0).alias("upto"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["upto"], x["stop"]).alias("upto"),
            F.when(x["start"] < a["upto"], a["out"]).otherwise(F.concat(a["out"], t.substr(a["upto"] + 1, x["start"] - a["upto"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).alias("out"),
        ),
        lambda a: F.concat(a["out"], t.substr(a["upto"] + 1, F.length(t))),
    )
    none = F.lit(0)
    for k in (*BASE, *MORE):
        none = none + F.size(f"pii_{k}")
    return found.select(*[F.when(none > 0, walked).otherwise(t).alias(text) if c == text else F.col(c) for c in docs.columns])


def _listed(kinds) -> Column:
    """kind:start:end, comma-joined, by kind as listed, then by start."""
    return F.array_join(F.concat(*[F.transform(f"pii_{k}", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))) for k in kinds]), ",")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """All documents, null and empty texts, ties and repeats as ``with_spans`` treats them;
    score is the highest of a document's spans, 0 without any."""
    found = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    every = F.concat(*[F.transform(f"pii_{k}", lambda x: x["score"]) for k in (*BASE, *MORE)])
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(BASE), 256).alias("base_sha256"),
        _listed([*BASE, *MORE]).alias("spans"),
        F.round(F.coalesce(F.array_max(every), F.lit(0.0)), 2).alias("score"),
    )


def _oracle() -> str:
    """SQL for DuckDB from the patterns as the contract has them. Its expressions know no look
    behind or ahead: marks stand in for them, one before and one after each character that may
    stand beside a match, left out again where lengths are taken."""
    begin, end = "chr(983040)", "chr(983041)"
    marked = lambda beside: f"{begin} || regexp_replace(t, '({beside})', {end} || '\\1' || {begin}, 'g') || {end}"
    sep = f"' || {end} || ' ' || {begin} || '"
    found = {
        "email": ("t", "'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+'"),
        "ip": ("t", "'[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'"),
        "card": ("t", "'[0-9]([\\x20-]?[0-9])+'"),
        "phone": ("t", "'\\+[0-9][\\x20().0-9-]+[0-9]'"),
        "iban": (marked("[^A-Za-z0-9]"), f"{begin} || '[A-Z]{{2}}[0-9]{{2}}([A-Z0-9]{{11,30}}|({sep}[A-Z0-9]{{4}}){{2,7}}({sep}[0-9]{{1,3}})?)' || {end}"),
        "ssn": (marked("[^0-9-]"), f"{begin} || '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}' || {end}"),
    }
    raw = " UNION ALL ".join(f"SELECT k, '{kind}' AS kind, {o} AS o, string_split_regex({t}, {p}) AS g, regexp_extract_all({t}, {p}) AS m FROM texts" for o, (kind, (t, p)) in enumerate(found.items()))
    clean = lambda x: f"replace(replace({x}, {begin}, ''), {end}, '')"
    case = lambda of: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in of.items()) + " END"
    prior, context = case(PRIOR), case({k: f"'{v}'" for k, v in CONTEXT.items()})
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), raw AS ({raw}
), steps AS (
  SELECT k, kind, o, i, length({clean("g[i]")}) AS gap, {clean("m[i]")} AS v FROM raw, unnest(range(1, len(m) + 1)) AS u(i)
), placed AS (
  SELECT k, kind, o, v, CAST(sum(gap + length(v)) OVER (PARTITION BY k, kind ORDER BY i) AS BIGINT) AS stop, regexp_replace(v, '[^0-9]', '', 'g') AS d, replace(v, ' ', '') AS c FROM steps
), summed AS (
  SELECT *, list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(d)[i] AS INT) WHEN reverse(d)[i] < '5' THEN 2 * CAST(reverse(d)[i] AS INT) ELSE 2 * CAST(reverse(d)[i] AS INT) - 9 END)) AS luhn,
         list_transform(string_split(array_to_string(list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda x: CASE WHEN x BETWEEN 'A' AND 'Z' THEN CAST(ascii(x) - 55 AS VARCHAR) ELSE x END), ''), ''), lambda x: TRY_CAST(x AS INT)) AS values
  FROM placed
), valid AS (
  SELECT k, kind, o, v, stop - length(v) AS start, stop FROM summed
  WHERE CASE kind WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 3) AS INT) > 255)) = 0
                  WHEN 'card' THEN length(d) BETWEEN 16 AND 19 AND luhn % 10 = 0
                  WHEN 'phone' THEN length(d) BETWEEN 8 AND 15
                  WHEN 'iban' THEN length(c) BETWEEN 15 AND 34 AND list_reduce(list_concat([0], values), lambda a, x: (a * 10 + x) % 97) = 1
                  ELSE true END
), scored AS (
  SELECT v.*, doc_id, {prior} + CASE WHEN regexp_matches(lower(substr(t, greatest(start - {NEAR}, 0) + 1, stop - greatest(start - {NEAR}, 0) + {NEAR})), {context}) THEN {LIFT} ELSE 0 END AS score
  FROM valid v JOIN texts USING (k)
), told AS (
  SELECT k, {counts}, coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) FILTER (WHERE o < {len(BASE)}), '') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) AS spans, max(score) AS score
  FROM scored WHERE o < {len(BASE)} OR score >= {LEAST} GROUP BY k
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, round(CAST(coalesce(score, 0) AS DOUBLE), 2) AS score
FROM texts LEFT JOIN told USING (k)
"""


OP10_SQL = _oracle()
