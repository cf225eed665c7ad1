r"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is a DataFrame expression. The proposing patterns are written so that the matcher neither backtracks nor
recurses on long runs; their matches equal those of the plain patterns

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``, parts at most 255
* card ``[0-9]([\x20-]?[0-9])+``, 13 to 19 digits, Luhn
* phone ``\+[0-9][\x20().0-9-]+[0-9]``, 9 to 15 digits

These four are the base kinds: what their check confirms stays, whatever its score. The method adds ``iban`` (two
capitals, two digits, and as many capitals or digits as the country's IBANs have, 11 to 30 where it is not listed; mod 97 gives 1) and ``ssn`` (``ddd-dd-dddd``), which need
a score of ``KEEP`` or more: an IBAN has it by its checksum, an SSN needs a context word.

Edge cases: a null text counts as empty; an empty text has no spans and the digest of the empty string; repeated
rows give repeated rows; a null ``doc_id`` is passed on; offsets are code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_of

#: Code points before a span in which context words count.
CONTEXT = 40
KEEP = 0.5
BOOST = 0.3

#: Characters of an IBAN after country and check digits, by country; the match ends where the IBAN ends.
IBAN_REST = {
    11: "NO", 12: "BE", 14: "DK FI FK FO GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK", 17: "CH HR LI LV", 18: "BG BH CR DE GB GE IE ME RS VA",
    19: "AE GI IL IQ OM SO TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "AO CV GW LY MZ PT ST", 22: "DZ IR IS TR", 23: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    24: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 25: "BR EG PS QA UA", 26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU",
}
_LISTED = "|".join(sorted(" ".join(IBAN_REST.values()).split()))
#: Countries that are not listed keep the longest match.
_IBAN = "|".join(
    [rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}" for n, c in IBAN_REST.items()] + [rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"]
)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    turned = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), lambda s, i: F.coalesce(add(s, i), s)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97, its first four characters moved to the end."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c < 58, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    base: bool
    score: float
    context: str
    has: str

    def valid(self, match: Column) -> Column:
        if self.name == "ip":
            return ~F.exists(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) > 3) | (F.coalesce(p.try_cast("int"), F.lit(256)) > 255))
        if self.name == "card":
            return luhn(digits(match))
        if self.name == "phone":
            return F.length(digits(match)).between(9, 15)
        if self.name == "iban":
            return mod97(F.replace(match, F.lit(" "), F.lit("")))
        return F.lit(True)


#: In the order in which spans are listed.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, 0.7, "mail|contact|write", "@"),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}", True, 0.6, "ip|server|host|address|addr", "[0-9]"),
    Kind("card", r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", True, 0.6, "card|visa|credit|payment|pay", "[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, 0.6, "phone|call|tel|fax|mobile", r"\+[0-9]"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])", False, 0.6, "iban|account|bank", "[A-Z]{2}[0-9]{2}"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False, 0.3, "ssn|social security", "[0-9]-[0-9]"),
)


def proposed(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the non-overlapping matches, leftmost first, in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    span = "struct<start:int,stop:int,match:string>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def add(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece["gap"])
        stop = start + F.length(piece["match"])
        one = F.struct(start.alias("start"), stop.alias("stop"), piece["match"].alias("match"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    return F.aggregate(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), empty, add, lambda acc: acc["spans"])


def spans_of(text: Column, kind: Kind) -> Column:
    """Array of (kind, base, start, stop, score) of one kind, confirmed and scored."""

    def scored(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT, F.lit(0))
        before = F.lower(F.substring(text, first + 1, s["start"] - first))
        near = before.rlike(rf"(?:^|[^a-z])(?:{kind.context})")
        score = F.when(near, F.lit(round(kind.score + BOOST, 2))).otherwise(F.lit(kind.score))
        return F.struct(F.lit(kind.name).alias("kind"), F.lit(kind.base).alias("base"), s["start"].alias("start"), s["stop"].alias("stop"), score.alias("score"))

    found = F.transform(F.filter(proposed(text, kind.pattern), lambda s: kind.valid(s["match"])), scored)
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= KEEP)
    nothing = F.array().cast("array<struct<kind:string,base:boolean,start:int,stop:int,score:double>>")
    return F.when(text.rlike(kind.has), found).otherwise(nothing)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column ``pii``: all spans (kind, base, start, stop, score), by kind as listed and start."""
    whole = text_of(text)
    return docs.withColumn("pii", F.concat(*[spans_of(whole, k) for k in KINDS]))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; where spans overlap, the first counts."""
    rows = docs.withColumn(text, text_of(text))
    spans = free_name(rows, "spans")
    found = rows.withColumn(spans, F.concat(*[spans_of(F.col(text), k) for k in KINDS]))
    body = F.col(text)
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["stop"].alias("at"), kept.alias("out")))

    done = F.aggregate(order, start, add, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    return found.withColumn(text, done).drop(spans)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests per document, from :func:`find_pii`."""
    found = find_pii(docs.select("doc_id", F.col("text")))
    base = F.filter("pii", lambda s: s["base"])

    def count(name: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    counts = [count(k.name) for k in KINDS if k.base]
    scores = F.array_join(F.transform("pii", lambda s: F.format_string("%.1f", s["score"])), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), scores.alias("scores"))


def oracle() -> str:
    """The same rows in DuckDB SQL, with the plain patterns."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    luhn_sql = (
        "list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(n), i, 1)::INT "
        "WHEN substr(reverse(n), i, 1)::INT > 4 THEN substr(reverse(n), i, 1)::INT * 2 - 9 ELSE substr(reverse(n), i, 1)::INT * 2 END)) % 10 = 0"
    )
    valid = {
        "email": "true",
        "ip": r"len(list_filter(string_split(m, '.'), lambda p: coalesce(TRY_CAST(p AS HUGEINT), 256) > 255)) = 0",
        "card": f"length(n) BETWEEN 13 AND 19 AND {luhn_sql}",
        "phone": "length(n) BETWEEN 9 AND 15",
        "iban": "false",
        "ssn": "regexp_matches(before, '(?:^|[^a-z])(?:ssn|social security)')",
    }
    parts = []
    for i, k in enumerate(KINDS):
        rx = plain[k.name]
        parts.append(
            f"""
  SELECT doc_id, {i} AS k, '{k.name}' AS kind, {str(k.base).lower()} AS base, m, n, s, s + length(m) AS e,
         CASE WHEN regexp_matches(before, '(?:^|[^a-z])(?:{k.context})') THEN {k.score + BOOST:.1f} ELSE {k.score:.1f} END AS score
  FROM (SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS n, s, lower(substr(t, greatest(s - {CONTEXT}, 0) + 1, s - greatest(s - {CONTEXT}, 0))) AS before
        FROM (SELECT doc_id, t, ms[i] AS m, (list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::BIGINT AS s
              FROM (SELECT doc_id, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i
                    FROM (SELECT doc_id, t, regexp_extract_all(t, '{rx}') AS ms, string_split_regex(t, '{rx}') AS gs FROM d))))
  WHERE {valid[k.name]}"""
        )
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ("
        + "\n  UNION ALL".join(parts)
        + """
), told AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
         count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (base) AS base_spans,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans, string_agg(printf('%.1f', score), ',' ORDER BY k, s) AS scores
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN told ON d.doc_id = told.doc_id
"""
    )
