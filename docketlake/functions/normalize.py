"""Normalizers for dirty filing columns, as pure Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Two-digit prefixes that belong to businesses. Anything else in
# nine digits may be a natural person's number and must not be published.
BUSINESS_ID_PREFIXES = (
    "01", "02", "03", "04", "05", "06", "10", "11", "12", "13", "14", "15", "16",
    "20", "21", "22", "23", "24", "25", "26", "27", "30", "31", "32", "33", "34",
    "35", "36", "37", "38", "39", "40", "41", "42", "43", "44", "45", "46", "47",
    "48", "50", "51", "52", "53", "54", "55", "56", "57", "58", "59", "60", "61",
    "62", "63", "64", "65", "66", "67", "68", "71", "72", "73", "74", "75", "76",
    "77", "80", "81", "82", "83", "84", "85", "86", "87", "88", "90", "91", "92",
    "93", "94", "95", "98", "99",
)
PERSONAL_ID_PREFIXES = ("09", "19", "89", "96", "97")
WAGE_LEVELS = ("I", "II", "III", "IV")
# Whitespace as browsers define it; NEL and the ASCII separators are not in it.
SEARCH_SPACE = (
    " \t\n\u000b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# White space in names: all of Unicode's, with the ASCII separators and NEL.
NAME_SPACE = (
    " \t-\r\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
SOC_PATTERN = "^[0-9]{2}-[0-9]{4}"
MAX_DEPTH = 10
# End of fixed values.


# --- codes, flags, levels, identifiers ---------------------------------------


def norm_soc(code: Column) -> Column:
    """Leading ``dd-dddd`` of a code, else NULL."""
    return F.regexp_substr(F.trim(code), F.lit(SOC_PATTERN))


def norm_bool(flag: Column) -> Column:
    """Yes/no in any spelling; everything else is unknown, never false."""
    word = F.lower(F.trim(flag))
    return F.when(word.isin("y", "yes"), F.lit(True)).when(word.isin("n", "no"), F.lit(False))


def norm_level(level: Column) -> Column:
    word = F.upper(F.trim(level))
    return F.when(word.isin(*WAGE_LEVELS), word)


def norm_ein(number: Column) -> Column:
    """Nine digits with a business prefix, else NULL."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    # Prefix and length in one test: both are always asked for, so the digits are extracted once.
    shape = F.concat_ws("/", F.substring(digits, 1, 2), F.length(digits).cast("string"))
    return F.when(shape.isin(*[f"{prefix}/9" for prefix in BUSINESS_ID_PREFIXES]), digits)


def norm_name(name: Column) -> Column:
    """The spelling two filings of one entity must share.

    Printable ASCII with no two spaces in a row has nothing to replace, which one cheap class tells.
    """
    low = F.lower(name)
    clean = ~low.rlike("[^ -~]") & ~F.contains(low, F.lit("  "))
    squashed = F.when(clean, low).otherwise(F.regexp_replace(low, f"[{NAME_SPACE}]+", " "))
    return F.nullif(F.trim(squashed), F.lit(""))


def entity_key(own_id: Column, mapped_id: Column, name: Column) -> Column:
    """Own identifier, else the one the name maps to, else an opaque hash of the
    normalized name (never the name itself)."""
    hashed = F.concat(F.lit("n-"), F.substring(F.md5(name), 1, 16))
    return F.coalesce(own_id, mapped_id, hashed)


def backfill_id(own_id: Column, key: Column) -> Column:
    """A key of nine digits *is* the identifier."""
    return F.coalesce(own_id, F.when(key.rlike("^[0-9]{9}$"), key))


# --- dates, text, wages ------------------------------------------------------


def effective_date(decided: Column, received: Column) -> Column:
    return F.coalesce(decided, received)


def effective_year(decided: Column, received: Column) -> Column:
    return F.year(effective_date(decided, received)).cast("short")


def tidy(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def tidy_upper(text: Column) -> Column:
    return F.nullif(F.upper(F.trim(text)), F.lit(""))


def zip5(code: Column) -> Column:
    return F.regexp_substr(code, F.lit("^[0-9]{5}"))


def annual(value: Column, unit: Column) -> Column:
    """The value where it is quoted per year, else NULL."""
    return F.when(unit == "Year", value)


def wage_middle(low: Column, top: Column) -> Column:
    """The middle of a range; NULL if an end of it is."""
    return ((low + top) * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(20,5)")


def wage_range(low: Column, high: Column, unit: Column) -> tuple[Column, Column, Column]:
    """(from, to, mid) of an annual offer; an open range ends where it starts."""
    top = F.coalesce(high, low)
    return annual(low, unit), annual(top, unit), annual(wage_middle(low, top), unit)


def approved_pwd(status: Column) -> Column:
    return status != "Withdrawn"


def approved_perm(status: Column) -> Column:
    return status.like("Certified%")


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole as an exact decimal; NULL over zero."""
    return part.cast("decimal(20,0)") / F.nullif(whole.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))


def label_level(level: Column, default: str = "unknown") -> Column:
    return F.coalesce(level, F.lit(default))


# --- search terms ------------------------------------------------------------


def _squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), f"[{SEARCH_SPACE}]+", " "))


def search_norm(text: Column) -> Column:
    """Squash white space and strip, *then* drop what is not ``[a-z0-9 ]``.

    The order makes the result non-idempotent on purpose: a dropped ``&`` leaves
    two spaces, which the deeper index tiers keep.
    """
    return F.regexp_replace(_squash(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", "")


def base_prefixes(text: Column) -> Column:
    """The two- and three-character prefixes of the cleaned text."""
    clean = search_norm(text)
    both = F.array(*[F.substring(clean, 1, d) for d in (2, 3)])
    return F.slice(both, F.lit(1), F.greatest(F.least(F.length(clean), F.lit(3)) - 1, F.lit(0)))


def search_prefix(query: Column, max_depth: int = MAX_DEPTH) -> Column:
    """A query as the index spells it; NULL when fewer than two characters remain."""
    clean = search_norm(query)
    return F.when(F.length(clean) >= 2, F.substring(clean, 1, max_depth))


def search_candidates(prefix: Column, max_depth: int = MAX_DEPTH) -> Column:
    """At most five prefixes to try, longest first."""
    longest = F.least(F.length(prefix), F.lit(max_depth))
    depths = F.array(longest, longest - 1, longest - 2, F.lit(3), F.lit(2))
    usable = F.filter(depths, lambda d: (d >= 2) & (d <= F.length(prefix)))
    ordered = F.sort_array(F.array_distinct(usable), asc=False)
    return F.transform(ordered, lambda d: F.substr(prefix, F.lit(1), d))


# --- requests and callers ----------------------------------------------------


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SEARCH_SPACE}]+|[{SEARCH_SPACE}]+$", "")


def parse_entity_key(raw: Column) -> Column:
    """An ``n-`` key as given, or nine digits in any punctuation, else NULL."""
    text = strip_space(raw)
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(text.rlike("^n-[a-z0-9-]{1,64}$"), text).when(F.length(digits) == 9, digits)


def parse_soc(raw: Column) -> Column:
    text = strip_space(raw)
    return F.when(text.rlike("^[0-9]{2}-[0-9]{4}$"), text)


def parse_level(raw: Column) -> Column:
    text = F.upper(strip_space(raw))
    return F.when(text.isin(*WAGE_LEVELS, "NA"), text)


def bucket_ip(ip: Column) -> Column:
    """IPv4 whole; IPv6 cut to its first four groups, ``::`` expanded."""
    head = F.split(ip, "%", -1)[0]
    halves = F.split(head, "::", -1)
    none = F.array().cast("array<string>")

    def groups(half: Column) -> Column:
        return F.when(F.coalesce(half, F.lit("")) == "", none).otherwise(F.split(half, ":", -1))

    left, right = groups(F.get(halves, 0)), groups(F.get(halves, 1))
    missing = F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right))
    expanded = F.concat(left, F.array_repeat(F.lit("0"), missing), right)
    whole = F.when(F.size(halves) > 1, expanded).otherwise(F.split(head, ":", -1))
    first = F.transform(F.slice(whole, 1, 4), lambda g: F.when(g == "", "0").otherwise(g))
    network = F.concat(F.lower(F.array_join(first, ":")), F.lit("::/64"))
    return F.when(F.contains(ip, F.lit(":")), network).otherwise(ip)


def caller_key(token: Column, ip: Column, asn: Column) -> Column:
    """Keyed callers share one bucket per token, everyone else one per network."""
    address = bucket_ip(F.coalesce(ip, F.lit("0.0.0.0")))
    anonymous = F.concat_ws("|", F.lit("anon"), address, F.coalesce(asn.cast("string"), F.lit("0")))
    keyed = F.concat_ws("|", F.lit("keyed"), F.sha2(token, 256))
    return F.when(F.coalesce(token, F.lit("")) != "", keyed).otherwise(anonymous)


# --- the same six for SQL users ----------------------------------------------


def _quoted(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the identity and normalizer functions as temporary SQL functions.

    Catalyst inlines them, so a query using them plans like the Column form.
    """
    bodies = {
        "norm_soc(t STRING)": ("STRING", f"regexp_substr(trim(t), '{SOC_PATTERN}')"),
        "norm_bool(t STRING)": (
            "BOOLEAN",
            "CASE WHEN lower(trim(t)) IN ('y', 'yes') THEN true "
            "WHEN lower(trim(t)) IN ('n', 'no') THEN false END",
        ),
        "norm_level(t STRING)": (
            "STRING",
            f"CASE WHEN upper(trim(t)) IN ({_quoted(WAGE_LEVELS)}) THEN upper(trim(t)) END",
        ),
        "norm_ein(t STRING)": (
            "STRING",
            "CASE WHEN length(regexp_replace(t, '[^0-9]', '')) = 9 "
            "AND substr(regexp_replace(t, '[^0-9]', ''), 1, 2) IN "
            f"({_quoted(BUSINESS_ID_PREFIXES)}) THEN regexp_replace(t, '[^0-9]', '') END",
        ),
        "norm_name(t STRING)": (
            "STRING", f"nullif(trim(regexp_replace(lower(t), '[{NAME_SPACE}]+', ' ')), '')",
        ),
        "emp_key(own STRING, mapped STRING, nm STRING)": (
            "STRING", "coalesce(own, mapped, concat('n-', substr(md5(nm), 1, 16)))",
        ),
    }
    for signature, (returns, body) in bodies.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}"
        )
    return [s.split("(")[0] for s in bodies]
