"""Vectors for every normalizer; SQL functions must agree with the Column form."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from docketlake.functions import normalize as nz
from docketlake.functions.aggregates import counts_to_map


def applied(spark, fn, raws, dtype="string"):
    df = spark.createDataFrame(list(enumerate(raws)), f"i int, raw {dtype}")
    return [r["v"] for r in df.select("i", fn(F.col("raw")).alias("v")).orderBy("i").collect()]


def check(spark, fn, vectors):
    raws, wants = zip(*vectors)
    assert applied(spark, fn, raws) == list(wants)


def test_codes_flags_levels(spark):
    check(spark, nz.norm_soc, [
        ("15-1252", "15-1252"), ("15-1252.00", "15-1252"), (" 15-1252 - Title", "15-1252"),
        ("2015-06-01 00:00:00", None), ("999999", None), ("", None), (None, None),
        ("\t15-1252", None),
    ])
    check(spark, nz.norm_bool, [
        ("Yes", True), (" y ", True), ("N", False), ("no", False), ("N/A", None), ("", None),
        (None, None),
    ])
    check(spark, nz.norm_level, [
        ("I", "I"), (" ii ", "II"), ("iii", "III"), ("IV", "IV"), ("V", None), ("N/A", None),
        (None, None),
    ])
    check(spark, nz.zip5, [("94043-1234", "94043"), ("9404", None), ("x94043", None), (None, None)])
    check(spark, nz.tidy_upper, [(" Kings ", "KINGS"), ("  ", None), (None, None)])


def test_identifiers(spark):
    check(spark, nz.norm_ein, [
        ("52-0447183", "520447183"), ("520447183", "520447183"), ("12345678", None),
        ("961234567", None), ("971234567", None), ("091234567", None), ("191234567", None),
        ("891234567", None), ("001234567", None), (None, None),
    ])
    assert len(nz.BUSINESS_ID_PREFIXES) == 83
    assert not set(nz.BUSINESS_ID_PREFIXES) & set(nz.PERSONAL_ID_PREFIXES)
    check(spark, nz.norm_name, [
        ("  Acme\t Corp ", "acme corp"), ("ACME  CORP", "acme corp"), ("   ", None), ("", None),
        (None, None), ("A\u2003B", "a b"), ("A\u0085\u001c B\u3000", "a b"),
    ])
    none = F.lit(None).cast("string")
    check(spark, lambda c: nz.entity_key(none, none, c), [
        ("acme", "n-" + __import__("hashlib").md5(b"acme").hexdigest()[:16]),
    ])
    check(spark, lambda c: nz.backfill_id(none, c), [("520447183", "520447183"), ("n-1", None)])


def test_sql_functions_agree(spark):
    names = nz.register_sql_functions(spark)
    assert names == ["norm_soc", "norm_bool", "norm_level", "norm_ein", "norm_name", "emp_key"]
    raws = ["15-1252.00", "Yes", " ii ", "52-0447183", "  Acme\t\u2003Corp ", "961234567", "", None]
    df = spark.createDataFrame([(r,) for r in raws], "t string")
    pairs = {n: getattr(nz, n)(F.col("t")) for n in names[:-1]}
    for name, column in pairs.items():
        got = df.select(F.expr(f"{name}(t)").alias("sql"), column.alias("col")).collect()
        assert [r["sql"] for r in got] == [r["col"] for r in got], name
    keyed = df.select(F.expr("emp_key(NULL, NULL, norm_name(t))").alias("k")).collect()
    assert keyed[4]["k"].startswith("n-") and len(keyed[4]["k"]) == 18


NAMES = [
    ("Blue Heron Labs", "blue heron labs"), ("\t Moss  &  Fern\n", "moss  fern"), ("Jürgens KG", "jrgens kg"),
    ("7 Hills Dairy", "7 hills dairy"), ("Q&R", "qr"), ("D'Arcy Mills", "darcy mills"), ("K\u00a0L", "k l"),
    ("K\u0085L", "kl"), ("K\u001cL", "kl"), ("\ufefftin roof", "tin roof"), ("tin roof\ufeff", "tin roof"), ("", ""),
    (None, ""), ("---", ""),
]


def test_search_terms(spark):
    check(spark, nz.search_norm, NAMES)
    check(spark, nz.search_prefix, [
        ("Blue Heron Labs", "blue heron"), ("\t Moss  &  Fern\n", "moss  fern"), ("OK", "ok"), ("?", None),
        ("üö", None), ("qrstuvwxyz12", "qrstuvwxyz"), ("K\u0085L", "kl"), (None, None),
    ])
    check(spark, nz.base_prefixes, [
        ("Heron", ["he", "her"]), ("OK", ["ok"]), ("?", []), (" kl mn", ["kl", "kl "]),
    ])
    check(spark, nz.search_candidates, [
        ("herons", ["herons", "heron", "hero", "her", "he"]), ("her", ["her", "he"]),
        ("hero", ["hero", "her", "he"]), ("heron", ["heron", "hero", "her", "he"]), ("he", ["he"]),
    ])


def test_requests_and_callers(spark):
    check(spark, nz.parse_entity_key, [
        ("520447183", "520447183"), ("52-0447183", "520447183"), ("5 2 0 4 4 7 1 8 3", "520447183"),
        (" n-00ab12cd34ef5678 ", "n-00ab12cd34ef5678"), ("5204471", None), ("n-Abc", None), ("drop table", None),
        (None, None),
    ])
    check(spark, nz.parse_soc, [("17-2051", "17-2051"), ("\t17-2051 ", "17-2051"), ("17/2051", None),
                                ("17-2051.01", None)])
    check(spark, nz.parse_level, [("iii", "III"), ("Na", "NA"), ("VI", None)])
    check(spark, nz.bucket_ip, [
        ("198.51.100.77", "198.51.100.77"),
        ("2001:DB8:7:8:9:a:b:c", "2001:db8:7:8::/64"),
        ("2001:db8:5::9%wlan1", "2001:db8:5:0::/64"), ("::7", "0:0:0:0::/64"),
        ("fd12::", "fd12:0:0:0::/64"),
    ])
    rows = spark.createDataFrame(
        [("secret", "::7", 8), (None, "::7", 8), ("", None, None)], "t string, ip string, asn int"
    ).select(nz.caller_key(F.col("t"), F.col("ip"), F.col("asn")).alias("k")).collect()
    assert rows[0]["k"].startswith("keyed|") and len(rows[0]["k"]) == 6 + 64
    assert [r["k"] for r in rows[1:]] == ["anon|0:0:0:0::/64|8", "anon|0.0.0.0|0"]


def test_wages_and_approvals(spark):
    df = spark.createDataFrame(
        [(D(100), D(200), "Year", "Withdrawn"), (D(101), None, "Year", "Certified-Expired"),
         (D(60), D(70), "Hour", "Denied"), (D(100), D(100), None, None)],
        "lo decimal(18,4), hi decimal(18,4), unit string, status string",
    )
    low, top, mid = nz.wage_range(F.col("lo"), F.col("hi"), F.col("unit"))
    got = df.select(
        low.cast("double"), top.cast("double"), mid.cast("double"),
        nz.approved_pwd(F.col("status")), nz.approved_perm(F.col("status")),
    ).collect()
    assert [tuple(r) for r in got] == [
        (100.0, 200.0, 150.0, False, False), (101.0, 101.0, 101.0, True, True),
        (None, None, None, True, False), (None, None, None, None, None),
    ]


def test_shortcuts_of_the_normalizers(spark):
    """Names, identifiers, prefixes and label maps as the plain definitions give them."""
    space = f"[{nz.NAME_SPACE}]+"
    names = [None, "", " ", "  ", "a b", "A  b", " a b ", "\tAcme Co", "École  x", "a\x1cb", "　a", "~a!", "a\x7fb", "İx"]
    numbers = [None, "", "0", "01", "9", "012345678", "01-2345678", "0123456789", "961234567", "99 1234567x", "1234567890123456789"]
    digits = F.regexp_replace("number", "[^0-9]", "")
    usable = (F.length(digits) == 9) & F.substring(digits, 1, 2).isin(*nz.BUSINESS_ID_PREFIXES)
    got = spark.createDataFrame([(n,) for n in names], "name string").select(
        nz.norm_name(F.col("name")).alias("got"),
        F.nullif(F.trim(F.regexp_replace(F.lower("name"), space, " ")), F.lit("")).alias("want")).collect()
    got += spark.createDataFrame([(n,) for n in numbers], "number string").select(
        nz.norm_ein(F.col("number")).alias("got"), F.when(usable, digits).alias("want")).collect()
    assert len(got) == len(names) + len(numbers) and all(r["got"] == r["want"] for r in got)
    counts = spark.createDataFrame([(0, 2, 1), (0, 0, 0), (3, 0, None)], "a long, b long, c long")
    mixed = counts.select(counts_to_map([("z", F.col("a")), ("y", F.col("b")), ("x", F.col("c"))]).alias("m"))
    assert [r["m"] for r in mixed.collect()] == [{"x": 1, "y": 2}, None, {"z": 3}]


def test_prefixes_are_not_interpreted(spark):
    """Rows of an index are cut by generated code, and their text is cleaned once."""
    df = spark.createDataFrame([("Acme & Co",), ("a",), ("ab",), (None,)], "name string")
    prefixes = df.select(nz.base_prefixes(F.col("name")).alias("p"))
    assert [r["p"] for r in prefixes.collect()] == [["ac", "acm"], [], ["ab"], []]
    label = counts_to_map([("a", F.length("name"))])
    plan = df.select(nz.base_prefixes(F.col("name")), label)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
