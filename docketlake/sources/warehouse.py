"""An order warehouse read as filings.

Every order line becomes a wage filing of its customer, every order a
prevailing-wage filing, every line a certification filing of its supplier. The
columns get the dirt real disclosures have (spellings, missing identifiers,
junk codes, mixed units), chosen by other columns, so the whole rebuild can be
run and checked on tables of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.operators.staging import RawFilings

ID_ERA = "1999-01-01"  # filings before it carry no identifier column


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _by(column: str, **cases: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items())
    return f"CASE {column} {whens} END"


#: Computed once per customer, with its nation.
CUSTOMER = {
    "c_custkey": "c_custkey",
    "c_mktsegment": "c_mktsegment",
    "who": "concat(reverse(substr(c_name, 10)), ' & ', lower(c_mktsegment))",
    "own_id": """concat(lpad(cast(10 + c_nationkey AS string), 2, '0'),
        lpad(cast(c_custkey AS string), 7, '0'))""",
    "next_id": """concat(lpad(cast(10 + c_nationkey AS string), 2, '0'),
        lpad(cast(c_custkey + 1 AS string), 7, '0'))""",
    "n_name": "n_name",
    "zip": "10000 + 100 * n_nationkey",
}

#: Computed once per order.
ORDER = {
    "o_orderkey": "o_orderkey",
    "o_orderstatus": "o_orderstatus",
    "o_orderpriority": "o_orderpriority",
    "o_orderdate": "o_orderdate",
    "o_totalprice": "o_totalprice",
    **{c: c for c in ("c_mktsegment", "own_id", "next_id", "n_name", "zip")},
    "spelled": """CASE o_orderpriority
        WHEN '1-URGENT' THEN upper(who)
        WHEN '2-HIGH' THEN replace(who, ' ', '  ')
        WHEN '3-MEDIUM' THEN concat(chr(9), who)
        WHEN '4-NOT SPECIFIED' THEN concat(who, ' ')
        ELSE who END""",
    "grade": _by(
        "o_orderpriority",
        **{"1-URGENT": "'I'", "2-HIGH": "' ii '", "3-MEDIUM": "'III'",
           "4-NOT SPECIFIED": "'N/A'", "5-LOW": "'IV'"},
    ),
}

PART = {
    "p_partkey": "p_partkey",
    "p_name": "p_name",
    "code": _by(
        "p_type", ECONOMY="'11-3021'", LARGE="'13-2011'", MEDIUM="'15-1252'",
        PROMO="'17-2051'", SMALL="'29-1141'", STANDARD="'43-4051'",
    ),
}

OFFER = "offer"

#: What the filings read of an order line, the price as a decimal.
LINE = {
    **{c: c for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax", "l_discount", "l_returnflag",
                      "l_linestatus", "l_shipdate")},
    "offer": "cast(l_extendedprice AS decimal(18,4))",
}

LCA = {
    "employer_name": """CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN NULL
        WHEN l_quantity = 50 AND l_linenumber = 6 THEN '' ELSE spelled END""",
    "employer_fein": f"""CASE
        WHEN l_shipdate < timestamp'{ID_ERA}' THEN NULL
        WHEN l_returnflag = 'N' AND o_orderpriority = '5-LOW' THEN NULL
        WHEN l_tax > 0.075 AND l_returnflag = 'A' THEN next_id
        WHEN l_discount > 0.095 AND l_returnflag = 'R' THEN substr(own_id, 1, 8)
        WHEN l_linestatus = 'O' THEN concat(substr(own_id, 1, 2), '-', substr(own_id, 3))
        ELSE own_id END""",
    "decision_date": """CASE WHEN o_orderstatus = 'P' AND l_linenumber = 5 THEN NULL
        ELSE cast(l_shipdate AS date) END""",
    "received_date": """CASE WHEN o_orderstatus = 'P' AND l_linenumber = 5
        AND l_returnflag = 'R' THEN NULL ELSE date_sub(cast(l_shipdate AS date), 30) END""",
    "soc_code": f"""CASE l_linenumber
        WHEN 2 THEN concat(code, '.00')
        WHEN 3 THEN concat(code, ' - ', p_name)
        WHEN 4 THEN concat(' ', code)
        WHEN 6 THEN concat(code, '-00')
        WHEN 7 THEN {_by("l_returnflag", R="'999999'", A="'2015-06-01 00:00:00'")}
        ELSE code END""",
    "pw_wage_level": "CASE WHEN l_tax < 0.005 THEN 'V' ELSE grade END",
    "job_title": """CASE WHEN l_quantity = 49 THEN NULL
        WHEN l_linenumber = 7 AND l_linestatus = 'O' THEN ' '
        WHEN l_linenumber = 4 THEN concat(' ', p_name, ' ')
        WHEN l_returnflag = 'A' THEN upper(p_name)
        ELSE p_name END""",
    "worksite_state": "CASE WHEN l_quantity = 48 THEN NULL ELSE n_name END",
    "worksite_county": _by(
        "l_returnflag",
        A="lower(concat('County of ', c_mktsegment))",
        R="upper(concat('County of ', c_mktsegment))",
        N="concat(' County of ', c_mktsegment, ' ')",
    ),
    "worksite_postal_code": """CASE WHEN l_linenumber = 6 THEN 'N/A' ELSE concat(
        cast(zip + CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS string),
        CASE l_linenumber WHEN 2 THEN '-1234' ELSE '' END) END""",
    "wage_unit_of_pay": """CASE WHEN l_quantity = 47 THEN NULL WHEN l_tax > 0.075 THEN 'Hour'
        ELSE 'Year' END""",
    "wage_rate_of_pay_from": OFFER,
    "wage_rate_of_pay_to": f"""CASE l_returnflag WHEN 'N' THEN NULL
        ELSE cast({OFFER} * 1.10 AS decimal(18,4)) END""",
    "pw_unit_of_pay": "CASE l_linenumber WHEN 3 THEN 'Hour' ELSE 'Year' END",
    "prevailing_wage": f"""CASE WHEN l_discount < 0.005 THEN cast(0 AS decimal(18,4))
        ELSE cast({OFFER} * (1 - cast(l_discount AS decimal(4,2))) AS decimal(18,4)) END""",
    "new_employment": "cast(l_quantity AS int)",
    "change_employer": "CASE l_returnflag WHEN 'A' THEN l_linenumber END",
    "continued_employment": "CASE l_linestatus WHEN 'O' THEN l_linenumber END",
    "secondary_entity": """CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'R' THEN 'N'
        ELSE CASE l_linestatus WHEN 'O' THEN 'Y' ELSE 'N/A' END END""",
    "h_1b_dependent": """CASE l_linenumber WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' WHEN 3 THEN 'Y'
        WHEN 4 THEN 'N' WHEN 5 THEN 'N/A' WHEN 7 THEN ' yes ' END""",
    "willful_violator": "CASE WHEN l_quantity = 1 AND l_tax < 0.005 THEN 'Y' ELSE 'No' END",
    "case_status": """CASE l_returnflag WHEN 'A' THEN 'Certified'
        WHEN 'R' THEN CASE l_linestatus WHEN 'F' THEN 'Denied' ELSE 'Withdrawn' END
        ELSE CASE l_linestatus WHEN 'F' THEN 'Certified' ELSE 'Certified - Withdrawn' END END""",
    "filed": "cast(l_shipdate AS date)",
}

PWD = {
    "case_status": """CASE o_orderstatus WHEN 'F' THEN 'Determination Issued'
        WHEN 'O' THEN 'Withdrawn'
        ELSE CASE o_orderpriority WHEN '5-LOW' THEN NULL ELSE 'Determination Issued' END END""",
    "received_date": "date_sub(cast(o_orderdate AS date), 60)",
    "determination_date": """CASE o_orderstatus WHEN 'P' THEN NULL
        ELSE cast(o_orderdate AS date) END""",
    "employer_legal_business_name": "spelled",
    "employer_fein": f"CASE WHEN o_orderdate >= timestamp'{ID_ERA}' THEN own_id END",
    "suggested_soc_code": "CASE WHEN o_totalprice < 50000 THEN '999999' ELSE "
    + _by(
        "c_mktsegment", AUTOMOBILE="'15-1252'", BUILDING="'13-2011'", FURNITURE="'17-2051'",
        HOUSEHOLD="'29-1141'", MACHINERY="'11-3021'",
    )
    + " END",
    "filed": "cast(o_orderdate AS date)",
}

PERM = {
    "case_status": """CASE l_returnflag WHEN 'A' THEN
        CASE l_linestatus WHEN 'O' THEN 'Certified' ELSE 'Certified-Expired' END
        WHEN 'R' THEN 'Denied' END""",
    "received_date": "date_sub(cast(l_shipdate AS date), 200)",
    "decision_date": "cast(l_shipdate AS date)",
    "employer_name": "replace(s_name, '#', ' ')",
    "employer_fein": f"""CASE WHEN l_shipdate >= timestamp'{ID_ERA}' THEN concat(
        CASE WHEN s_acctbal < 3000 THEN '96' ELSE '77' END,
        lpad(cast(s_suppkey AS string), 7, '0')) END""",
    "pw_soc_code": _by("l_returnflag", A="'15-1252.00'", R="'29-1141'"),
    "filed": "cast(l_shipdate AS date)",
}


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


def filings(spark: SparkSession, folder: str, before: str | None = None) -> RawFilings:
    """The three raw sources, lazily derived from the whole tables.

    No join is hinted: measured sizes decide what is broadcast, and the adaptive
    skew rule may split a hot side of the others. ``filed`` is the date ``before`` refers to. ``before`` takes the state of an
    earlier publish: what was shipped or ordered before that date.
    """
    lines, ordered = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    known = ordered
    if before:
        lines = lines.filter(F.col("l_shipdate") < F.lit(before).cast("timestamp"))
        known = ordered.filter(F.col("o_orderdate") < F.lit(before).cast("timestamp"))
    customers = _select(
        table(spark, folder, "customer").join(
            table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
        ),
        CUSTOMER,
    )
    def of_customers(orders: DataFrame) -> DataFrame:
        joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        return _select(joined, ORDER)

    parts = _select(table(spark, folder, "part"), PART)
    # Lines meet parts while they are narrow, and only then the many columns of an order.
    lca = (
        _select(lines, LINE)
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(of_customers(ordered), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    suppliers = table(spark, folder, "supplier")
    perm = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return RawFilings(_select(lca, LCA), _select(of_customers(known), PWD), _select(perm, PERM))
