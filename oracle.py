"""DuckDB SQL that restates every registered query on the same tables.

Common table expressions are kept by name; a query is a final SELECT plus those
it reaches. ``now`` is the whole data, ``old`` the data before ``EARLIER``.
"""

from __future__ import annotations

import re

from docketlake.functions.normalize import BUSINESS_ID_PREFIXES

EARLIER = "2001-01-01"
ERA = "1999-01-01"
# The white space of the search rules, in the pattern syntax of RE2.
SPACE = (
    r"[ \t\n\x0b\f\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)


# --- scalar rules as SQL text -------------------------------------------------

def soc(x): return f"nullif(regexp_extract(trim({x}), '^[0-9]{{2}}-[0-9]{{4}}'), '')"
def flag(x):
    w = f"lower(trim({x}))"
    return f"CASE WHEN {w} IN ('y','yes') THEN true WHEN {w} IN ('n','no') THEN false END"
def level(x):
    return f"CASE WHEN upper(trim({x})) IN ('I','II','III','IV') THEN upper(trim({x})) END"
def ein(x):
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    ids = ", ".join(f"'{i}'" for i in BUSINESS_ID_PREFIXES)
    return f"CASE WHEN length({d}) = 9 AND substr({d}, 1, 2) IN ({ids}) THEN {d} END"
NAME_SPACE = (
    r"[ \t-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
def name(x): return f"nullif(trim(regexp_replace(lower({x}), '{NAME_SPACE}+', ' ', 'g')), '')"
def zip5(x): return f"nullif(regexp_extract({x}, '^[0-9]{{5}}'), '')"
def squash(x):
    return (f"regexp_replace(trim(regexp_replace(lower(coalesce({x}, '')), '{SPACE}+', ' ', 'g')), "
            "'[^a-z0-9 ]', '', 'g')")
def strip(x): return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
def cents(total5, n):
    """Mean of values summed in 1/100000, rounded half up to cents, as a double."""
    return f"CASE WHEN {n} > 0 THEN ((2 * {total5} + 1000 * {n}) // (2000 * {n})) / 100.0 END"
def sum5(x): return f"sum(CAST({x} * 100000 AS HUGEINT))"
def pct(p): return (f"CAST(round(CAST(quantile_cont(CAST(wage_mid AS DOUBLE), {p}) AS DECIMAL(20,6)), 2)"
                    " AS DOUBLE)")
def dbl(x): return f"CAST({x} AS DOUBLE)"
def share(a, b, s): return f"CAST(round(CAST({a} AS DOUBLE) / {b}, {s}) AS DOUBLE)"
def obj(k, v, where="true"):
    """{k: v, ...} ordered by k over rows where ``where``; NULL when there is none."""
    return (f"'{{' || string_agg('\"' || {k} || '\":' || {v}, ',' ORDER BY {k}) "
            f"FILTER (WHERE {where}) || '}}'")


# --- shared tables ------------------------------------------------------------

def _shared(s: str, before: str | None) -> dict[str, str]:
    lines = f"(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{before}')" if before else "lineitem"
    orders = f"(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{before}')" if before else "orders"
    return {
        f"cust{s}": """SELECT c_custkey, c_mktsegment,
            reverse(substr(c_name, 10)) || ' & ' || lower(c_mktsegment) AS who,
            lpad(CAST(10 + c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS own_id,
            lpad(CAST(10 + c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey + 1 AS VARCHAR), 7, '0') AS next_id,
            n_name, 10000 + 100 * n_nationkey AS zip
            FROM customer JOIN nation ON c_nationkey = n_nationkey""",
        f"ord{s}": f"""SELECT o.*, c.*, CASE o_orderpriority
              WHEN '1-URGENT' THEN upper(who) WHEN '2-HIGH' THEN replace(who, ' ', '  ')
              WHEN '3-MEDIUM' THEN chr(9) || who WHEN '4-NOT SPECIFIED' THEN who || ' ' ELSE who END AS spelled
            FROM orders o JOIN cust{s} c ON o_custkey = c_custkey""",
        f"lca_raw{s}": f"""SELECT
            CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN NULL
                 WHEN l_quantity = 50 AND l_linenumber = 6 THEN '' ELSE spelled END AS employer_name,
            CASE WHEN l_shipdate < TIMESTAMP '{ERA}' THEN NULL
                 WHEN l_returnflag = 'N' AND o_orderpriority = '5-LOW' THEN NULL
                 WHEN l_tax > 0.075 AND l_returnflag = 'A' THEN next_id
                 WHEN l_discount > 0.095 AND l_returnflag = 'R' THEN substr(own_id, 1, 8)
                 WHEN l_linestatus = 'O' THEN substr(own_id, 1, 2) || '-' || substr(own_id, 3)
                 ELSE own_id END AS employer_fein,
            CASE WHEN o_orderstatus = 'P' AND l_linenumber = 5 THEN NULL
                 ELSE CAST(l_shipdate AS DATE) END AS decision_date,
            CASE WHEN o_orderstatus = 'P' AND l_linenumber = 5 AND l_returnflag = 'R' THEN NULL
                 ELSE CAST(l_shipdate AS DATE) - 30 END AS received_date,
            CASE l_linenumber WHEN 2 THEN code || '.00' WHEN 3 THEN code || ' - ' || p_name
                 WHEN 4 THEN ' ' || code WHEN 6 THEN code || '-00'
                 WHEN 7 THEN CASE l_returnflag WHEN 'R' THEN '999999' WHEN 'A' THEN '2015-06-01 00:00:00' END
                 ELSE code END AS soc_code,
            CASE WHEN l_tax < 0.005 THEN 'V' ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'I'
                 WHEN '2-HIGH' THEN ' ii ' WHEN '3-MEDIUM' THEN 'III' WHEN '4-NOT SPECIFIED' THEN 'N/A'
                 ELSE 'IV' END END AS pw_wage_level,
            CASE WHEN l_quantity = 49 THEN NULL WHEN l_linenumber = 7 AND l_linestatus = 'O' THEN ' '
                 WHEN l_linenumber = 4 THEN ' ' || p_name || ' ' WHEN l_returnflag = 'A' THEN upper(p_name)
                 ELSE p_name END AS job_title,
            CASE WHEN l_quantity = 48 THEN NULL ELSE n_name END AS worksite_state,
            CASE l_returnflag WHEN 'A' THEN lower('County of ' || c_mktsegment)
                 WHEN 'R' THEN upper('County of ' || c_mktsegment)
                 WHEN 'N' THEN ' County of ' || c_mktsegment || ' ' END AS worksite_county,
            CASE WHEN l_linenumber = 6 THEN 'N/A' ELSE
                 CAST(zip + CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS VARCHAR)
                 || CASE l_linenumber WHEN 2 THEN '-1234' ELSE '' END END AS worksite_postal_code,
            CASE WHEN l_quantity = 47 THEN NULL WHEN l_tax > 0.075 THEN 'Hour' ELSE 'Year' END AS unit,
            CAST(l_extendedprice AS DECIMAL(18,4)) AS offer,
            CASE l_returnflag WHEN 'N' THEN NULL
                 ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * 1.10 AS DECIMAL(18,4)) END AS offer_to,
            CASE l_linenumber WHEN 3 THEN 'Hour' ELSE 'Year' END AS pw_unit,
            CASE WHEN l_discount < 0.005 THEN CAST(0 AS DECIMAL(18,4)) ELSE
                 CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
                      AS DECIMAL(18,4)) END AS prevailing,
            CAST(l_quantity AS BIGINT) AS new_emp,
            CASE l_returnflag WHEN 'A' THEN l_linenumber ELSE 0 END AS chg_emp,
            CASE l_linestatus WHEN 'O' THEN l_linenumber ELSE 0 END AS cont_emp,
            CASE l_returnflag WHEN 'A' THEN 'Yes' WHEN 'R' THEN 'N'
                 ELSE CASE l_linestatus WHEN 'O' THEN 'Y' ELSE 'N/A' END END AS secondary_entity,
            CASE l_linenumber WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' WHEN 3 THEN 'Y' WHEN 4 THEN 'N'
                 WHEN 5 THEN 'N/A' WHEN 7 THEN ' yes ' END AS h_1b_dependent,
            CASE WHEN l_quantity = 1 AND l_tax < 0.005 THEN 'Y' ELSE 'No' END AS willful_violator,
            CASE l_returnflag WHEN 'A' THEN 'Certified'
                 WHEN 'R' THEN CASE l_linestatus WHEN 'F' THEN 'Denied' ELSE 'Withdrawn' END
                 ELSE CASE l_linestatus WHEN 'F' THEN 'Certified' ELSE 'Certified - Withdrawn' END END AS status
          FROM {lines} l JOIN ord{s} ON l_orderkey = o_orderkey
          JOIN (SELECT p_partkey, p_name, CASE p_type WHEN 'ECONOMY' THEN '11-3021' WHEN 'LARGE' THEN '13-2011'
                 WHEN 'MEDIUM' THEN '15-1252' WHEN 'PROMO' THEN '17-2051' WHEN 'SMALL' THEN '29-1141'
                 WHEN 'STANDARD' THEN '43-4051' END AS code FROM part) ON l_partkey = p_partkey""",
        f"lca{s}": f"""SELECT {name('employer_name')} AS nm, {ein('employer_fein')} AS ein,
            trim(employer_name) AS name, coalesce(decision_date, received_date) AS d,
            year(coalesce(decision_date, received_date)) AS year, {soc('soc_code')} AS soc,
            {level('pw_wage_level')} AS level, nullif(trim(job_title), '') AS title,
            worksite_state AS state, nullif(upper(trim(worksite_county)), '') AS county,
            {zip5('worksite_postal_code')} AS zip, status,
            CASE WHEN unit = 'Year' THEN offer END AS wage_from,
            CASE WHEN unit = 'Year' THEN coalesce(offer_to, offer) END AS wage_to,
            CASE WHEN unit = 'Year' THEN CAST((offer + coalesce(offer_to, offer)) * 0.5 AS DECIMAL(20,5)) END
              AS wage_mid,
            CASE WHEN pw_unit = 'Year' THEN prevailing END AS pw,
            new_emp, chg_emp, cont_emp, {flag('secondary_entity')} AS secondary,
            {flag('h_1b_dependent')} AS dependent, {flag('willful_violator')} AS willful
          FROM lca_raw{s}""",
        f"gcs{s}": f"""SELECT {name('spelled')} AS nm,
            CASE WHEN o_orderdate >= TIMESTAMP '{ERA}' THEN {ein('own_id')} END AS ein,
            trim(spelled) AS name,
            coalesce(CASE o_orderstatus WHEN 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END,
                     CAST(o_orderdate AS DATE) - 60) AS d,
            'PWD' AS typ,
            CASE WHEN o_totalprice >= 50000 THEN CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '15-1252'
              WHEN 'BUILDING' THEN '13-2011' WHEN 'FURNITURE' THEN '17-2051' WHEN 'HOUSEHOLD' THEN '29-1141'
              WHEN 'MACHINERY' THEN '11-3021' END END AS soc,
            CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false
              ELSE CASE o_orderpriority WHEN '5-LOW' THEN NULL ELSE true END END AS approved
          FROM {'(SELECT * FROM ord' + s + " WHERE o_orderdate < TIMESTAMP '" + before + "')" if before else 'ord' + s}
          UNION ALL
          SELECT {name("replace(s_name, '#', ' ')")},
            CASE WHEN l_shipdate >= TIMESTAMP '{ERA}' AND s_acctbal >= 3000
                 THEN '77' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') END,
            replace(s_name, '#', ' '), CAST(l_shipdate AS DATE), 'PERM',
            CASE l_returnflag WHEN 'A' THEN '15-1252' WHEN 'R' THEN '29-1141' END,
            CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END
          FROM {lines} l JOIN supplier ON l_suppkey = s_suppkey""",
        f"named{s}": f"""SELECT nm, ein, name, d FROM lca{s} UNION ALL SELECT nm, ein, name, d FROM gcs{s}""",
        f"idmap{s}": f"""SELECT nm, ein AS mapped FROM (
            SELECT nm, ein, row_number() OVER (PARTITION BY nm ORDER BY count(*) DESC, ein) AS rn
            FROM named{s} WHERE nm IS NOT NULL AND ein IS NOT NULL GROUP BY nm, ein) WHERE rn = 1""",
        f"lca_n{s}": f"""SELECT coalesce(l.ein, mapped, 'n-' || substr(md5(l.nm), 1, 16)) AS key, l.*
            FROM lca{s} l LEFT JOIN idmap{s} m ON l.nm = m.nm WHERE l.nm IS NOT NULL AND d IS NOT NULL""",
        f"gc_n{s}": f"""SELECT coalesce(g.ein, mapped, 'n-' || substr(md5(g.nm), 1, 16)) AS key,
            year(d) AS year, typ, soc, approved
            FROM gcs{s} g LEFT JOIN idmap{s} m ON g.nm = m.nm WHERE g.nm IS NOT NULL AND d IS NOT NULL""",
        f"emp_src{s}": f"""SELECT coalesce(n.ein, mapped, 'n-' || substr(md5(n.nm), 1, 16)) AS key, n.ein, n.name, d
            FROM named{s} n LEFT JOIN idmap{s} m ON n.nm = m.nm WHERE n.nm IS NOT NULL""",
        f"employers{s}": f"""SELECT key, coalesce(ein, CASE WHEN regexp_matches(key, '^[0-9]{{9}}$') THEN key END)
              AS ein, name FROM (SELECT *, row_number() OVER (PARTITION BY key
              ORDER BY d DESC NULLS LAST, name, ein NULLS LAST) AS rn FROM emp_src{s}) WHERE rn = 1""",
        f"annual{s}": f"SELECT * FROM lca_n{s} WHERE soc IS NOT NULL AND wage_mid IS NOT NULL",
        f"jobs{s}": f"""SELECT key, CAST(year AS SMALLINT) AS year, soc AS soc_code, level, state, county, zip,
            {cents(sum5('wage_mid'), 'count(wage_mid)')} AS avg_wage,
            {dbl('min(wage_from)')} AS min_wage, {dbl('CAST(round(max(wage_to), 2) AS DECIMAL(12,2))')} AS max_wage,
            {cents(sum5('pw'), 'count(pw)')} AS avg_prev_wage, CAST(count(*) AS BIGINT) AS n_filings
            FROM annual{s} GROUP BY key, year, soc, level, state, county, zip""",
        f"titles{s}": f"""SELECT key, soc AS soc_code, title, CAST(count(*) AS BIGINT) AS n_filings,
            {cents(sum5('wage_mid'), 'count(wage_mid)')} AS avg_wage,
            {dbl('min(wage_from)')} AS min_wage, {dbl('CAST(round(max(wage_to), 2) AS DECIMAL(12,2))')} AS max_wage
            FROM lca_n{s} WHERE soc IS NOT NULL AND title IS NOT NULL GROUP BY key, soc, title""",
        f"title_levels{s}": f"""SELECT key, soc AS soc_code, title, {obj('lv', 'n')} AS level_mix FROM (
            SELECT key, soc, title, coalesce(level, 'unknown') AS lv, count(*) AS n FROM lca_n{s}
            WHERE soc IS NOT NULL AND title IS NOT NULL GROUP BY ALL) GROUP BY key, soc, title""",
        f"titles_mix{s}": f"SELECT * FROM titles{s} JOIN title_levels{s} USING (key, soc_code, title)",
        f"title_docs{s}": f"""SELECT 'e/' || key || '/titles.json' AS key,
            '{{"id":"' || key || '","titles":[' || string_agg('{{"soc_code":"' || soc_code || '","title":"' || title
            || '","n_filings":' || n_filings || ',"avg_wage":' || coalesce(CAST(avg_wage AS VARCHAR), 'null')
            || ',"min_wage":' || coalesce(CAST(min_wage AS VARCHAR), 'null') || ',"max_wage":'
            || coalesce(CAST(max_wage AS VARCHAR), 'null') || ',"level_mix":' || level_mix || '}}', ','
            ORDER BY n_filings DESC, soc_code, title) || ']}}' AS body FROM titles_mix{s} GROUP BY key""",
    }


def _more() -> dict[str, str]:
    tail = "n_filings, employer_count, p25, p50, p75, mean, min_wage, max_wage"
    year_totals = ", ".join(
        f"count(*) FILTER (WHERE status = '{v}') AS {k}"
        for k, v in {"certified": "Certified", "denied": "Denied", "withdrawn": "Withdrawn",
                     "certified_withdrawn": "Certified - Withdrawn"}.items()
    )
    def tier(depths):
        return " UNION ALL ".join(
            f"SELECT substr(nm, 1, {d}) AS prefix, e.* FROM deep e WHERE length(nm) >= {d}" for d in depths)
    def index(source, order, payload, s, cap):
        """Closed form of the tiers, with the ranked heads."""
        return {
            f"base_{s}": f"""SELECT *, {squash('nm')} AS again FROM ({source})""",
            f"top_{s}": f"""SELECT substr(again, 1, 3) AS top FROM base_{s} WHERE length(again) >= 3
                GROUP BY 1 HAVING count(*) > {cap}""",
            f"members_{s}": f"""SELECT substr(again, 1, k) AS prefix, b.* FROM base_{s} b,
                (SELECT unnest([2, 3]) AS k) WHERE length(again) >= k
                UNION ALL SELECT substr(nm, 1, k) AS prefix, b.* FROM base_{s} b
                JOIN top_{s} ON substr(again, 1, 3) = top AND length(again) >= 3,
                (SELECT unnest([4, 5, 6, 7, 8, 9, 10]) AS k) WHERE length(nm) >= k""",
            f"counts_{s}": f"SELECT prefix, count(*) AS total FROM members_{s} GROUP BY prefix",
            f"live_{s}": f"""SELECT * FROM counts_{s} c WHERE length(prefix) <= 4 OR EXISTS (
                SELECT 1 FROM counts_{s} p WHERE p.total > {cap}
                AND p.prefix = substr(c.prefix, 1, length(c.prefix) - 1))""",
            f"heads_{s}": f"""SELECT prefix, total, CAST(row_number() OVER (PARTITION BY prefix ORDER BY {order})
                AS INTEGER) AS rank, {payload} FROM (SELECT m.*, total, row_number() OVER (PARTITION BY prefix
                ORDER BY CASE WHEN nm = prefix THEN 0 ELSE 1 END, {order}) AS seat
                FROM members_{s} m JOIN live_{s} USING (prefix)) WHERE seat <= {cap}""",
        }
    return {
        "bench": f"""SELECT soc AS soc_code, level, CAST(year AS SMALLINT) AS year,
            CASE WHEN gz = 0 THEN 'zip' WHEN gs = 0 THEN 'state' ELSE 'national' END AS scope,
            CASE WHEN gs = 0 THEN state END AS state, CASE WHEN gz = 0 THEN zip END AS zip, {tail} FROM (
            SELECT soc, level, year, state, zip, grouping(state) AS gs, grouping(zip) AS gz,
              CAST(count(*) AS BIGINT) AS n_filings, CAST(count(DISTINCT key) AS BIGINT) AS employer_count,
              {pct(0.25)} AS p25, {pct(0.5)} AS p50, {pct(0.75)} AS p75,
              {cents(sum5('wage_mid'), 'count(*)')} AS mean, {dbl('min(wage_from)')} AS min_wage,
              {dbl('CAST(round(max(wage_to), 2) AS DECIMAL(12,2))')} AS max_wage
            FROM annual GROUP BY GROUPING SETS ((soc, level, year), (soc, level, year, state),
              (soc, level, year, state, zip)))
          WHERE (gz = 0 AND zip IS NOT NULL AND n_filings >= 5) OR (gz = 1 AND gs = 0 AND state IS NOT NULL)
             OR (gz = 1 AND gs = 1)""",
        "gc": """SELECT key, CAST(year AS SMALLINT) AS year, typ AS type, soc AS soc_code,
            CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE approved) AS BIGINT) AS n_approved
            FROM gc_n WHERE soc IS NOT NULL GROUP BY key, year, typ, soc""",
        "agg": f"""SELECT key, min(year) AS fy, max(year) AS ly, count(*) AS n_lca, {year_totals},
            sum(new_emp) AS n_new, sum(chg_emp) AS n_transfer, sum(cont_emp) AS n_continued,
            count(*) FILTER (WHERE secondary) AS n_secondary, count(*) FILTER (WHERE dependent) AS n_dependent,
            count(*) FILTER (WHERE willful) AS n_willful,
            CAST(round(CAST(CAST(sum(CAST(CAST(wage_mid AS DOUBLE) / nullif(CAST(pw AS DOUBLE), 0) AS DECIMAL(30,14)))
                FILTER (WHERE pw > 0) AS DOUBLE) / count(wage_mid) FILTER (WHERE pw > 0) AS DECIMAL(20,10)), 3)
                AS DOUBLE) AS wage_vs_pw
            FROM lca_n GROUP BY key""",
        "gctot": """SELECT key, min(year) AS gfy, max(year) AS gly, count(*) FILTER (WHERE typ = 'PWD') AS n_pwd,
            count(*) FILTER (WHERE typ = 'PERM') AS n_perm FROM gc_n GROUP BY key""",
        "lvl": f"""SELECT key, {obj('lv', 'n')} AS level_mix FROM (SELECT key, coalesce(level, 'unknown') AS lv,
            count(*) AS n FROM lca_n GROUP BY ALL) GROUP BY key""",
        "trend": f"""SELECT key, '[' || string_agg('{{"year":' || year || ',"filings":' || f || ',"new":' || nw
            || ',"transfer":' || tr || ',"continued":' || ct || ',"certified":' || certified || ',"denied":' || denied
            || ',"withdrawn":' || withdrawn || ',"certified_withdrawn":' || certified_withdrawn || '}}', ','
            ORDER BY year) || ']' AS trend FROM (SELECT key, year, count(*) AS f, sum(new_emp) AS nw,
            sum(chg_emp) AS tr, sum(cont_emp) AS ct, {year_totals} FROM lca_n GROUP BY key, year) GROUP BY key""",
        "socyear": f"""SELECT key, {obj('soc', 'ym')} AS filings_by_soc_year FROM (SELECT key, soc,
            {obj('year', 'n')} AS ym FROM (SELECT key, soc, year, count(*) AS n FROM lca_n WHERE soc IS NOT NULL
            GROUP BY ALL) GROUP BY key, soc) GROUP BY key""",
        "gcyear": """SELECT key, '[' || string_agg('{"year":' || year || ',"pwd":' || pwd || ',"perm":' || perm
            || ',"pwd_approved":' || pwa || ',"perm_approved":' || pea || '}', ',' ORDER BY year) || ']' AS gc_by_year
            FROM (SELECT key, year, count(*) FILTER (WHERE typ = 'PWD') AS pwd,
              count(*) FILTER (WHERE typ = 'PERM') AS perm, count(*) FILTER (WHERE typ = 'PWD' AND approved) AS pwa,
              count(*) FILTER (WHERE typ = 'PERM' AND approved) AS pea FROM gc_n GROUP BY key, year) GROUP BY key""",
        "gcsoc": f"""SELECT key, {obj('soc', 'o')} AS gc_by_soc FROM (SELECT key, soc, '{{"pwd":' ||
            count(*) FILTER (WHERE typ = 'PWD') || ',"perm":' || count(*) FILTER (WHERE typ = 'PERM') || '}}' AS o
            FROM gc_n WHERE soc IS NOT NULL GROUP BY key, soc) GROUP BY key""",
        "profile": """SELECT e.key, CAST(least(fy, gfy) AS SMALLINT) AS first_year,
            CAST(greatest(ly, gly) AS SMALLINT) AS last_year, CAST(coalesce(n_lca, 0) AS BIGINT) AS n_lca,
            CAST(coalesce(certified, 0) AS BIGINT) AS n_certified,
            CAST(coalesce(certified_withdrawn, 0) AS BIGINT) AS n_certified_withdrawn,
            CAST(coalesce(denied, 0) AS BIGINT) AS n_denied, CAST(coalesce(withdrawn, 0) AS BIGINT) AS n_withdrawn,
            CAST(coalesce(n_new, 0) AS BIGINT) AS n_new, CAST(coalesce(n_transfer, 0) AS BIGINT) AS n_transfer,
            CAST(coalesce(n_continued, 0) AS BIGINT) AS n_continued, CAST(coalesce(n_pwd, 0) AS BIGINT) AS n_pwd,
            CAST(coalesce(n_perm, 0) AS BIGINT) AS n_perm, coalesce(n_pwd, 0) + coalesce(n_perm, 0) > 0 AS does_gc,
            wage_vs_pw FROM employers e LEFT JOIN agg USING (key) LEFT JOIN gctot USING (key)""",
        "flags": f"""SELECT key, coalesce(n_secondary / n_lca > 0.5, false) AS staffing_shop,
            coalesce({share('n_secondary', 'n_lca', 3)}, 0) AS staffing_share,
            coalesce(n_secondary, 0) AS n_secondary, coalesce(n_dependent / n_lca > 0.5, false) AS h1b_dependent,
            coalesce(n_dependent, 0) AS n_dependent, coalesce(n_willful, 0) > 0 AS willful_violator,
            coalesce(n_willful, 0) AS n_willful, coalesce(n_lca, 0) AS n_total
            FROM employers LEFT JOIN agg USING (key)""",
        "entries": f"""SELECT {squash('name')} AS nm, key, ein, name, n_lca AS n_filings
            FROM employers JOIN profile USING (key)""",
        "corpus": f"""SELECT nm, soc_code, arg_min(title, ord) AS title, CAST(sum(n_filings) AS BIGINT) AS n FROM (
            SELECT *, {squash('title')} AS nm, row_number() OVER (ORDER BY key, n_filings DESC, soc_code, title) AS ord
            FROM titles) GROUP BY nm, soc_code""",
        **index("SELECT * FROM entries", "n_filings DESC, name, key", "key, ein, name, n_filings", "s", 50),
        **index("SELECT * FROM corpus", "n DESC, soc_code, title", "title, soc_code, n", "t", 50),
    }


TABLES = {**_shared("", None), **_shared("_old", EARLIER), **_more()}


def query(final: str) -> str:
    """``final`` with the shared tables it reaches, in definition order."""
    if final.startswith("WITH"):
        return final
    needed, todo = set(), [final]
    while todo:
        text = todo.pop()
        for t in set(re.findall(r"(?:FROM|JOIN|,)\s+\(?([a-z_]+)\b", text)) & set(TABLES) - needed:
            needed.add(t)
            todo.append(TABLES[t])
    parts = [f"{t} AS ({TABLES[t]})" for t in TABLES if t in needed]
    return f"WITH {', '.join(parts)} {final}" if parts else final


# --- the queries --------------------------------------------------------------

def _fields(pairs, source):
    return " UNION ALL ".join(
        f"SELECT '{f}' AS field, {f if col is None else col} AS raw, {clean} AS clean FROM {source}"
        for f, col, clean in pairs)


_CODES = _fields([
    ("soc_code", None, soc("soc_code")), ("pw_wage_level", None, level("pw_wage_level")),
    ("employer_fein", None, ein("employer_fein")),
    ("worksite_postal_code", None, zip5("worksite_postal_code")),
    ("job_title", None, "nullif(trim(job_title), '')"),
    ("worksite_county", None, "nullif(upper(trim(worksite_county)), '')"),
    ("secondary_entity", None, f"CAST({flag('secondary_entity')} AS VARCHAR)"),
    ("h_1b_dependent", None, f"CAST({flag('h_1b_dependent')} AS VARCHAR)"),
], "lca_raw")


def _key(x):
    s = strip(x)
    d = f"regexp_replace({s}, '[^0-9]', '', 'g')"
    return (f"CASE WHEN regexp_matches({s}, '^n-[a-z0-9-]{{1,64}}$') THEN {s} "
            f"WHEN length({d}) = 9 THEN {d} END")


def _soc_asked(x):
    return f"CASE WHEN regexp_matches({strip(x)}, '^[0-9]{{2}}-[0-9]{{4}}$') THEN {strip(x)} END"


def _level_asked(x):
    return f"CASE WHEN upper({strip(x)}) IN ('I','II','III','IV','NA') THEN upper({strip(x)}) END"


_ASKED = _fields([
    ("id", "employer_fein", _key("employer_fein")), ("soc", "soc_code", _soc_asked("soc_code")),
    ("level", "pw_wage_level", _level_asked("pw_wage_level")),
], "lca_raw")

_TERM = squash("q")
_PREFIX = f"CASE WHEN length({_TERM}) >= 2 THEN substr({_TERM}, 1, 10) END"


def _ladder(p):
    """Candidate prefixes of ``p`` as a list, longest first."""
    n = f"length({p})"
    return (f"list_transform(list_reverse_sort(list_distinct(list_filter([{n}, {n} - 1, {n} - 2, 3, 2], "
            f"lambda d: d >= 2 AND d <= {n}))), lambda d: substr({p}, 1, d))")


_STAT = ("'{\"year\":' || year || ',\"n_filings\":' || n_filings || ',\"employer_count\":' || employer_count "
         + " ".join(f"|| ',\"{p}\":' || {p}" for p in ("p25", "p50", "p75", "mean", "min_wage", "max_wage"))
         + " || '}'")
_NUM = lambda x: f"coalesce(CAST({x} AS VARCHAR), 'null')"
_STR = lambda x: f"coalesce('\"' || {x} || '\"', 'null')"

def _jobs_docs(s: str) -> str:
    return f"""SELECT 'e/' || key || '/jobs.json' AS key, '{{"id":"' || key || '","jobs":[' || string_agg(
        '{{"year":' || year || ',"soc_code":"' || soc_code || '","level":' || {_STR('level')}
        || ',"avg_offered_wage":' || avg_wage || ',"min_wage":' || min_wage || ',"max_wage":' || max_wage
        || ',"avg_prevailing_wage":' || {_NUM('avg_prev_wage')} || ',"state":' || {_STR('state')}
        || ',"county":' || {_STR('county')} || ',"zip":' || {_STR('zip')} || ',"n_filings":' || n_filings || '}}', ','
        ORDER BY year DESC, soc_code, level NULLS LAST, state NULLS LAST, county NULLS LAST, zip NULLS LAST)
        || ']}}' AS body FROM jobs{s} GROUP BY key"""


TABLES.update({
    "wage_docs": f"""SELECT 'w/' || soc_code || '/' || coalesce(level, 'NA') || '.json' AS key,
        '{{"soc_code":"' || soc_code || '","level":' || {_STR('level')} || ',"national":[' ||
        coalesce(string_agg(list, ',') FILTER (WHERE scope = 'national'), '') || '],"states":{{' ||
        coalesce(string_agg('"' || place || '":[' || list || ']', ',' ORDER BY place) FILTER (WHERE scope = 'state'), '')
        || '}},"zips":{{' ||
        coalesce(string_agg('"' || place || '":[' || list || ']', ',' ORDER BY place) FILTER (WHERE scope = 'zip'), '')
        || '}}}}' AS body FROM (
          SELECT soc_code, level, scope, place, string_agg(stat, ',' ORDER BY state NULLS LAST, zip NULLS LAST, year)
            AS list FROM (SELECT *, {_STAT} AS stat, CASE scope WHEN 'zip' THEN zip WHEN 'state' THEN state END AS place
            FROM bench) GROUP BY ALL) GROUP BY soc_code, level""",
    "jobs_docs": _jobs_docs(""),
    "jobs_docs_old": _jobs_docs("_old"),
    "has": """SELECT key, key IN (SELECT key FROM jobs) AS has_jobs, key IN (SELECT key FROM titles) AS has_titles
        FROM employers""",
    "profile_docs": f"""SELECT 'e/' || key || '.json' AS key,
        '{{"employer":{{"id":"' || key || '","ein":' || {_STR('ein')} || ',"name":' || to_json(name)
        || '}},"years":{{"first":' || first_year || ',"last":' || last_year || '}},"filings":{{"lca":' || p.n_lca
        || ',"certified":' || n_certified || ',"certified_withdrawn":' || n_certified_withdrawn || ',"denied":'
        || n_denied || ',"withdrawn":' || n_withdrawn || ',"new":' || p.n_new || ',"transfer":' || p.n_transfer
        || ',"continued":' || p.n_continued || '}},"green_card":{{"evidence":"'
        || CASE WHEN does_gc THEN 'present' ELSE 'absent' END || '","pwd":' || p.n_pwd || ',"perm":' || p.n_perm
        || ',"by_year":' || coalesce(gc_by_year, '[]') || ',"by_soc":' || coalesce(gc_by_soc, '{{}}')
        || '}},"wage_vs_prevailing":' || {_NUM('p.wage_vs_pw')} || ',"has_jobs":' || has_jobs || ',"has_titles":'
        || has_titles || ',"filings_by_soc_year":' || coalesce(filings_by_soc_year, '{{}}') || ',"trend":'
        || coalesce(trend, '[]') || ',"level_mix":' || coalesce(level_mix, '{{}}')
        || ',"red_flags":{{"staffing_shop":{{"value":' || staffing_shop || ',"basis":"secondary_entity_share","share":'
        || staffing_share || ',"n_secondary":' || f.n_secondary || ',"n_total":' || n_total
        || '}},"h1b_dependent":{{"value":' || h1b_dependent || ',"n_yes":' || f.n_dependent || ',"n_total":' || n_total
        || '}},"willful_violator":{{"value":' || willful_violator || ',"n_yes":' || f.n_willful || ',"n_total":'
        || n_total || '}}}}}}' AS body
        FROM employers JOIN profile p USING (key) JOIN flags f USING (key) JOIN has USING (key)
        LEFT JOIN gcyear USING (key) LEFT JOIN gcsoc USING (key) LEFT JOIN socyear USING (key)
        LEFT JOIN trend USING (key) LEFT JOIN lvl USING (key)""",
    "s_docs": """SELECT 's/' || prefix || '.json' AS key, prefix, '{"prefix":"' || prefix || '","total":' || total
        || ',"results":[' || string_agg('{"id":"' || key || '","ein":' || coalesce('"' || ein || '"', 'null')
        || ',"name":' || to_json(name) || ',"n_filings":' || n_filings || '}', ',' ORDER BY rank) || ']}' AS body
        FROM heads_s GROUP BY prefix, total""",
    "t_docs": """SELECT 't/' || prefix || '.json' AS key, prefix, '{"prefix":"' || prefix || '","total":' || total
        || ',"results":[' || string_agg('{"title":"' || title || '","soc_code":"' || soc_code || '","n":' || n || '}',
        ',' ORDER BY rank) || ']}' AS body FROM heads_t GROUP BY prefix, total""",
    "asked_terms": f"""SELECT q, {_PREFIX} AS prefix FROM (SELECT s_name AS q FROM supplier
        UNION SELECT p_name FROM part UNION SELECT employer_name FROM lca_raw) WHERE q IS NOT NULL""",
    "ranked_terms": f"""SELECT prefix, try, n FROM (SELECT prefix, {_ladder('prefix')} AS tries
        FROM (SELECT DISTINCT prefix FROM asked_terms WHERE prefix IS NOT NULL)),
        LATERAL (SELECT unnest(tries) AS try, generate_subscripts(tries, 1) AS n)""",
    "term_hits": """SELECT prefix, arg_min(try, n) AS hit FROM ranked_terms
        WHERE try IN (SELECT prefix FROM s_docs) GROUP BY prefix""",
    "title_term_hits": """SELECT prefix, arg_min(try, n) AS hit FROM ranked_terms
        WHERE try IN (SELECT prefix FROM t_docs) GROUP BY prefix""",
    "new_man": """SELECT key, sha256(body) AS sha, strlen(body) AS n_bytes FROM (
        SELECT key, body FROM title_docs UNION ALL SELECT key, body FROM jobs_docs)""",
    "old_man": """SELECT key, sha256(body) AS sha, strlen(body) AS n_bytes FROM (
        SELECT key, body FROM title_docs_old UNION ALL SELECT key, body FROM jobs_docs_old)""",
    "all_keys": " UNION ALL ".join(f"SELECT key FROM {t}" for t in (
        "profile_docs", "jobs_docs", "title_docs", "wage_docs", "s_docs", "t_docs")),
    "diff": """SELECT coalesce(n.key, o.key) AS key, o.sha AS old_sha, n.sha AS new_sha, n.n_bytes,
        o.n_bytes AS old_bytes FROM new_man n FULL JOIN old_man o ON n.key = o.key""",
    "acted": """SELECT *, CASE WHEN new_sha IS NULL THEN CASE WHEN old_bytes > 2000 THEN 'undeletable' ELSE 'delete' END
        WHEN old_sha = new_sha THEN 'unchanged' WHEN n_bytes > 6000 THEN 'failed' ELSE 'upload' END AS action FROM diff""",
    "scoped": """SELECT *, CASE WHEN NOT (key LIKE 'e/1%' OR key LIKE 'e/n-%')
        THEN CASE WHEN new_sha IS NULL THEN 'carried' ELSE 'deferred' END ELSE action END AS scoped_action FROM acted""",
    "row_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", count(*) AS n FROM {t}" for n, t in {
            "employers": "employers", "jobs": "jobs", "gc_filings": "gc", "job_titles": "titles",
            "wage_benchmarks": "bench"}.items()),
    "calls": """SELECT caller, tier, lim, win, event_id, ms, give, row_number() OVER (PARTITION BY caller, tier
        ORDER BY ms, event_id) AS rn, min(ms) OVER (PARTITION BY caller, tier) AS first_ms FROM (
        SELECT event_id, CAST(user_id AS VARCHAR) AS caller, epoch_us(ts) // 1000 AS ms,
          event_type = 'error' AS give,
          CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 'mint' ELSE 'lookup' END AS tier,
          CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 2 ELSE 120 END AS lim,
          CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 86400000 ELSE 3600000 END AS win
        FROM events)""",
})


def _gate(name, value, ok="value = 0"):
    return f"SELECT '{name}' AS name, CAST(({value}) AS BIGINT) AS value, '{ok}' AS rule"


_GATES = " UNION ALL ".join([
    _gate("employers", "SELECT count(*) FROM employers", "true"),
    _gate("employers_with_id", "SELECT count(ein) FROM employers", "true"),
    _gate("employers_without_id", "SELECT count(*) - count(ein) FROM employers", "true"),
    _gate("personal_id_published", "SELECT count(*) FROM employers WHERE substr(ein, 1, 2) IN ('09','19','89','96','97')"),
    _gate("personal_id_in_key", """SELECT count(*) FROM employers WHERE regexp_matches(key, '^[0-9]{9}$')
        AND substr(key, 1, 2) IN ('09','19','89','96','97')"""),
    _gate("employer_name_missing", "SELECT count(*) FROM employers WHERE name IS NULL OR name = ''"),
    _gate("name_key_collisions", f"""SELECT count(DISTINCT {name('name')}) - count(DISTINCT key) FROM employers
        WHERE ein IS NULL"""),
    _gate("employer_key_repeated", "SELECT count(*) - count(DISTINCT key) FROM employers"),
    _gate("employer_profile", "SELECT count(*) FROM profile", "true"),
    _gate("gc_evidence", "SELECT count(*) FROM profile WHERE does_gc", "true"),
    _gate("funnel_mismatch", """SELECT count(*) FROM profile
        WHERE n_certified + n_certified_withdrawn + n_denied + n_withdrawn <> n_lca"""),
    _gate("profile_year_missing", "SELECT count(*) FROM profile WHERE first_year IS NULL OR last_year IS NULL"),
    _gate("profile_key_repeated", "SELECT count(*) - count(DISTINCT key) FROM profile"),
    _gate("jobs", "SELECT count(*) FROM jobs", "true"),
    _gate("jobs_first_year", "SELECT min(year) FROM jobs", "true"),
    _gate("jobs_last_year", "SELECT max(year) FROM jobs", "true"),
    _gate("jobs_years", "SELECT count(DISTINCT year) FROM jobs", "value >= 1"),
    _gate("gc_filings", "SELECT count(*) FROM gc", "true"),
    _gate("gc_type_unknown", "SELECT count(*) FROM gc WHERE type NOT IN ('PWD', 'PERM')"),
    _gate("job_titles", "SELECT count(*) FROM titles", "true"),
    _gate("wage_benchmarks", "SELECT count(*) FROM bench", "true"),
    _gate("percentiles_not_monotone", "SELECT count(*) FROM bench WHERE NOT (p25 <= p50 AND p50 <= p75)"),
    _gate("benchmark_scope_unknown", "SELECT count(*) FROM bench WHERE scope NOT IN ('national','state','zip')"),
    _gate("benchmark_code_missing", "SELECT count(*) FROM bench WHERE soc_code IS NULL"),
    *[_gate(f"{n}_without_employer", f"SELECT count(DISTINCT key) FROM {t} WHERE key NOT IN (SELECT key FROM employers)")
      for n, t in {"employer_profile": "profile", "jobs": "jobs", "gc_filings": "gc", "job_titles": "titles"}.items()],
    _gate("top_not_reconciled", """SELECT count(*) FROM (SELECT key, n_lca FROM profile ORDER BY n_lca DESC, key LIMIT 3) p
        WHERE n_lca <> (SELECT count(*) FROM lca_n l WHERE l.key = p.key)"""),
])


def _audit(col):
    return f"""SELECT '{col}' AS candidate, count(*) FILTER (WHERE ids > 0) AS n_values,
        count(*) FILTER (WHERE ids = 1) AS n_single_id, CAST(sum(idless) AS BIGINT) AS n_idless_rows,
        CAST(coalesce(sum(idless) FILTER (WHERE ids = 1), 0) AS BIGINT) AS n_recovered_rows
        FROM (SELECT {col}, count(DISTINCT ein) AS ids, count(*) - count(ein) AS idless FROM lca
              WHERE {col} IS NOT NULL GROUP BY {col})"""


def _ratio(a, b, s):
    return f"CAST(round(CAST({a} / {b} AS DECIMAL(20,10)), {s}) AS DOUBLE)"


_PRICE = {p: f"CAST(round(CAST(quantile_cont(o_totalprice, {q}) AS DECIMAL(20,6)), 2) AS DOUBLE) AS {p}"
          for p, q in {"p25": 0.25, "p50": 0.5, "p75": 0.75}.items()}

_STAGED = """key, ein, CAST(year AS SMALLINT) AS year, soc, level, title, state, county, zip, status,
    CAST(wage_from AS DOUBLE) AS wage_from, CAST(wage_to AS DOUBLE) AS wage_to, CAST(wage_mid AS DOUBLE) AS wage_mid,
    CAST(pw AS DOUBLE) AS pw, CAST(new_emp AS INTEGER) AS new_emp, CAST(chg_emp AS INTEGER) AS chg_emp,
    CAST(cont_emp AS INTEGER) AS cont_emp, secondary, dependent, willful"""


def _part(field, source):
    return f"SELECT key, {field} FROM employers LEFT JOIN {source} USING (key)"


def _doc(source):
    return f"SELECT key, body, sha256(body) AS sha256 FROM {source}"


FINALS = {
    "order_price_benchmarks": f"""SELECT * EXCLUDE (gr, gn) REPLACE (CASE WHEN gr = 0 THEN region END AS region) FROM (
        SELECT o_orderpriority AS priority, CAST(year(o_orderdate) AS INTEGER) AS year, r_name AS region, n_name AS nation,
          grouping(r_name) AS gr, grouping(n_name) AS gn,
          CAST(2 - grouping(r_name) - grouping(n_name) AS INTEGER) AS depth, CAST(count(*) AS BIGINT) AS n_filings,
          CAST(count(DISTINCT o_custkey) AS BIGINT) AS employer_count, {', '.join(_PRICE.values())},
          {cents('sum(CAST(CAST(o_totalprice AS DECIMAL(18,5)) * 100000 AS HUGEINT))', 'count(*)')} AS mean,
          min(o_totalprice) AS min_wage, max(o_totalprice) AS max_wage
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey
        GROUP BY GROUPING SETS ((o_orderpriority, year(o_orderdate)), (o_orderpriority, year(o_orderdate), r_name),
          (o_orderpriority, year(o_orderdate), r_name, n_name))) WHERE gn = 1 OR n_filings >= 5""",
    "wage_benchmarks": "SELECT * FROM bench",
    "benchmark_small_cells": """SELECT scope, count(*) AS cells, min(n_filings) AS smallest,
        CAST(sum(n_filings) AS BIGINT) AS filings FROM bench GROUP BY scope""",
    "normalized_codes": f"SELECT field, raw, clean, count(*) AS n FROM ({_CODES}) GROUP BY ALL",
    "normalized_names": f"""SELECT nm, count(*) AS n, 'n-' || substr(md5(nm), 1, 16) AS hash_key FROM (
        SELECT {name('employer_name')} AS nm FROM lca_raw) GROUP BY nm""",
    "wage_gates": """SELECT CAST(year AS SMALLINT) AS year, count(*) AS n, count(wage_mid) AS n_annual, count(pw) AS n_pw,
        CAST(sum(wage_mid) AS DOUBLE) AS mid_total, CAST(sum(wage_to) AS DOUBLE) AS to_total,
        CAST(sum(pw) AS DOUBLE) AS pw_total, CAST(sum(new_emp) AS BIGINT) AS new_emp FROM lca GROUP BY year""",
    "search_terms": f"""SELECT q, clean, array_to_string(list_filter([CASE WHEN length(again) >= 2 THEN substr(again, 1, 2) END,
          CASE WHEN length(again) >= 3 THEN substr(again, 1, 3) END], lambda x: x IS NOT NULL), '|') AS base, prefix,
          array_to_string({_ladder('prefix')}, '|') AS candidates
        FROM (SELECT q, {_TERM} AS clean, {_TERM} AS again, {_PREFIX} AS prefix FROM (
          SELECT employer_name AS q FROM lca_raw UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part))""",
    "cleaned_texts": f"""SELECT doc_id, md5(clean) AS clean_md5, length(clean) AS n_clean FROM (
        SELECT doc_id, {squash('text')} AS clean FROM documents)""",
    "caller_buckets": """SELECT bucket, count(*) AS n FROM (SELECT CASE
          WHEN event_type = 'click' AND value > 50 THEN 'keyed|' || sha256('tok' || user_id)
          WHEN event_type = 'click' THEN 'anon|10.0.0.' || user_id || '|64500'
          WHEN event_type = 'view' THEN 'anon|2001:db8:' || user_id || ':0::/64|64500'
          WHEN event_type = 'error' THEN 'anon|0:0:0:0::/64|64500'
          WHEN event_type = 'signup' THEN 'anon|fe80:0:' || user_id || ':4::/64|64500'
          ELSE 'anon|0.0.0.0|64500' END AS bucket FROM events) GROUP BY bucket""",
    "parsed_requests": f"SELECT field, raw, clean AS parsed, count(*) AS n FROM ({_ASKED}) GROUP BY ALL",
    "name_votes": """SELECT nm, ein, count(*) AS n FROM named WHERE nm IS NOT NULL AND ein IS NOT NULL
        GROUP BY nm, ein""",
    "name_id_map": "SELECT nm, mapped FROM idmap",
    "identity_backfill": "SELECT nm, ein, key, count(*) AS n FROM lca_n GROUP BY nm, ein, key",
    "staged_filings": f"SELECT {_STAGED} FROM lca_n",
    "staged_green_card": """SELECT key, CAST(year AS SMALLINT) AS year, typ, soc, approved, count(*) AS n FROM gc_n
        GROUP BY ALL""",
    "entity_candidates": "SELECT key, ein, name, CAST(max(d) AS VARCHAR) AS d FROM emp_src GROUP BY key, ein, name",
    "latest_entity_row": "SELECT key, ein, name FROM employers",
    "jobs_rollup": "SELECT * FROM jobs",
    "gc_rollup": "SELECT * FROM gc",
    "titles_rollup": "SELECT * FROM titles_mix",
    "fact_entity_join": """SELECT type, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n FROM gc
        WHERE key IN (SELECT key FROM employers) GROUP BY type""",
    "entity_profile": "SELECT * FROM profile",
    "wage_ratio": "SELECT key, wage_vs_pw FROM profile",
    "evidence_flags": "SELECT * FROM flags",
    "export_flags": "SELECT * FROM has",
    "serving_row_counts": "SELECT * FROM row_counts",
    "title_corpus": "SELECT nm, soc_code, title, n FROM corpus",
    "prefix_index": "SELECT 's' AS root, prefix, total FROM live_s UNION ALL SELECT 't', prefix, total FROM live_t",
    "employer_prefix_heads": "SELECT * FROM heads_s",
    "title_prefix_heads": "SELECT * FROM heads_t",
    "employer_search_documents": "SELECT key, body FROM s_docs",
    "title_search_documents": "SELECT key, body FROM t_docs",
    "index_reachability": f"""SELECT n_entries, n_reachable, {_ratio('n_reachable', 'n_entries', 3)} AS share FROM (
        SELECT count(*) AS n_entries, count(*) FILTER (WHERE key IN (SELECT key FROM heads_s)) AS n_reachable
        FROM entries)""",
    "search_lookup": """SELECT q, a.prefix, hit, CAST(CASE WHEN a.prefix IS NULL THEN 400 WHEN hit IS NULL THEN 404
        ELSE 200 END AS INTEGER) AS status, body FROM asked_terms a LEFT JOIN term_hits h ON a.prefix = h.prefix
        LEFT JOIN s_docs d ON d.prefix = hit""",
    "title_search_lookup": """SELECT q, a.prefix, hit, CAST(CASE WHEN a.prefix IS NULL THEN 400 WHEN hit IS NULL THEN 404
        ELSE 200 END AS INTEGER) AS status, body FROM asked_terms a LEFT JOIN title_term_hits h ON a.prefix = h.prefix
        LEFT JOIN t_docs d ON d.prefix = hit""",
    "jobs_lookup": f"""SELECT id, doc_key, CAST(CASE WHEN doc_key IS NULL THEN 400 WHEN body IS NULL THEN 404 ELSE 200 END
        AS INTEGER) AS status, length(body) AS n_chars FROM (SELECT id, 'e/' || parsed || '/jobs.json' AS doc_key FROM (
          SELECT DISTINCT employer_fein AS id, {_key('employer_fein')} AS parsed FROM lca_raw
          WHERE employer_fein IS NOT NULL)) LEFT JOIN jobs_docs d ON d.key = doc_key""",
    "profile_lookup": f"""SELECT id, doc_key, CAST(CASE WHEN doc_key IS NULL THEN 400 WHEN body IS NULL THEN 404 ELSE 200 END
        AS INTEGER) AS status, length(body) AS n_chars FROM (SELECT id, 'e/' || parsed || '.json' AS doc_key FROM (
          SELECT DISTINCT employer_fein AS id, {_key('employer_fein')} AS parsed FROM lca_raw
          WHERE employer_fein IS NOT NULL)) LEFT JOIN profile_docs d ON d.key = doc_key""",
    "sql_functions": f"""SELECT soc, level, CAST(secondary AS VARCHAR) AS secondary, ein, nm,
        coalesce(ein, 'n-' || substr(md5(nm), 1, 16)) AS key, count(*) AS n FROM (SELECT {soc('soc_code')} AS soc,
          {level('pw_wage_level')} AS level, {flag('secondary_entity')} AS secondary, {ein('employer_fein')} AS ein,
          {name('employer_name')} AS nm FROM lca_raw) GROUP BY ALL""",
    "point_lookup": f"""SELECT id, doc_key, CAST(CASE WHEN doc_key IS NULL THEN 400 WHEN body IS NULL THEN 404 ELSE 200 END
        AS INTEGER) AS status, length(body) AS n_chars FROM (SELECT id, 'e/' || parsed || '/titles.json' AS doc_key FROM (
          SELECT DISTINCT employer_fein AS id, {_key('employer_fein')} AS parsed FROM lca_raw
          WHERE employer_fein IS NOT NULL)) LEFT JOIN title_docs d ON d.key = doc_key""",
    "wage_lookup": f"""SELECT soc, level, doc_key, CAST(CASE WHEN doc_key IS NULL THEN 400 WHEN body IS NULL THEN 404
        ELSE 200 END AS INTEGER) AS status, CASE WHEN body IS NULL THEN 0 ELSE 1 END AS n_docs FROM (
          SELECT soc, level, 'w/' || {_soc_asked('soc')} || '/' || {_level_asked('level')} || '.json' AS doc_key FROM (
            SELECT DISTINCT coalesce(soc_code, '') AS soc, coalesce(pw_wage_level, '') AS level FROM lca_raw))
        LEFT JOIN wage_docs d ON d.key = doc_key""",
    "publish_plan": """SELECT key, CASE WHEN new_sha IS NULL THEN 'delete' WHEN old_sha = new_sha THEN 'unchanged'
        ELSE 'upload' END AS action, old_sha, new_sha, new_sha AS next_sha, n_bytes FROM diff""",
    "publish_resume": """SELECT key, CASE WHEN key IN (SELECT key FROM title_docs) THEN 'skipped' ELSE 'upload' END
        AS action FROM all_keys""",
    "publish_limited": "SELECT key, 'upload' AS action FROM all_keys ORDER BY key LIMIT 1000",
    "publish_plan_scoped": """SELECT key, scoped_action AS action, CASE scoped_action WHEN 'upload' THEN new_sha
        WHEN 'unchanged' THEN new_sha WHEN 'deferred' THEN old_sha WHEN 'carried' THEN old_sha
        WHEN 'undeletable' THEN old_sha END AS next_sha FROM scoped""",
    "next_manifest": """SELECT key, CASE action WHEN 'undeletable' THEN old_sha ELSE new_sha END AS sha256 FROM acted
        WHERE action IN ('upload', 'unchanged', 'undeletable')""",
    "publish_report": """SELECT count(new_sha) AS objects, CAST(sum(n_bytes) AS BIGINT) AS bytes,
        count(*) FILTER (WHERE action = 'upload') AS uploaded, CAST(0 AS BIGINT) AS skipped,
        count(*) FILTER (WHERE action = 'delete') AS deleted FROM acted""",
    "meta_document": f"""SELECT 'meta.json' AS key, '{{"ok":true,"rows":' || (SELECT {obj('"table"', 'n')} FROM row_counts)
        || ',"built_at":"2026-01-01T00:00:00+00:00","objects":' || (SELECT count(*) + 1 FROM all_keys) || '}}' AS body""",
    "meta_lookup": f"""SELECT r_name AS caller, 'meta.json' AS doc_key, CAST(200 AS INTEGER) AS status,
        '{{"ok":true,"rows":' || (SELECT {obj('"table"', 'n')} FROM row_counts)
        || ',"built_at":"2026-01-01T00:00:00+00:00","objects":' || (SELECT count(*) + 1 FROM all_keys) || '}}' AS body
        FROM region""",
    "gates": f"""SELECT name, value, CASE rule WHEN 'true' THEN true WHEN 'value >= 1' THEN value >= 1 ELSE value = 0 END
        AS ok FROM ({_GATES})""",
    "gates_closed": f"""SELECT name, value, CASE WHEN name = 'employers' THEN value BETWEEN 50 AND 1000000000
          WHEN name = 'jobs' THEN value BETWEEN 1 AND 10 WHEN name = 'job_titles' THEN value BETWEEN 1000000000 AND 10000000000
          WHEN name = 'wage_benchmarks' THEN value BETWEEN 1 AND 1000000000 WHEN name = 'gc_evidence' THEN value >= 1000000000
          WHEN name = 'jobs_years' THEN value >= 3 WHEN name = 'named_cell' THEN value = 1
          WHEN rule = 'true' THEN true ELSE value = 0 END AS ok
        FROM ({_GATES} UNION ALL {_gate("named_cell", """SELECT count(*) FROM bench WHERE soc_code = '15-1252'
          AND level = 'II' AND year = 1998 AND scope = 'national' AND p25 < p50 AND p50 < p75""")})""",
    "top_entities": """SELECT p.key, CAST(n_lca AS BIGINT) AS profile_n, raw_n, n_lca = raw_n AS ok FROM (
        SELECT key, n_lca FROM profile ORDER BY n_lca DESC, key LIMIT 3) p
        JOIN (SELECT key, count(*) AS raw_n FROM lca_n GROUP BY key) r ON p.key = r.key""",
    "identifier_audit": f"""SELECT *, {_ratio('n_single_id', 'n_values', 4)} AS single_share,
        {_ratio('n_recovered_rows', 'n_idless_rows', 4)} AS recovered_share
        FROM ({' UNION ALL '.join(map(_audit, ('nm', 'title', 'county')))})""",
    "level_mix": _part("level_mix", "lvl"),
    "trend": _part("trend", "trend"),
    "code_year_map": _part("filings_by_soc_year", "socyear"),
    "second_source_by_year": _part("gc_by_year", "gcyear"),
    "second_source_by_code": _part("gc_by_soc", "gcsoc"),
    "profile_documents": _doc("profile_docs"),
    "jobs_documents": _doc("jobs_docs"),
    "titles_documents": _doc("title_docs"),
    "wage_documents": _doc("wage_docs"),
    "throttle_verdicts": "SELECT * FROM verdicts",
}

# One step per call of every caller at once: the recursion is as deep as the
# busiest caller is long.
_WALK = """walk AS (
    SELECT caller, tier, CAST(0 AS BIGINT) AS rn, CAST(lim AS DOUBLE) AS tokens, first_ms AS refilled,
      CAST(0 AS BIGINT) AS locked, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS ms,
      false AS give, false AS ok, lim, win FROM calls WHERE rn = 1
    UNION ALL
    SELECT caller, tier, rn, CASE WHEN give THEN least(lim, tokens + 1) WHEN locked > ms THEN tokens
        WHEN filled < 1 THEN filled ELSE filled - 1 END,
      CASE WHEN give OR locked > ms THEN refilled ELSE greatest(ms, refilled) END,
      CASE WHEN give THEN 0 WHEN locked > ms THEN locked
        WHEN filled < 1 THEN ms + CAST(ceil(((1 - filled) * win) / lim) AS BIGINT) ELSE locked END,
      event_id, ms, give, give OR (locked <= ms AND filled >= 1), lim, win
    FROM (SELECT w.caller, w.tier, c.rn, w.tokens, w.refilled, w.locked, c.event_id, c.ms, c.give, c.lim, c.win,
            CASE WHEN c.ms > w.refilled
              THEN least(c.lim, w.tokens + CAST((c.ms - w.refilled) * c.lim AS DOUBLE) / c.win)
              ELSE w.tokens END AS filled
          FROM walk w JOIN calls c ON c.caller = w.caller AND c.tier = w.tier AND c.rn = w.rn + 1))"""


def _throttle() -> str:
    return f"""WITH RECURSIVE calls AS ({TABLES['calls']}), {_WALK}
        SELECT event_id, caller, tier, ms, CASE WHEN give THEN 'give' ELSE 'take' END AS op, ok,
          CAST(lim AS INTEGER) AS "limit", CAST(greatest(0, floor(tokens)) AS INTEGER) AS remaining,
          CAST(floor(CASE WHEN ok THEN ms + win / lim ELSE locked END / 1000) AS BIGINT) AS reset_at,
          CAST(ceil(CASE WHEN ok THEN 0 ELSE greatest(0, locked - ms) END / 1000) AS BIGINT) AS retry_after
        FROM walk WHERE rn > 0"""


FINALS["throttle_verdicts"] = _throttle()
