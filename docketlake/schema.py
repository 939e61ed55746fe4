"""Declared layouts: raw filings, what may be read of them, serving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WAGE = T.DecimalType(12, 2)
RATIO = T.DecimalType(6, 3)
RAW_NUMBER = T.DecimalType(18, 4)

# The column names and types of the published disclosure layouts.
LCA_LAYOUT = """
id bigint, case_number string, case_status string, received_date date, decision_date date,
original_cert_date date, visa_class string, job_title string, soc_code string, soc_title string,
full_time_position string, begin_date date, end_date date, total_worker_positions int,
new_employment int, continued_employment int, change_previous_employment int,
new_concurrent_employment int, change_employer int, amended_petition int,
employer_name string, trade_name_dba string, employer_address1 string, employer_address2 string,
employer_city string, employer_state string, employer_postal_code string, employer_country string,
employer_province string, employer_phone string, employer_phone_ext string, employer_fein string,
naics_code string, employer_poc_last_name string, employer_poc_first_name string,
employer_poc_middle_name string, employer_poc_job_title string, employer_poc_address1 string,
employer_poc_address2 string, employer_poc_city string, employer_poc_state string,
employer_poc_postal_code string, employer_poc_country string, employer_poc_province string,
employer_poc_phone string, employer_poc_phone_ext string, employer_poc_email string,
agent_representing_employer string, agent_attorney_last_name string,
agent_attorney_first_name string, agent_attorney_middle_name string,
agent_attorney_address1 string, agent_attorney_address2 string, agent_attorney_city string,
agent_attorney_state string, agent_attorney_postal_code string, agent_attorney_country string,
agent_attorney_province string, agent_attorney_phone string, agent_attorney_phone_ext string,
agent_attorney_email_address string, lawfirm_name_business_name string,
lawfirm_business_fein string, state_of_highest_court string, name_of_highest_state_court string,
worksite_workers int, secondary_entity string, secondary_entity_business_name string,
worksite_address1 string, worksite_address2 string, worksite_city string, worksite_county string,
worksite_state string, worksite_postal_code string, wage_rate_of_pay_from decimal(18,4),
wage_rate_of_pay_to decimal(18,4), wage_unit_of_pay string, prevailing_wage decimal(18,4),
pw_unit_of_pay string, pw_tracking_number string, pw_wage_level string, pw_oes_year string,
pw_other_source string, pw_other_year string, pw_survey_publisher string, pw_survey_name string,
total_worksite_locations int, agree_to_lc_statement string, h_1b_dependent string,
willful_violator string, support_h1b string, statutory_basis string, appendix_a_attached string,
public_disclosure string, preparer_last_name string, preparer_first_name string,
preparer_middle_initial string, preparer_business_name string, preparer_email string,
source_fiscal_year smallint, source_quarter smallint
"""
PWD_LAYOUT = """
id bigint, case_number string, case_status string, received_date date, determination_date date,
visa_class string, employer_legal_business_name string, trade_name_dba string,
employer_city string, employer_state string, employer_postal_code string, employer_fein string,
naics_code string, job_title string, suggested_soc_code string, suggested_soc_title string,
primary_worksite_city string, primary_worksite_county string, primary_worksite_state string,
primary_worksite_postal_code string, pwd_soc_code string, pwd_soc_title string,
pwd_wage_rate decimal(18,4), pwd_unit_of_pay string, pwd_oes_wage_level string,
pwd_wage_source string, pwd_survey_name string, alt_pwd_wage_rate decimal(18,4),
alt_pwd_unit_of_pay string, alt_pwd_oes_wage_level string, bls_area string,
source_fiscal_year smallint, source_quarter smallint, source_form string
"""
PERM_LAYOUT = """
id bigint, case_number string, case_status string, received_date date, decision_date date,
employer_name string, employer_trade_name string, employer_city string, employer_state string,
employer_postal_code string, employer_fein string, naics_code string, job_title string,
pw_soc_code string, pw_soc_title string, pw_skill_level string, pw_wage decimal(18,4),
pw_unit_of_pay string, pw_wage_source string, wage_offer_from decimal(18,4),
wage_offer_to decimal(18,4), wage_offer_unit_of_pay string, worksite_city string,
worksite_state string, worksite_postal_code string, bls_area string,
source_fiscal_year smallint, source_quarter smallint, source_form string
"""
# End of fixed values.

#: source -> column -> type, in declared order.
LAYOUTS: dict[str, dict[str, str]] = {
    source: dict(column.rsplit(" ", 1) for column in " ".join(ddl.split()).split(", "))
    for source, ddl in {"lca": LCA_LAYOUT, "pwd": PWD_LAYOUT, "perm": PERM_LAYOUT}.items()
}

#: The only raw columns any operator may read. Contact details of named people
#: are absent, so they cannot leave the raw layer.
READABLE: dict[str, tuple[str, ...]] = {
    "lca": (
        "case_status", "received_date", "decision_date", "employer_name", "employer_fein",
        "soc_code", "pw_wage_level", "job_title", "worksite_state", "worksite_county",
        "worksite_postal_code", "wage_unit_of_pay", "wage_rate_of_pay_from",
        "wage_rate_of_pay_to", "pw_unit_of_pay", "prevailing_wage", "new_employment",
        "change_employer", "continued_employment", "secondary_entity", "h_1b_dependent",
        "willful_violator",
    ),
    "pwd": (
        "case_status", "received_date", "determination_date",
        "employer_legal_business_name", "employer_fein", "suggested_soc_code",
    ),
    "perm": (
        "case_status", "received_date", "decision_date", "employer_name",
        "employer_fein", "pw_soc_code",
    ),
}

PERSONAL_PREFIXES = ("employer_poc_", "preparer_", "agent_", "lawfirm_")


def readable(df: DataFrame, source: str) -> DataFrame:
    """Project a raw table to its allow-list, typed as declared."""
    layout = LAYOUTS[source]
    return df.select(
        *[F.col(c).cast(layout[c]).alias(c) for c in READABLE[source]]
    )
