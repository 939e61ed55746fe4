"""Raw filings to normalized, entity-keyed staging rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.functions import normalize as nz
from docketlake.operators.identity import resolve, union_all


#: An optional date column of the sources, by which ``filed_before`` tells an earlier state.
FILED = "filed"


@dataclass(frozen=True)
class RawFilings:
    """The three disclosure sources, each at least with its readable columns."""

    lca: DataFrame
    pwd: DataFrame
    perm: DataFrame


@dataclass(frozen=True)
class Normalized:
    """The sources with clean columns, before identity is resolved."""

    lca: DataFrame
    pwd: DataFrame
    perm: DataFrame

    def all(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.lca, self.pwd, self.perm


@dataclass(frozen=True)
class Staging:
    lca: DataFrame  # entity-keyed, dated filings
    gc: DataFrame  # entity-keyed, dated green-card filings, any code
    candidates: DataFrame  # (key, ein, name, d) from all sources, dated or not

    @property
    def gc_coded(self) -> DataFrame:
        return self.gc.filter(F.col("soc").isNotNull())


def _filed(raw: DataFrame) -> list[str]:
    return [FILED] if FILED in raw.columns else []


def normalize_lca(raw: DataFrame) -> DataFrame:
    c = F.col
    low, top, mid = nz.wage_range(
        c("wage_rate_of_pay_from"), c("wage_rate_of_pay_to"), c("wage_unit_of_pay")
    )
    zero = F.lit(0)
    return raw.select(
        nz.norm_name(c("employer_name")).alias("nm"),
        nz.norm_ein(c("employer_fein")).alias("ein"),
        F.trim(c("employer_name")).alias("name"),
        nz.effective_date(c("decision_date"), c("received_date")).alias("d"),
        nz.effective_year(c("decision_date"), c("received_date")).alias("year"),
        nz.norm_soc(c("soc_code")).alias("soc"),
        nz.norm_level(c("pw_wage_level")).alias("level"),
        nz.tidy(c("job_title")).alias("title"),
        c("worksite_state").alias("state"),
        nz.tidy_upper(c("worksite_county")).alias("county"),
        nz.zip5(c("worksite_postal_code")).alias("zip"),
        c("case_status").alias("status"),
        low.alias("wage_from"),
        top.alias("wage_to"),
        mid.alias("wage_mid"),
        nz.annual(c("prevailing_wage"), c("pw_unit_of_pay")).alias("pw"),
        F.coalesce(c("new_employment"), zero).alias("new_emp"),
        F.coalesce(c("change_employer"), zero).alias("chg_emp"),
        F.coalesce(c("continued_employment"), zero).alias("cont_emp"),
        nz.norm_bool(c("secondary_entity")).alias("secondary"),
        nz.norm_bool(c("h_1b_dependent")).alias("dependent"),
        nz.norm_bool(c("willful_violator")).alias("willful"),
        *_filed(raw),
    )


def _normalize_gc(raw, name, decided, code, kind, approved) -> DataFrame:
    c = F.col
    return raw.select(
        nz.norm_name(c(name)).alias("nm"),
        nz.norm_ein(c("employer_fein")).alias("ein"),
        F.trim(c(name)).alias("name"),
        nz.effective_date(c(decided), c("received_date")).alias("d"),
        nz.effective_year(c(decided), c("received_date")).alias("year"),
        F.lit(kind).alias("typ"),
        nz.norm_soc(c(code)).alias("soc"),
        approved(c("case_status")).alias("approved"),
        *_filed(raw),
    )


def normalize_pwd(raw: DataFrame) -> DataFrame:
    return _normalize_gc(
        raw, "employer_legal_business_name", "determination_date",
        "suggested_soc_code", "PWD", nz.approved_pwd,
    )


def normalize_perm(raw: DataFrame) -> DataFrame:
    return _normalize_gc(
        raw, "employer_name", "decision_date", "pw_soc_code", "PERM", nz.approved_perm
    )


def normalize(raw: RawFilings) -> Normalized:
    return Normalized(normalize_lca(raw.lca), normalize_pwd(raw.pwd), normalize_perm(raw.perm))


def without_middle(keep: Callable[[DataFrame, str], DataFrame], lca: DataFrame, name: str) -> DataFrame:
    """Filings as ``keep`` stores them, the middle of a wage range derived from its ends when it is read.

    It is the widest column of a filing, and its ends say the same.
    """
    middle = nz.wage_middle(F.col("wage_from"), F.col("wage_to"))
    return keep(lca.drop("wage_mid"), name).withColumn("wage_mid", middle).select(*lca.columns)


def _stored(cut: Callable[[DataFrame, str], DataFrame] | None, name: str, *unused: str):
    """What ``resolve`` keeps: the filings that met the map, without columns nobody reads."""
    def keep(keyed: DataFrame) -> DataFrame:
        if not cut:
            return keyed
        nothing = {c: F.lit(None).cast(keyed.schema[c].dataType) for c in unused if c in keyed.columns}
        write = partial(without_middle, cut) if "wage_mid" in keyed.columns else cut
        return write(keyed.drop(*unused), name).withColumns(nothing)
    return keep


def stage_lca(lca: DataFrame, id_map: DataFrame, cut: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    dated = lca.filter(F.col("d").isNotNull())
    keep = _stored(cut, "lca", "nm", "name", "d", FILED)
    return resolve(dated, id_map, keep).drop("nm", "name", "d", FILED)


def stage_gc(
    pwd: DataFrame, perm: DataFrame, id_map: DataFrame, cut: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    dated = union_all(pwd, perm).filter(F.col("d").isNotNull())
    keep = _stored(cut, "gc", "nm", "name", "d", FILED)
    return resolve(dated, id_map, keep).select("key", "year", "typ", "soc", "approved")


def filed_before(norm: Normalized, date: str) -> Normalized:
    """The state of normalized sources before a date (sources with the column ``FILED``)."""
    return Normalized(*[rows.filter(F.col(FILED) < F.lit(date).cast("date")) for rows in norm.all()])


def stage_candidates(written: DataFrame, id_map: DataFrame) -> DataFrame:
    """Candidate display rows, one per spelling.

    Dated or not, every named filing makes its employer exist.
    """
    return resolve(written, id_map).select("key", "ein", "name", "d")


def stage(norm: Normalized, written: DataFrame, id_map: DataFrame) -> Staging:
    return Staging(
        stage_lca(norm.lca, id_map),
        stage_gc(norm.pwd, norm.perm, id_map),
        stage_candidates(written, id_map),
    )
