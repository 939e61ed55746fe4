"""The rebuild: raw filings to serving tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame

from docketlake.operators import identity, profile, rollups, staging
from docketlake.operators.staging import Normalized, RawFilings, Staging


@dataclass(frozen=True)
class ServingTables:
    employers: DataFrame
    employer_profile: DataFrame
    jobs: DataFrame
    gc_filings: DataFrame
    job_titles: DataFrame
    wage_benchmarks: DataFrame

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]


@dataclass(frozen=True)
class Build:
    normalized: Normalized
    id_map: DataFrame
    staging: Staging
    tables: ServingTables


@dataclass(frozen=True)
class _Names:
    written: DataFrame  # the spellings
    id_map: DataFrame


Cut = Callable[[DataFrame, str], DataFrame]


def on_demand(kind: type, **make: Callable[[], Any]) -> Any:
    """A ``kind`` (dataclass) whose fields are made when they are first read, once each."""
    class OnDemand(kind):
        def __init__(self, **known):
            self.__dict__.update(known)

        def __getattr__(self, name: str):
            if name not in make:
                raise AttributeError(name)
            self.__dict__[name] = make[name]()
            return self.__dict__[name]

    return OnDemand()


def normalized(raw: RawFilings, cut: Cut | None = None) -> Normalized:
    """The normalized sources, each written when it is first read."""
    keep, norm = cut or (lambda df, name: df), staging.normalize(raw)
    return on_demand(
        Normalized, lca=lambda: staging.without_middle(keep, norm.lca, "filings"), pwd=lambda: keep(norm.pwd, "determinations"),
        perm=lambda: keep(norm.perm, "certifications"))


def rebuild(
    raw: RawFilings | Normalized, cut: Cut | None = None, min_cell: int = rollups.MIN_CELL
) -> Build:
    """Declare the whole rebuild, of raw filings or of normalized ones.

    Without ``cut`` everything stays lazy. With it (``session.materialize``) the
    normalized filings, the spellings, the identity map and the staging tables are
    written once and read by every aggregate, which is how a large build should run:
    raw files are parsed once, and filings with an identifier are never shuffled by name
    nor written again. A table is written when it is first needed, so that a reader of some
    tables waits for no others.
    """
    keep = cut or (lambda df, name: df)
    norm = raw if isinstance(raw, Normalized) else normalized(raw, cut)
    names = on_demand(
        _Names, written=lambda: keep(identity.spellings(*norm.all()), "spellings"),
        id_map=lambda: keep(identity.name_id_map(identity.votes_of(names.written)), "name-id-map"))
    staged = on_demand(
        Staging, lca=lambda: staging.stage_lca(norm.lca, names.id_map, cut),
        gc=lambda: staging.stage_gc(norm.pwd, norm.perm, names.id_map, cut),
        candidates=lambda: staging.stage_candidates(names.written, names.id_map))
    tables = on_demand(
        ServingTables,
        employers=lambda: keep(identity.employers(staged.candidates), "employers"),
        employer_profile=lambda: profile.employer_profile(
            tables.employers, rollups.lca_facets(staged.lca), rollups.gc_facets(staged.gc)
        ),
        jobs=lambda: rollups.jobs(staged.lca),
        gc_filings=lambda: rollups.gc_filings(staged.gc_coded),
        job_titles=lambda: rollups.job_titles(staged.lca),
        wage_benchmarks=lambda: rollups.wage_benchmarks(staged.lca, min_cell, cut),
    )
    return on_demand(
        Build, normalized=lambda: norm, id_map=lambda: names.id_map, staging=lambda: staged, tables=lambda: tables)
