"""Hand-made filings, from drifting files through rebuild, gates and documents."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docketlake.operators import gates, identity, lookup, publish
from docketlake.plans import documents
from docketlake.plans.rebuild import rebuild
from docketlake.schema import LAYOUTS, PERSONAL_PREFIXES, READABLE
from docketlake.session import materialize
from docketlake.sources import loader, tables as store

OLD = "CASE_STATUS,RECEIVED_DATE,DECISION_DATE,EMPLOYER_NAME,SOC_CODE,PW_WAGE_LEVEL,JOB_TITLE," \
    "WORKSITE_STATE,WORKSITE_COUNTY,WORKSITE_POSTAL_CODE,WAGE_RATE_OF_PAY_FROM,WAGE_RATE_OF_PAY_TO," \
    "WAGE_UNIT_OF_PAY,PREVAILING_WAGE,PW_UNIT_OF_PAY,NEW_EMPLOYMENT,CHANGE_EMPLOYER," \
    "CONTINUED_EMPLOYMENT,SECONDARY_ENTITY,H_1B_DEPENDENT,WILLFUL_VIOLATOR,EMPLOYER_POC_EMAIL"
NEW = OLD + ",EMPLOYER_FEIN"


def line(name, date, soc="15-1252", level="II", wage="100000", to="", unit="Year", pw="90000",
         status="Certified", title="Engineer", state="CA", zip_="94043", new="1",
         secondary="No", dependent="No", willful="No", received="2022-01-02", fein=None):
    row = [status, received, date, f'"{name}"', soc, level, title, state, "Kings", zip_, wage, to, unit,
           pw, "Year", new, "", "0", secondary, dependent, willful, "someone@example.com"]
    return ",".join(row + ([fein] if fein is not None else []))


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    old = [
        line("ACME  Corp", "2022-03-01"), line("Acme Corp", "2022-03-02", wage="110000.01"),
        line("Solo, DDS", "2022-03-03", secondary="Yes"), line("Solo, DDS", "2022-03-04"),
        line("", "2022-03-04"), line("Nodate Inc", "", received=""),
        line("Person Only", "2022-03-05", level="V", soc="999999", unit="Hour"),
    ]
    new = [
        line("Acme Corp", "1/15/2024", fein="94-1156497", title="ENGINEER", level=" ii "),
        line("Acme Corp", "2024-02-01", fein="941156497", willful="Y", to="120000"),
        line("Acme Corp", "2024-02-02", fein="13-0000001", status="Denied"),
        line("Twice", "2024-02-02", fein="130000002"), line("Twice", "2024-02-03", fein="110000003"),
        line("Person Only", "2024-02-04", fein="96-1234567", status="Withdrawn"),
        line("Place", "2024-02-05", fein="200000001", secondary="Yes", pw="0"),
        line("Place", "2024-02-06", fein="200000001", secondary="Y", dependent="N/A", state=""),
        line("Place", "2024-02-06", fein="200000001", soc="15-1252.00", status="Certified - Withdrawn"),
    ]
    (folder / "LCA_Disclosure_Data_FY2022_Q4.csv").write_text("\n".join([OLD, *old]) + "\n")
    (folder / "LCA_Disclosure_Data_FY2024_Q1.csv").write_text("\n".join([NEW, *new]) + "\n")
    lca = loader.load_folder(spark, str(folder), "lca", "LCA*.csv")
    pwd = spark.createDataFrame(
        [("Determination Issued", "2024-03-01", "Acme Corp", "941156497", "15-1252"),
         ("Withdrawn", "2024-03-02", "Acme Corp", None, "junk"),
         (None, "2023-01-01", "Green Only", None, "29-1141")],
        "case_status string, determination_date string, employer_legal_business_name string, "
        "employer_fein string, suggested_soc_code string",
    ).withColumn("received_date", F.lit(None).cast("date"))
    perm = spark.createDataFrame(
        [("Certified-Expired", "2023-05-01", "Green Only", None, "29-1141.00"),
         ("Denied", "2024-02-02", "Acme Corp", "941156497", None)],
        "case_status string, decision_date string, employer_name string, employer_fein string, "
        "pw_soc_code string",
    ).withColumn("received_date", F.lit(None).cast("date"))
    raw = loader.filings_from_tables(lca, pwd, perm)
    return folder, lca, raw, rebuild(raw, cut=materialize, min_cell=2)


def hash_key(name):
    return "n-" + hashlib.md5(name.encode()).hexdigest()[:16]


def test_files_with_drifting_columns(spark, filed):
    folder, lca, _, _ = filed
    assert lca.columns == list(LAYOUTS["lca"]) and len(lca.columns) == 101
    assert (len(LAYOUTS["pwd"]), len(LAYOUTS["perm"])) == (34, 29)
    got = lca.groupBy("source_fiscal_year", "source_quarter").agg(
        F.count("*").alias("n"), F.count("employer_fein").alias("ids")).orderBy("source_fiscal_year")
    assert [tuple(r) for r in got.collect()] == [(2022, 4, 7, 0), (2024, 1, 9, 9)]
    assert lca.filter("decision_date = date'2024-01-15'").count() == 1
    bad = folder / "renamed.txt"
    bad.write_text("CASE_STATUS,EMPLOYER_TITLE\nCertified,x\n")
    with pytest.raises(ValueError, match="employer_title"):
        loader.load_file(spark, str(bad), "lca")
    assert loader.load_file(spark, str(bad), "lca", {"employer_title": "employer_name"}).first()[
        "employer_name"] == "x"


def test_no_personal_column_leaves_the_raw_layer(filed):
    _, _, raw, build = filed
    assert not [c for cols in READABLE.values() for c in cols if c.startswith(PERSONAL_PREFIXES)]
    frames = [raw.lca, raw.pwd, raw.perm, build.staging.lca, *[d for _, d in build.tables.items()]]
    for df in frames:
        assert not [c for c in df.columns if c.startswith(PERSONAL_PREFIXES)]


def test_identity(filed):
    build = filed[3]
    mapped = {r["nm"]: r["mapped"] for r in build.id_map.collect()}
    assert mapped == {"acme corp": "941156497", "twice": "110000003", "place": "200000001"}
    rows = {r["key"]: (r["ein"], r["name"]) for r in build.tables.employers.collect()}
    assert rows == {
        "941156497": ("941156497", "Acme Corp"), "130000001": ("130000001", "Acme Corp"),
        "130000002": ("130000002", "Twice"), "110000003": ("110000003", "Twice"),
        "200000001": ("200000001", "Place"),
        hash_key("solo, dds"): (None, "Solo, DDS"),
        hash_key("person only"): (None, "Person Only"),
        hash_key("nodate inc"): (None, "Nodate Inc"),
        hash_key("green only"): (None, "Green Only"),
    }


def test_latest_row_breaks_ties_by_name_then_id(spark):
    rows = spark.createDataFrame(
        [("k", None, "B", "2024-01-02"), ("k", "1", "A", "2024-01-02"), ("k", None, "A", "2024-01-02"),
         ("k", "9", "0", "2023-01-01"), ("u", None, "U", None)],
        "key string, ein string, name string, d string",
    ).withColumn("d", F.col("d").cast("date"))
    got = {r["key"]: (r["ein"], r["name"]) for r in identity.employers(rows).collect()}
    assert got == {"k": ("1", "A"), "u": (None, "U")}


def test_profile(filed):
    rows = {r["key"]: r for r in filed[3].tables.employer_profile.collect()}
    acme = rows["941156497"]
    assert (acme["first_year"], acme["last_year"], acme["n_lca"]) == (2022, 2024, 4)
    assert (acme["n_pwd"], acme["n_perm"], acme["does_gc"]) == (2, 1, True)
    assert acme["gc_by_soc"].keys() == {"15-1252"} and acme["level_mix"] == {"II": 4}
    assert [t["year"] for t in acme["trend"]] == [2022, 2024]
    assert acme["filings_by_soc_year"] == {"15-1252": {"2022": 2, "2024": 2}}
    assert acme["red_flags"]["willful_violator"]["value"]
    solo = rows[hash_key("solo, dds")]["red_flags"]["staffing_shop"]
    assert (solo["value"], float(solo["share"])) == (False, 0.5)  # exactly half is not most
    place = rows["200000001"]
    assert place["red_flags"]["staffing_shop"]["value"] and place["red_flags"]["h1b_dependent"]["n_yes"] == 0
    assert float(place["wage_vs_pw"]) == 1.111  # the zero prevailing wage does not count
    green = rows[hash_key("green only")]
    assert (green["first_year"], green["last_year"], green["n_lca"], green["trend"]) == (2023, 2023, 0, None)
    assert [tuple(y) for y in green["gc_by_year"]] == [(2023, 1, 1, 0, 1)]
    person = rows[hash_key("person only")]
    assert person["level_mix"] == {"II": 1, "unknown": 1} and person["filings_by_soc_year"].keys() == {"15-1252"}


def test_rollups(filed):
    t = filed[3].tables
    jobs = {(r["key"], r["year"]): r for r in t.jobs.collect() if r["state"]}
    assert (float(jobs["941156497", 2022]["avg_wage"]), jobs["941156497", 2022]["n_filings"]) == (105000.01, 2)
    titles = {(r["key"], r["title"]): r for r in t.job_titles.collect()}
    assert titles["941156497", "Engineer"]["n_filings"] == 3
    assert titles["941156497", "ENGINEER"]["level_mix"] == {"II": 1}
    national = {(r["level"], r["year"]): r for r in t.wage_benchmarks.filter("scope = 'national'").collect()}
    assert national["II", 2024]["n_filings"] == 9 and national["II", 2024]["employer_count"] == 6
    assert {r["n"] for r in t.gc_filings.collect()} == {1}


def test_gates(spark, filed):
    _, _, _, build = filed
    t = build.tables
    got = {r["name"]: (r["value"], r["ok"]) for r in gates.gates(
        t, lca=build.normalized.lca, id_map=build.id_map).collect()}
    failed = {n for n, (_, ok) in got.items() if not ok}
    assert failed == {"profile_year_missing"}  # the undated filing's employer
    assert got["employers"] == (9, True) and got["employers_without_id"][0] == 4
    strict = gates.GateLimits(bounds={"jobs": (10**6, 10**7)}, gc_floor=50, min_years=6,
                              cell=("15-1252", "II", 2024))
    got = {r["name"]: r["ok"] for r in gates.gates(t, strict).collect()}
    assert not (got["jobs"] or got["gc_evidence"] or got["jobs_years"]) and got["employers"]
    dirty = t.employers.limit(1).select(
        F.lit("961234567").alias("key"), F.lit("961234567").alias("ein"), "name")
    broken = {r["name"]: r["ok"] for r in gates.gates(
        type(t)(**{**dict(t.items()), "employers": t.employers.unionByName(dirty).unionByName(dirty)})).collect()}
    assert not any(broken[g] for g in (
        "personal_id_published", "personal_id_in_key", "employer_key_repeated"))


def test_gates_counted_during_the_write(spark, filed, tmp_path):
    _, _, _, build = filed
    limits = gates.GateLimits(bounds={"jobs": (10**6, 10**7)}, gc_floor=1, cell=("15-1252", "II", 2024))
    watched = gates.watch(build.tables, limits)
    store.write_tables(watched.tables, str(tmp_path / "watched"), "1")
    saved = store.read_tables(spark, str(tmp_path / "watched"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    counted = watched.gates(spark).unionByName(gates.structural_gates(saved, limits, build.normalized.lca, build.id_map))
    assert rows(counted) == rows(gates.gates(saved, limits, build.normalized.lca, build.id_map))
    assert ("jobs", saved.jobs.count(), False) in rows(counted)
    plan = watched.gates(spark)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Exchange" not in plan


def test_identifier_audit(filed):
    got = {r["candidate"]: r for r in gates.identifier_audit(
        filed[3].normalized.lca, "ein", ["nm", "county"]).collect()}
    assert (got["nm"]["n_values"], got["nm"]["n_single_id"]) == (3, 1)
    assert got["county"]["n_single_id"] == 0 and got["county"]["n_recovered_rows"] == 0


def test_store_documents_and_publish(spark, filed, tmp_path):
    _, _, _, build = filed
    root = str(tmp_path / "serving")
    store.write_tables(build.tables, root, "1")
    store.write_audit(build.id_map, root, "1")
    store.write_tables(build.tables, root, "2", build.id_map)
    assert store.read_audit(spark, root).count() == 3
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        store.write_audit(build.id_map, root, "2")  # readers may be reading it
    assert store.current_version(spark, root) == "2"
    assert store.read_audit(spark, root, "1").count() == 3
    saved = store.read_tables(spark, root)
    path = str(tmp_path / "docs")
    assert store.existing_keys(spark, path).count() == 0
    assert store.read_manifest(spark, str(tmp_path / "manifest")) is None
    store.write_documents(documents.all_documents(saved, cut=materialize), path)
    docs = store.read_documents(spark, path)
    families = {r["family"]: r["count"] for r in docs.groupBy("family").count().collect()}
    assert families.keys() == {"profile", "jobs", "titles", "wages", "s", "t"} and families["profile"] == 9
    body = {r["key"]: json.loads(r["body"]) for r in docs.collect()}
    green = body[f"e/{hash_key('green only')}.json"]
    assert green["employer"] == {"id": hash_key("green only"), "ein": None, "name": "Green Only"}
    assert green["trend"] == [] and green["level_mix"] == {} and not green["has_jobs"]
    assert green["green_card"]["evidence"] == "present"
    place = body["e/200000001/jobs.json"]["jobs"]
    assert [j["state"] for j in place] == ["CA", None] and isinstance(place[0]["min_wage"], float)
    wages = body["w/15-1252/II.json"]
    assert [s["year"] for s in wages["national"]] == [2022, 2024] and "94043" in wages["zips"]
    # one zip under two states: both cells stay in its list, the missing state last
    assert [s["n_filings"] for s in wages["zips"]["94043"] if s["year"] == 2024] == [8]

    plan = publish.plan_publish(docs, None)
    manifest = publish.next_manifest(plan)
    store.write_manifest(manifest, str(tmp_path / "manifest"))
    again = publish.plan_publish(docs, store.read_manifest(spark, str(tmp_path / "manifest")))
    assert {r["action"] for r in again.collect()} == {"unchanged"}
    meta = documents.seal(documents.meta_document(documents.table_counts(saved), manifest, "now"))
    got = json.loads(meta.first()["body"])
    assert got["objects"] == len(body) + 1 and got["rows"]["employers"] == 9 and got["ok"]
    assert publish.publish_report(again, meta).first()["uploaded"] == 1


def test_one_document_per_key_at_any_size(spark):
    rows = spark.range(3000).select(
        F.lit("k").alias("key"), F.lit("15-1252").alias("soc_code"), F.concat(F.lit("t"), F.col("id")).alias("title"),
        F.lit(1).alias("n_filings"), F.create_map(F.lit("II"), F.lit(1).cast("long")).alias("level_mix"),
        *[F.lit(1).cast("decimal(12,2)").alias(c) for c in ("avg_wage", "min_wage", "max_wage")])
    doc = documents.titles_documents(rows).collect()
    assert [r["key"] for r in doc] == ["e/k/titles.json"]
    titles = json.loads(doc[0]["body"])["titles"]
    assert [t["title"] for t in titles] == sorted(f"t{i}" for i in range(3000))
    assert titles[0]["level_mix"] == {"II": 1}


def test_spreadsheet_cells_parse_or_are_reported(spark, tmp_path):
    folder = tmp_path / "exports"
    folder.mkdir()
    head = "case_status,employer_name,received_date,decision_date,new_employment\n"
    (folder / "LCA_FY2021_Q1.csv").write_text(
        head + "Certified,A,2020-01-15 00:00:00,15-Jan-20,1.0\nCertified,B,1/15/2020,1/15/2020 0:00,\"1,000\"\n")
    (folder / "LCA_FY2021_Q2.csv").write_text(head + "Certified,C,soon,,many\n")
    paths = loader.list_files(spark, str(folder))
    rows = {r["employer_name"]: r for r in loader.load_files(spark, paths, "lca").collect()}
    day = datetime.date(2020, 1, 15)
    assert [(rows[n]["received_date"], rows[n]["decision_date"], rows[n]["new_employment"]) for n in "ABC"] == [
        (day, day, 1), (day, day, 1000), (None, None, None)]
    report = loader.file_report(spark, paths, "lca")
    lost = {(r["file"][-6:], r["column"]): r["n_unparsed"] for r in report.filter("n_unparsed > 0").collect()}
    assert lost == {("Q2.csv", "received_date"): 1, ("Q2.csv", "new_employment"): 1}
    assert {r["n_rows"] for r in report.filter("file like '%Q1.csv'").collect()} == {2}
    assert tuple(loader.parse_gate(report).first()) == ("unparsed_cells", 2, False)


def test_a_crash_before_the_switch_is_made_good(spark, tmp_path, monkeypatch):
    """A version that is complete but was never served is only switched to."""
    root, switch = str(tmp_path / "served"), store._point
    names = store.ServingTables.__dataclass_fields__
    first = store.ServingTables(**{n: spark.range(2).withColumnRenamed("id", "key") for n in names})
    other = store.ServingTables(**{n: spark.range(5).withColumnRenamed("id", "key") for n in names})

    def crash(spark, folder, version, name=store.POINTER):
        if name == store.POINTER:
            raise RuntimeError("power cut")
        switch(spark, folder, version, name)
    monkeypatch.setattr(store, "_point", crash)
    with pytest.raises(RuntimeError, match="power cut"):
        store.write_tables(first, root, "1")
    monkeypatch.setattr(store, "_point", switch)
    store.write_tables(other, root, "1")
    assert store.current_version(spark, root) == "1" and store.read_tables(spark, root).jobs.count() == 2
    with pytest.raises(ValueError, match="in use"):
        store.write_tables(other, root, "1")


def test_a_build_that_stops_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "served")
    ids = spark.range(2).withColumnRenamed("id", "key")
    names = store.ServingTables.__dataclass_fields__
    store.write_tables(store.ServingTables(**{n: ids for n in names}), root, "1")
    broken = store.ServingTables(**{
        n: ids if n != "wage_benchmarks" else ids.select(F.raise_error(F.lit("stopped")).alias("key")) for n in names})
    with pytest.raises(Exception, match="stopped"):
        store.write_tables(broken, root, "2")
    assert store.current_version(spark, root) == "1" and store.read_tables(spark, root).jobs.count() == 2
    with pytest.raises(ValueError):
        store.write_tables(store.ServingTables(**{n: ids for n in names}), root, "1")
    store.write_tables(store.ServingTables(**{n: ids.limit(1) for n in names}), root, "2")
    assert store.current_version(spark, root) == "2" and store.read_tables(spark, root).jobs.count() == 1


def test_manifest_versions(spark, tmp_path):
    path = str(tmp_path / "manifest")
    one = spark.createDataFrame([("a", "1")], "key string, sha256 string")
    with pytest.raises(ValueError):
        store.write_manifest(one, path, publish.PublishOptions(limit=1))
    assert store.read_manifest(spark, path) is None
    store.write_manifest(one, path)
    old = store.read_manifest(spark, path)
    store.write_manifest(old.select("key", "sha256").union(spark.createDataFrame([("b", "2")], "key string, sha256 string")), path)
    assert sorted(map(tuple, store.read_manifest(spark, path).select("key", "sha256").collect())) == [("a", "1"), ("b", "2")]
    assert old.count() == 1  # the version a plan may still read


def test_lookups_move_no_bodies(spark, tmp_path):
    spark.range(2000).select(
        F.lit("profile").alias("family"), F.format_string("e/%09d.json", "id").alias("key"),
        F.lit("{}").alias("body")).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    asked = spark.createDataFrame([(1, "000000007"), (2, "bad"), (3, "999999999")], "request_id int, id string")
    answer = lookup.lookup_entity(docs, asked)
    assert {r["request_id"]: r["status"] for r in answer.collect()} == {1: 200, 2: 400, 3: 404}
    plan = answer._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan
