"""Preparing a frozen run: pinned tests and datasets, mapping dependencies, completeness, and the sealed manifest."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import framing
from ledgerloom.operators.executors import ConfigurationError
from ledgerloom.operators.ingest import frame
from ledgerloom.operators.lifecycle import fields, fingerprint, sequence

MOST_ATTEMPTS = 20
#: States of datasets that a run may use.
CONSUMABLE = ("COMPLETED", "COMPLETED_WITH_ISSUES")


class PreparationError(ValueError):
    """A preparation that can't be sealed."""


def client_key(vat_number: Column, cr_number: Column, client_id: Column) -> Column:
    """Identity of a client: by VAT number, else by commercial register, else by its own id."""
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(there(vat_number), F.concat(F.lit("vat:"), vat_number)).when(there(cr_number), F.concat(F.lit("cr:"), cr_number)).otherwise(F.concat(F.lit("g4ck:"), client_id))


def draft_attempts(most: int | None = None) -> int:
    """Attempts that a run may take: 3 unless given, 1 to 20."""
    if most is not None and (type(most) is not int or not 1 <= most <= MOST_ATTEMPTS):
        raise ConfigurationError(f"attempts must be an integer from 1 to {MOST_ATTEMPTS}")
    return 3 if most is None else most


def pinned_tests(selected: DataFrame, tests: DataFrame, versions: DataFrame) -> DataFrame:
    """Selected tests with the version that is current now, and a problem where one can't be pinned (null if it can).

    selected: test_key, order_index, parameters (JSON); tests: test_key, current_version_id;
    versions: version_id, test_type, status, version_hash, requirements, definition (JSON) and
    rule_version_id. Selections without parameters take those frozen in the version's definition.
    """
    joined = selected.join(tests, "test_key", "left").join(versions, F.col("current_version_id") == F.col("version_id"), "left")
    known = joined.join(tests.select("test_key", F.lit(True).alias("is_test")), "test_key", "left")
    is_rule = F.col("test_type") == "RULE"
    problem = (
        F.when(F.col("is_test").isNull(), "test not found")
        .when(F.col("current_version_id").isNull(), "no current version")
        .when(F.col("version_id").isNull(), "version missing")
        .when(F.col("status") != "ACTIVE", "version not usable")
        .when(F.coalesce("version_hash", F.lit("")) == "", "version has no hash")
        .when(F.try_parse_json("requirements").isNull(), "malformed requirements")
        .when(is_rule & F.col("rule_version_id").isNull(), "rule version missing")
        .when(~is_rule & F.col("rule_version_id").isNotNull(), "unexpected rule version")
    )
    own = F.nullif(F.coalesce("parameters", F.lit("{}")), F.lit("{}"))
    parameters = F.coalesce(own, F.get_json_object("definition", "$.params"), F.lit("{}"))
    return known.select("test_key", "order_index", "version_id", "rule_version_id", "test_type", parameters.alias("parameters"), problem.alias("problem"))


def pinned_datasets(selected: DataFrame, datasets: DataFrame, engagement_id: str) -> DataFrame:
    """Selected datasets (dataset_id, order_index) with hash, kind and lineage, and a problem where one can't be used."""
    own = datasets.select("dataset_id", "engagement_id", "kind", "dataset_hash", "lineage_class", "status", F.lit(True).alias("is_dataset"))
    joined = selected.join(own, "dataset_id", "left")
    problem = (
        F.when(F.col("is_dataset").isNull(), "dataset not found")
        .when(~F.col("engagement_id").eqNullSafe(engagement_id), "dataset of another engagement")
        .when(~F.coalesce(F.col("status").isin(*CONSUMABLE), F.lit(False)), "dataset not consumable")
        .when(F.coalesce("dataset_hash", F.lit("")) == "", "dataset has no hash")
    )
    return joined.select("dataset_id", "order_index", "dataset_hash", F.col("kind").alias("dataset_kind"), "lineage_class", problem.alias("problem"))


def without_problems(pins: DataFrame) -> DataFrame:
    """Pins, all of which must be free of problems; else the run fails before anything is written."""
    return pins.where(F.assert_true(F.col("problem").isNull(), F.col("problem")).isNull()).drop("problem")


def mapping_pins(accounts: DataFrame, mappings: DataFrame, versions: DataFrame, targets: DataFrame) -> DataFrame:
    """The mapping that each account of a dataset depends on: account_id, mapping_version_id, mapping_hash. Unmapped accounts have none.

    accounts: account_id, dataset_hash, source_system, source_entity, source_ledger,
    account_code; mappings: account_id, current_version_id; versions: mapping_version_id,
    version, basis, target_id; targets: target_id, scope_key, target_code.
    """
    joined = accounts.join(mappings, "account_id").join(versions, F.col("current_version_id") == F.col("mapping_version_id")).join(targets, "target_id", "left")
    source = framing.account_identity(*(F.col(c) for c in ("dataset_hash", "source_system", "source_entity", "source_ledger", "account_code")))
    empty = lambda c: F.coalesce(c, F.lit(""))
    hashed = framing.mapping_identity(F.col("source"), F.col("version"), F.col("basis"), empty("scope_key"), empty("target_code"))
    return joined.withColumn("source", source).select("account_id", "mapping_version_id", hashed.alias("mapping_hash")).dropDuplicates(["account_id", "mapping_version_id"])


def unfinished(resolutions: DataFrame) -> DataFrame:
    """Resolutions of eligible tests whose population has no fingerprint yet."""
    return resolutions.where("eligibility <> 'NOT_ELIGIBLE' and fingerprint is null")


def expected_counts(datasets: DataFrame, tests: DataFrame, resolutions: DataFrame, members: DataFrame, pins: DataFrame) -> DataFrame:
    """One row: the number of each part of a preparation."""
    parts = {"datasets": datasets, "testVersions": tests, "resolutions": resolutions, "members": members, "mappingPins": pins}
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    rows = counted[0]
    for other in counted[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy().pivot("part", list(parts)).agg(F.first("n"))


def seal(resolutions: DataFrame, expected: dict[str, int], build: str | None) -> dict[str, Any]:
    """Manifest of a complete preparation and its identity; resolutions (a row per test and dataset) go in order of resolution_id.

    Fails if a population is unfinished, or without the identity of the build that made it.
    """
    if not build:
        raise PreparationError("a build identity is needed to seal")
    if left := unfinished(resolutions).count():
        raise PreparationError(f"{left} resolutions have no population fingerprint")
    prints = [r.fingerprint for r in resolutions.orderBy("resolution_id").select("fingerprint").collect()]
    body = fields({"expected": fields({k: frame(str(v)) for k, v in expected.items()}), "engineBuildVersionCandidate": frame(build), "popFingerprints": sequence([frame(p) for p in prints])})
    return {"build": build, "expected": expected, "fingerprints": prints, "hash": fingerprint("g4manifest.1", body)}


#: The parts that a preparation counts.
COUNTED = ("datasets", "testVersions", "resolutions", "members", "mappingPins")


def _framed_list(rows: DataFrame, order: list[str], frame_: Column, name: str) -> DataFrame:
    """run_id and the frames of its rows in order."""
    framed = rows.select("run_id", F.struct(*order, frame_.alias("frame")).alias("row"))
    return framed.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["frame"]).alias(name))


def manifests(prepared: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The identity of the manifest of each preparation, or why it can't be sealed: run_id, n_fingerprints, problem, manifest_hash.

    prepared: run_id, build, and a count for each of COUNTED; resolutions: run_id,
    resolution_id, eligibility, fingerprint. A manifest names all fingerprints of its run, one
    for each test and dataset, so a run's are one value.
    """
    done = _framed_list(resolutions, ["resolution_id"], framing.text(F.col("fingerprint")), "prints")
    left = unfinished(resolutions).groupBy("run_id").agg(F.count("*").alias("n_left"))
    joined = prepared.join(done, "run_id", "left").join(left, "run_id", "left").withColumn("prints", F.coalesce("prints", F.array().cast("array<binary>")))
    no_build = F.coalesce("build", F.lit("")) == ""
    problem = F.when(no_build, "no build identity").when(F.col("n_left") > 0, F.concat(F.col("n_left").cast("string"), F.lit(" resolutions without a fingerprint")))
    counts = framing.fields(**{c: framing.text(F.col(c).cast("string")) for c in COUNTED})
    body = framing.fields(expected=counts, engineBuildVersionCandidate=framing.text(F.col("build")), popFingerprints=framing.sequence(F.col("prints")))
    return joined.withColumn("problem", problem).select("run_id", F.size("prints").alias("n_fingerprints"), "problem", F.when(F.col("problem").isNull(), framing.fingerprint("g4manifest.1", body)).alias("manifest_hash"))


#: Fields of the parts of a configuration, as hashed.
_DATASET = ("datasetHash", "datasetKind", "lineageClass")
_PIN = ("testKey", "version", "versionHash", "ruleKey", "ruleVersion", "ruleVersionHash", "effectiveParametersHash")
_RESOLUTION = ("testKey", "datasetHash", "eligibility", "resolutionAlgorithmVersion", "eligiblePopulationFingerprint")


def configurations(runs: DataFrame, datasets: DataFrame, tests: DataFrame, resolutions: DataFrame, mappings: DataFrame) -> DataFrame:
    """Identity of the configuration of every run (run_id, config_hash), equal to `lifecycle.config_fingerprint` of its parts.

    runs: run_id, anchor, build, materiality, risk_model; the parts: run_id and the fields
    hashed, by their names; mappings: run_id, mapping_hash. The order of parts doesn't matter.
    """
    named = lambda names: framing.fields(**{n: framing.text(F.col(n).cast("string")) for n in names})
    parts = {
        "dataset_frames": _framed_list(datasets, ["datasetHash"], named(_DATASET), "dataset_frames"),
        "test_frames": _framed_list(tests, ["testKey"], named(_PIN), "test_frames"),
        "resolution_frames": _framed_list(resolutions, ["testKey", "datasetHash"], named(_RESOLUTION), "resolution_frames"),
        "mapping_frames": _framed_list(mappings, ["mapping_hash"], framing.text(F.col("mapping_hash")), "mapping_frames"),
    }
    out = runs
    for name, part in parts.items():
        out = out.join(part, "run_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<binary>")))
    own = lambda c: framing.text(F.col(c))
    body = framing.fields(
        semanticScopeAnchor=own("anchor"), datasetScope=framing.sequence(F.col("dataset_frames")), testPins=framing.sequence(F.col("test_frames")),
        scopeResolutions=framing.sequence(F.col("resolution_frames")), consumedMappings=framing.multiset(F.col("mapping_frames")),
        engineBuildVersion=own("build"), materialityVersionKey=own("materiality"), riskModelVersionKey=own("risk_model"),
    )
    return out.select("run_id", framing.fingerprint("g4cfg.3", body).alias("config_hash"))


# Authoring of tests

_EVERY, _LEDGER = ("GENERAL_LEDGER", "TRIAL_BALANCE", "BANK", "OTHER"), ("GENERAL_LEDGER",)
#: Tests that may be authored, the dataset kinds they take, and the method of those with parameters.
CREATABLE: dict[tuple[str, str], tuple[tuple[str, ...], str | None]] = {
    ("DATA_QUALITY", "POPULATION_MEMBER"): (_EVERY, None),
    ("DATA_QUALITY", "SOURCE_TO_CANONICAL_MISMATCH"): (_EVERY, None),
    ("ACCOUNTING_INTEGRITY", "UNBALANCED_JE"): (_LEDGER, None),
    ("ACCOUNTING_INTEGRITY", "INVALID_DEBIT_CREDIT"): (_LEDGER, None),
    ("ACCOUNTING_INTEGRITY", "TB_ACCOUNT_DUPLICATION"): (("TRIAL_BALANCE",), None),
    ("STATISTICAL", "ROUND_NUMBER_FREQUENCY"): (_LEDGER, "st.round.1"),
    ("STATISTICAL", "DUPLICATE_AMOUNT_FREQUENCY"): (_LEDGER, "st.dupamt.1"),
}
#: What a test's key looks like.
_TEST_KEY = "^[A-Za-z0-9][A-Za-z0-9_-]{1,63}$"
_BASIS = "TRANSACTION"


def _divisor(a: Column, b: Column) -> Column:
    """Greatest common divisor; 92 divisions are enough for any two longs."""
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair(a, b), lambda p, _: F.when(p["b"] == 0, p).otherwise(pair(p["b"], F.try_mod(p["a"], p["b"]))))
    return last["a"]


def authored_tests(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """First versions of proposed tests: firm_id, test_key, name, test_type, definition, requirements (JSON) and version_hash; or a problem.

    proposed: firm_id, test_key, name, test_type, kind, dataset_kinds, parameters (a map of
    texts) and needs_mapping; existing: firm_id, test_key. Of proposals that share a firm and key
    none is free of problems. Whole numbers may be written with signs and blanks; a rate is
    reduced to lowest terms.
    """
    takes = F.create_map(*(x for (test_type, kind), (kinds, method) in CREATABLE.items() for x in (F.lit(f"{test_type}:{kind}"), F.struct(F.array(*map(F.lit, kinds)).alias("kinds"), F.lit(method).alias("method")))))
    given = lambda name: F.try_element_at("parameters", F.lit(name))
    whole = lambda name: F.when(F.trim(given(name)).rlike("^[+-]?[0-9]{1,18}$"), F.trim(given(name))).cast("long")
    trimmed = proposed.select("firm_id", F.trim("test_key").alias("test_key"), F.trim(F.coalesce("name", F.lit(""))).alias("name"), "test_type", "kind", "dataset_kinds", "parameters", "needs_mapping")
    looked = trimmed.withColumn("takes", F.try_element_at(takes, F.concat_ws(":", "test_type", "kind")))
    numbers = ("minimumPopulation", "minimumRoundCount", "rateThresholdNum", "rateThresholdDenom", "minimumOccurrenceCount")
    read = looked.withColumns({n: whole(n) for n in numbers} | {"method": F.col("takes.method"), "kinds": F.array_intersect("dataset_kinds", F.col("takes.kinds")), "quantum": given("roundingQuantum")})
    read = read.withColumn("shared", F.when(F.col("rateThresholdDenom") > 0, _divisor(F.abs("rateThresholdNum"), F.col("rateThresholdDenom"))).otherwise(1))
    by_round, by_amount = F.col("method") == "st.round.1", F.col("method") == "st.dupamt.1"
    for n in ("rateThresholdNum", "rateThresholdDenom"):
        read = read.withColumn(n, F.expr(f"{n} div shared"))
    sound_quantum = F.col("quantum").rlike(r"^[0-9]{1,18}(\.[0-9]{1,6})?$") & (F.col("quantum").try_cast("decimal(24,6)") > 0)
    sound_rate = (F.col("rateThresholdNum") > 0) & (F.col("rateThresholdNum") <= F.col("rateThresholdDenom"))
    sound_round = sound_quantum & (F.col("minimumPopulation") >= 0) & (F.col("minimumRoundCount") >= 0) & sound_rate
    sound = F.when(by_round, sound_round).when(by_amount, F.col("minimumOccurrenceCount") >= 2).otherwise(True)
    known = existing.select("firm_id", "test_key", F.lit(True).alias("is_known")).distinct()
    shares = read.groupBy("firm_id", "test_key").agg(F.count("*").alias("n_proposed"))
    judged = read.join(known, ["firm_id", "test_key"], "left").join(shares, ["firm_id", "test_key"])
    problem = (
        F.when(~F.col("test_key").rlike(_TEST_KEY), "malformed key")
        .when(F.col("takes").isNull(), "not to be authored")
        .when(F.coalesce(F.size("kinds"), F.lit(0)) <= 0, "no dataset kind that it takes")
        .when(F.col("name") == "", "no name")
        .when(~F.coalesce(sound, F.lit(False)), "unsound parameters")
        .when(F.col("is_known"), "key exists")
        .when(F.col("n_proposed") > 1, "key proposed twice")
    )
    only = lambda by, c: F.when(by, c)
    parameters = F.struct(
        F.lit(_BASIS).alias("amountBasis"), F.col("method").alias("methodVersion"), only(by_round, F.col("quantum")).alias("roundingQuantum"),
        *(only(by_round, F.col(n)).alias(n) for n in numbers[:4]), only(by_amount, F.col(numbers[4])).alias(numbers[4]),
    )
    # to_json leaves out what is null, so a test has the fields of its own kind
    definition = F.struct(F.col("kind"), F.when(F.col("method").isNotNull(), parameters).alias("params"))
    requirements = F.struct(F.col("kinds").alias("requiredDatasetKinds"), F.when(F.col("needs_mapping"), True).alias("requiresAccountMapping"))
    body = F.struct(F.col("firm_id").alias("f"), F.col("test_key").alias("key"), F.lit(1).alias("v"), F.col("test_type").alias("tt"), definition.alias("def"), requirements.alias("req"))
    made = {"definition": F.to_json(definition), "requirements": F.to_json(requirements), "version_hash": F.sha2(F.to_json(body), 256)}
    return judged.select("firm_id", "test_key", "name", "test_type", *(F.when(problem.isNull(), c).alias(n) for n, c in made.items()), problem.alias("problem"))
