"""Imports, runs, matters and the streaming extension."""

import hashlib
import os
import random
import shutil
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import framing
from ledgerloom.functions.text import filled
from ledgerloom.operators import executors, imports, ingest, lifecycle, preparation, rules
from ledgerloom.operators.executors import ConfigurationError
from ledgerloom.operators.ingest import frame, raw_cells
from ledgerloom.session import checkpointed, shared_folder
from ledgerloom.sources import sinks
from ledgerloom.streaming.rules import streamed_findings, streamed_first_seen
from tests.test_operators import tx


def test_versions_are_appended(spark):
    versions = spark.createDataFrame([("a", "h1", 1), ("a", "h2", 2)], "name string, hash string, version_no int")
    proposed = spark.createDataFrame([("a", "h2"), ("a", "h3"), ("b", "h1"), ("a", "h3")], "name string, hash string")
    assert sorted(tuple(r) for r in lifecycle.new_versions(proposed, versions).collect()) == [("a", "h3", 3), ("b", "h1", 1)]


def test_source_identity(spark):
    row = spark.range(1).select(lifecycle.source_identity(raw_cells(["System", "SYSTEM", "x"], F.array(F.lit("sap"), F.lit("no"), F.lit("1"))), {"system": "source_system", "ledger": "source_ledger"}).alias("s")).first().s
    assert (row.source_system, row.source_ledger) == ("sap", None)


def test_preflight_is_all_or_nothing(spark):
    good = lifecycle.PinnedTest("t1", "STATISTICAL", "ROUND_NUMBER_FREQUENCY", {"roundingQuantum": "1", "minimumPopulation": 1, "minimumRoundCount": 1, "rateThresholdNum": 1, "rateThresholdDenom": 2})
    bad = lifecycle.PinnedTest("t2", "RULE", "ANY", {})
    parse = {("STATISTICAL", "ROUND_NUMBER_FREQUENCY"): executors.RoundNumbers.parse}
    assert len(lifecycle.preflight([good], parse)) == 1
    with pytest.raises(executors.ConfigurationError, match="t2"):
        lifecycle.preflight([good, bad], parse)
    member = spark.createDataFrame([("d", 1, "h")], "dataset_id string, source_row_no long, content_hash string")
    ready = lifecycle.preflight([lifecycle.PinnedTest("m", "DATA_QUALITY", "POPULATION_MEMBER", {})], {})
    assert lifecycle.run_tests(ready, lambda test, settings: (member,))["m"].count() == 1


def test_config_fingerprint_ignores_order():
    one = [{"datasetHash": "a", "datasetKind": "k"}, {"datasetHash": "b", "datasetKind": None}]
    make = lambda d, m: lifecycle.config_fingerprint("s", d, [], [], m, "b1")
    assert make(one, ["x", "y"]) == make(one[::-1], ["y", "x"]) != make(one, ["x", "x", "y"])


def test_framed_identities(spark):
    row = spark.range(1).select(
        framing.membership_identity(F.array(F.lit("b"), F.lit("a"))).alias("m"),
        framing.matter_key(F.lit("e"), F.lit("r")).alias("k"),
        framing.node_object(x=framing.node(F.lit(True), "bool"), y=framing.node(F.lit(None).cast("int"), "int")).alias("n"),
        framing.parameters_identity({"a": 1, "b": None, "c": True}).alias("p"),
        framing.finding_identity({c: F.lit("50") for c in framing.FINDING_TEXTS + framing.FINDING_AMOUNTS}).alias("f1"),
        framing.finding_identity({c: F.lit("50.00" if c in framing.FINDING_AMOUNTS else "50") for c in framing.FINDING_TEXTS + framing.FINDING_AMOUNTS}).alias("f2"),
    ).first()
    sha = lambda tag, body: hashlib.sha256(frame(tag) + body).hexdigest()
    assert row.m == sha("g5members.1", b"\x04\x02" + frame("a") + frame("b"))
    assert row.k == sha("g5mattercorr.1", lifecycle.fields({"engagementId": frame("e"), "semantic": frame("r")}))
    assert bytes(row.n) == lifecycle.fields({"obj": lifecycle.fields({"x": lifecycle.fields({"b": frame("1")}), "y": lifecycle.fields({"n": frame(None)})})})
    assert row.p == sha("g4param.1", lifecycle.fields({"a": frame("1"), "b": frame(None), "c": frame("true")}))
    assert row.f1 == row.f2


def test_matters(spark):
    events = spark.createDataFrame([("x", 1, "CREATE", None), ("x", 2, "STATUS", "DISMISSED"), ("x", 3, "LINK", None), ("y", 1, "CREATE", None)], "exception_id string, event_seq long, action string, to_status string")
    assert {r.exception_id: r.status for r in lifecycle.exception_states(events).collect()} == {"x": "DISMISSED", "y": "OPEN"}
    documents = spark.createDataFrame([("d", "PARSED"), ("e", "PENDING")], "document_id string, status string")
    lines = spark.createDataFrame([("d",), ("d",), ("e",)], "document_id string")
    assert {r.document_id: r.n_transactions for r in lifecycle.document_counts(documents, lines).collect()} == {"d": 2, "e": None}


def test_streams(spark, tmp_path):
    rows = tx(spark, {"reference": "A", "amount": "5.00"}, {"reference": "A", "amount": "5.00"}, {"reference": "B", "amount": "7.00", "posted_at": "2025-09-05T09:00:00"})
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, df in (("found", streamed_findings(stream, list(rules.LIBRARY))), ("seen", streamed_first_seen(stream))):
        query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.processAllAvailable()
        query.stop()
    assert {(r.rule, r.ids[0]) for r in spark.table("found").collect()} == {("WEEKEND", "t2")}
    assert spark.table("seen").count() == 2


def test_confirmed_import_is_all_or_nothing(spark, tmp_path):
    headers = ["account", "posting date", "amount", "currency", "Entry"]
    rows = spark.createDataFrame([(1, ["1", "2024-01-31", "10.000001", "SAR", "E"]), (2, ["2", "2024-01-31", "-10.000001", "SAR", "E"]), (3, ["3", "x", "1", "SAR", "E"])], "source_row_no long, values array<string>")
    cells = rows.select("source_row_no", raw_cells(headers, F.col("values")).alias("cells"))
    prepared = ingest.prepare_rows(cells, "GENERAL_LEDGER", ingest.suggest_mapping("GENERAL_LEDGER", headers), headers=headers)
    path, more = str(tmp_path / "import"), {"identity": {"sourceEntryId": "entry"}, "convention": "POSITIVE_DEBIT_NEGATIVE_CREDIT"}
    header = {"datasetKind": "GENERAL_LEDGER"}
    broken = prepared.withColumn("source_row_no", F.when(F.col("source_row_no") == 2, F.raise_error(F.lit("torn")).cast("long")).otherwise(F.col("source_row_no")))
    with pytest.raises(Exception, match="torn"):
        imports.confirm_import(broken, "GENERAL_LEDGER", "d", header, path, **more)
    with pytest.raises(Exception):
        sinks.read_sealed(spark, path, "dataset")
    imports.confirm_import(prepared, "GENERAL_LEDGER", "d", header, path, **more)
    dataset = sinks.read_sealed(spark, path, "dataset").first()
    assert (dataset.status, dataset.n_rows, dataset.n_rejected, len(dataset.dataset_hash)) == ("COMPLETED_WITH_ISSUES", 3, 1, 64)
    entry = sinks.read_sealed(spark, path, "entries").first()
    assert (entry.source_entry_id, entry.n_lines, entry.balance_status, str(entry.debit_total)) == ("E", 2, "BALANCED", "10.000001")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        imports.confirm_import(prepared, "GENERAL_LEDGER", "d", header, path, **more)
    balance = ingest.prepare_rows(cells, "TRIAL_BALANCE", {"account": "accountCode", "amount": "closingDebit"}, headers=headers)
    tables = imports.confirmed(balance, "TRIAL_BALANCE", "t", header)
    assert sorted(str(r.closing_debit) for r in tables["balances"].collect()) == ["-10.000001", "1.000000", "10.000001"]


def _disk(folder, name=""):
    """Bytes of the files under a folder by path; name: what theirs begin with."""
    return {f"{at}/{f}": os.path.getsize(f"{at}/{f}") for at, _, files in os.walk(folder) for f in files if f.startswith(name) and os.path.exists(f"{at}/{f}")}


def test_a_confirmed_import_takes_little_disk(spark):
    """Its rows are kept once and by column, and shuffles before them go when they are written, while the caller still holds the rows."""
    n, headers, name = 40_000, ["account", "posting date", "debit", "credit", "currency", "Entry"], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    values = F.array((F.col("id") % 997).cast("string"), F.lit("2024-01-31"), (F.col("id") / 100).cast("decimal(12,2)").cast("string"), F.lit(""), F.lit("SAR"), F.floor(F.col("id") / 4).cast("string"))
    cells = spark.range(n).repartition(4, "id").select(F.col("id").alias("source_row_no"), raw_cells(headers, values).alias("cells"))
    prepared = ingest.prepare_rows(cells, "GENERAL_LEDGER", ingest.suggest_mapping("GENERAL_LEDGER", headers), headers=headers)
    shared, scratch, setting = shared_folder(spark).removeprefix("file://"), spark.conf.get("spark.local.dir"), spark.conf.get(name, None)
    kept, shuffled = _disk(shared), _disk(scratch, "shuffle_")
    tables = imports.confirmed(prepared, "GENERAL_LEDGER", "d", {"datasetKind": "GENERAL_LEDGER"}, {"sourceEntryId": "Entry"})
    fresh = lambda before, now: sum(size for path, size in now.items() if path not in before)
    for _ in range(20):  # shuffles are removed in the background
        left = fresh(shuffled, _disk(scratch, "shuffle_"))
        if left < n:
            break
        time.sleep(0.5)
    assert left < n and fresh(kept, _disk(shared)) < 160 * n and spark.conf.get(name, None) == setting
    hashes = [r.raw_hash for r in prepared.select("source_row_no", "raw_hash").orderBy("source_row_no").collect()]
    right = hashlib.sha256(b"\x01" + frame("datasetKind") + frame("GENERAL_LEDGER") + ingest._leb128(n) + bytes.fromhex("".join(hashes))).hexdigest()
    dataset = tables["dataset"].first()
    assert (dataset.dataset_hash, dataset.n_rows, tables["lines"].count(), tables["entries"].count()) == (right, n, n, n // 4)


def test_seal(spark):
    rows = spark.createDataFrame([(2, "ELIGIBLE", "b"), (1, "NOT_ELIGIBLE", None)], "resolution_id int, eligibility string, fingerprint string")
    sealed = preparation.seal(rows, {"members": 3, "datasets": 1}, "build-1")
    frame = ingest.frame
    named = lambda parts: b"\x03" + bytes([len(parts)]) + b"".join(frame(k) + parts[k] for k in sorted(parts))
    body = named({"expected": named({"datasets": frame("1"), "members": frame("3")}), "engineBuildVersionCandidate": frame("build-1"), "popFingerprints": b"\x02\x02\x00" + frame("b")})
    assert sealed["hash"] == hashlib.sha256(frame("g4manifest.1") + body).hexdigest()
    for wrong in ((rows.withColumn("fingerprint", F.lit(None).cast("string")), "build-1"), (rows, None)):
        with pytest.raises(preparation.PreparationError):
            preparation.seal(wrong[0], {}, wrong[1])
    pins = spark.createDataFrame([("t", None), ("u", "test not found")], "test_key string, problem string")
    with pytest.raises(Exception, match="test not found"):
        preparation.without_problems(pins).collect()
    assert preparation.draft_attempts() == 3 and preparation.draft_attempts(20) == 20
    with pytest.raises(ConfigurationError):
        preparation.draft_attempts(21)


PROPOSED = "firm_id string, test_key string, name string, test_type string, kind string, dataset_kinds array<string>, parameters map<string,string>, needs_mapping boolean"


def test_authoring(spark):
    rate = {"roundingQuantum": "100", "minimumPopulation": " 5", "minimumRoundCount": "2", "rateThresholdNum": "2", "rateThresholdDenom": "10"}
    of = lambda key, **more: {"firm_id": "f", "test_key": key, "name": "n", "test_type": "DATA_QUALITY", "kind": "POPULATION_MEMBER", "dataset_kinds": ["BANK"], "parameters": None, "needs_mapping": None} | more
    frequency = {"test_type": "STATISTICAL", "kind": "ROUND_NUMBER_FREQUENCY", "dataset_kinds": ["GENERAL_LEDGER", "BANK", "GENERAL_LEDGER"]}
    amounts = {"test_type": "STATISTICAL", "kind": "DUPLICATE_AMOUNT_FREQUENCY", "dataset_kinds": ["GENERAL_LEDGER"]}
    rows = [
        of(" round-1 ", **frequency, parameters=rate), of("k1"), of("k2", needs_mapping=True), of("amounts", **amounts, parameters={"minimumOccurrenceCount": "2"}),
        of("x"), of("kind", kind="ANY"), of("none", dataset_kinds=["CASH"]), of("blank", name=" "), of("known"), of("twice"), of("twice", name="m"),
        of("low", **amounts, parameters={"minimumOccurrenceCount": "1"}), of("text", **frequency, parameters=rate | {"minimumPopulation": "5.5"}), of("above", **frequency, parameters=rate | {"rateThresholdNum": "11"}), of("zero", **frequency, parameters=rate | {"rateThresholdDenom": "0"}), of("fine", **frequency, parameters=rate | {"roundingQuantum": "0.0000001"}), of("bare", **frequency),
    ]
    known = spark.createDataFrame([("f", "known"), ("other", "k1")], "firm_id string, test_key string")
    found = {r.test_key: r for r in preparation.authored_tests(spark.createDataFrame([tuple(r.values()) for r in rows], PROPOSED), known).collect()}
    problems = {"x": "malformed key", "kind": "not to be authored", "none": "no dataset kind that it takes", "blank": "no name", "known": "key exists", "twice": "key proposed twice"} | dict.fromkeys(("low", "text", "above", "zero", "fine", "bare"), "unsound parameters")
    assert {k: r.problem for k, r in found.items() if r.problem} == problems and all(found[k].version_hash is None for k in problems)
    assert found["round-1"].requirements == '{"requiredDatasetKinds":["GENERAL_LEDGER"]}' and found["k2"].requirements == '{"requiredDatasetKinds":["BANK"],"requiresAccountMapping":true}'
    assert found["round-1"].definition == '{"kind":"ROUND_NUMBER_FREQUENCY","params":{"amountBasis":"TRANSACTION","methodVersion":"st.round.1","roundingQuantum":"100","minimumPopulation":5,"minimumRoundCount":2,"rateThresholdNum":1,"rateThresholdDenom":5}}'
    assert found["amounts"].definition == '{"kind":"DUPLICATE_AMOUNT_FREQUENCY","params":{"amountBasis":"TRANSACTION","methodVersion":"st.dupamt.1","minimumOccurrenceCount":2}}'
    assert found["k1"].version_hash == hashlib.sha256(b'{"f":"f","key":"k1","v":1,"tt":"DATA_QUALITY","def":{"kind":"POPULATION_MEMBER"},"req":{"requiredDatasetKinds":["BANK"]}}').hexdigest()
    assert preparation.authored_tests(spark.createDataFrame([], PROPOSED), known).count() == 0


def test_texts(spark):
    assert spark.range(1).select(filled("{a} of {b}.", {"a": F.lit(3), "b": F.lit(None).cast("string")}).alias("x")).first().x == "3 of ."


def test_a_copy_without_training_operators_works(tmp_path):
    """The engine needs neither of the two folders that belong to the training-data operators, nor the pipeline."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for keep_pipeline in (True, False):
        copy = tmp_path / f"copy-{keep_pipeline}"
        copy.mkdir()
        shutil.copytree(f"{root}/ledgerloom", copy / "ledgerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if keep_pipeline and os.path.exists(f"{root}/corpus_pipeline.py") else [])):
            shutil.copy(f"{root}/{name}", copy / name)
        code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})


STARTED = "firm_id string, arrival long, idempotency_key string, sha256 string, size long, acknowledged boolean"


def started_one_by_one(rows, keys, files, stored):
    keys, files, out = dict(keys), dict(files), []
    for _, at, key, sha, size, acknowledged in sorted(rows, key=lambda r: r[1]):
        if key is not None and key in keys:
            out.append((at, "DEDUPED_EXISTING", keys[key], None))
        elif sha in files and not acknowledged:
            out.append((at, "DUPLICATE_BLOCKED", None, files[sha]))
        elif stored.get(sha) != size:
            out.append((at, "STORAGE_FAILED", None, None))
        else:
            out.append((at, "READY", None, None))
            if key is not None:
                keys[key] = str(at)
            files.setdefault(sha, str(at))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_imports_start_as_one_by_one(spark, seed):
    draw = random.Random(seed)
    rows = [("f", i, draw.choice([None, *"abcdefgh"[: 3 + seed * 2]]), draw.choice(["s0", "s1", "s2", "s3", "s4", "s5", None][: 4 + seed]), draw.choice([5, 5, 5, 6]), draw.choice([True, False, None])) for i in range(60)]
    stored = {f"s{i}": 5 for i in range(4)}
    tables = (
        spark.createDataFrame([("f", "a", "batch"), ("g", "b", "other firm")], "firm_id string, idempotency_key string, batch_id string"),
        spark.createDataFrame([("f", "s1", "file"), ("g", "s0", "other firm")], "firm_id string, sha256 string, source_file_id string"),
        spark.createDataFrame([("f", s, n) for s, n in stored.items()] * 2, "firm_id string, sha256 string, length long"),
    )
    found = imports.started(spark.createDataFrame(rows, STARTED), *tables)
    assert sorted(r[1:] for r in found.collect()) == started_one_by_one(rows, {"a": "batch"}, {"s1": "file"}, stored)
    assert imports.started(spark.createDataFrame([], STARTED), *tables).count() == 0


def test_copies_of_a_key_take_one_round(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(imports, "checkpointed", lambda df: kept.append(1) or checkpointed(df))
    rows = spark.range(20_000).select(F.lit("f").alias("firm_id"), F.col("id").alias("arrival"), F.lit("k").alias("idempotency_key"), F.concat(F.lit("s"), F.col("id") % 50).alias("sha256"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("acknowledged"))
    none = spark.createDataFrame([], "firm_id string, idempotency_key string, batch_id string")
    stored = rows.select("firm_id", "sha256", F.col("size").alias("length"))
    found = imports.started(rows, none, spark.createDataFrame([], "firm_id string, sha256 string, source_file_id string"), stored)
    assert {r.outcome: r["count"] for r in found.groupBy("outcome").count().collect()} == {"READY": 1, "DEDUPED_EXISTING": 19_999}
    assert len(kept) <= 1 + 3  # the facts and one round


def test_reading_accepted_rows_keeps_the_plan_small(spark):
    """The condition on the status isn't written out over every step of the validation."""
    headers = ["account", "posting date", "debit", "credit", "currency"]
    rows = spark.createDataFrame([(1, ["a", "1/2/2024", "5", "", "SAR"]), (2, ["b", "1/2/2024", "", "", "SAR"])], "source_row_no long, v array<string>")
    cells = rows.select("source_row_no", ingest.raw_cells(headers, F.col("v")).alias("cells"))
    prepared = ingest.prepare_rows(cells, "GENERAL_LEDGER", ingest.suggest_mapping("GENERAL_LEDGER", headers), headers=headers)
    for found in (ingest.to_transactions(prepared, "GENERAL_LEDGER"), imports.ledger_lines(prepared, "ds", {})):
        assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 100_000
        assert [r.source_row_no for r in found.collect()] == [1]
