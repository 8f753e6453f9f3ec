"""What is kept between calls: folds in steps, commits of several writers, events in order."""

import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import events, folds, runs
from ledgerloom.sources import commits
from ledgerloom.streaming import matters

MEMBER = "dataset_id string, source_row_no long, eoi string"


def members(spark, sizes, first=1):
    rows = [(d, 3 * i, hashlib.sha256(f"{d}{i}".encode()).hexdigest()) for d, n in sizes.items() for i in range(first, first + n)]
    return spark.createDataFrame(rows, MEMBER)


def by_dataset(df):
    return {r.dataset_id: (r.n_members, r.fingerprint) for r in df.collect()}


def test_fold_in_steps_equals_fold_at_once(spark, tmp_path):
    all_members = members(spark, {"a": 700, "b": 5, "c": 1})
    whole = by_dataset(runs.population_fingerprints(all_members))
    assert by_dataset(folds.fold_population(all_members, str(tmp_path / "once"))) == whole
    path = str(tmp_path / "steps")
    first = folds.fold_population(all_members, path, 500, most_steps=2)
    assert by_dataset(first) == {k: v for k, v in whole.items() if k != "a"}
    assert {r.dataset_id: r.last_row for r in folds.stored_states(spark, path).collect()}["a"] == 3 + 2 * 500 - 1
    assert by_dataset(folds.fold_population(all_members, path, 500)) == whole
    before = spark.read.parquet(path).count()
    assert by_dataset(folds.fold_population(all_members, path, 500)) == whole and spark.read.parquet(path).count() == before


def test_fold_goes_on_after_an_abort_and_an_extension(spark, tmp_path, monkeypatch):
    path, few, more = str(tmp_path / "states"), members(spark, {"a": 300, "b": 40}), members(spark, {"a": 400, "b": 40, "new": 3})
    advanced = folds.advanced

    def torn(rows, due):
        after = advanced(rows, due)
        return after.withColumn("chain", F.when(F.col("step") == 3, F.raise_error(F.lit("torn"))).otherwise(F.col("chain")))

    monkeypatch.setattr(folds, "advanced", torn)
    with pytest.raises(Exception, match="torn"):
        folds.fold_population(few, path, 250)
    monkeypatch.setattr(folds, "advanced", advanced)
    kept = {r.dataset_id: r.n_members for r in folds.stored_states(spark, path).collect()}
    assert 0 < kept["a"] < 300
    folds.fold_population(few, path, 250)
    steps = spark.read.parquet(path).where("dataset_id = 'b'").count()
    assert by_dataset(folds.fold_population(more, path, 250)) == by_dataset(runs.population_fingerprints(more))
    assert spark.read.parquet(path).where("dataset_id = 'b'").count() == steps


def test_fold_starts_afresh_where_members_have_changed(spark, tmp_path):
    path, rows = str(tmp_path / "states"), members(spark, {"a": 50, "b": 50})
    folds.fold_population(rows, path, 60)
    changed = rows.withColumn("eoi", F.when((F.col("dataset_id") == "a") & (F.col("source_row_no") == 30), F.sha2(F.lit("x"), 256)).otherwise(F.col("eoi")))
    assert by_dataset(folds.fold_population(changed, path, 60)) == by_dataset(runs.population_fingerprints(changed))
    fewer = rows.where("source_row_no <> 30 or dataset_id = 'b'")
    assert by_dataset(folds.fold_population(fewer, path, 60)) == by_dataset(runs.population_fingerprints(fewer))
    assert by_dataset(folds.fold_population(rows.limit(0), path, 60)) == {}


RESULT = "firm_id string, run_id string, occurrence_fingerprint string, writer string"


def rows_of(spark, writer, numbers):
    results = spark.createDataFrame([("f", "r", f"o{n}", writer) for n in numbers], RESULT)
    evidence = spark.createDataFrame([("f", "r", f"o{n}", writer, "d", n * 10 + i) for n in numbers for i in range(2)], RESULT + ", dataset_id string, source_row_no long")
    return results, evidence


def test_one_of_two_writers_stores_an_occurrence(spark, tmp_path):
    path, ready = str(tmp_path / "results"), threading.Barrier(2)
    first_try = threading.local()

    def meet():
        if not getattr(first_try, "done", False):
            first_try.done = True
            ready.wait(timeout=120)  # both have written, none has claimed

    versions, errors = [], []

    def write(writer, numbers):
        try:
            versions.append(commits.insert_results(*rows_of(spark, writer, numbers), path, before_claim=meet))
        except Exception as error:  # shown below
            errors.append(error)

    threads = [threading.Thread(target=write, args=x) for x in (("a", range(0, 60)), ("b", range(40, 100)))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(versions) == [1, 2]
    stored = commits.snapshot(spark, path)
    results = {r.occurrence_fingerprint: r.writer for r in stored.table("results").collect()}
    assert stored.table("results").count() == len(results) == 100
    evidence = [(r.occurrence_fingerprint, r.writer) for r in stored.table("evidence").collect()]
    assert len(evidence) == 200 and all(results[o] == w for o, w in evidence)
    assert len({results[f"o{n}"] for n in range(40, 60)}) == 1
    # the beaten attempt is in no version, and can be cleared away
    assert len(commits.deleted_attempts(spark, path)) == 1 and stored.table("results").count() == 100
    # again changes nothing
    commits.insert_results(*rows_of(spark, "c", range(100)), path)
    assert commits.snapshot(spark, path).table("results").count() == 100


def test_evidence_outside_the_population_commits_nothing(spark, tmp_path):
    path, population = str(tmp_path / "r"), spark.createDataFrame([("d", 0), ("d", 1)], "dataset_id string, source_row_no long")
    with pytest.raises(Exception, match="outside the population"):
        commits.insert_results(*rows_of(spark, "a", [0, 1]), path, population)
    assert commits.snapshot(spark, path).version == 0 and commits.snapshot(spark, path).table("results") is None
    assert commits.insert_results(*rows_of(spark, "a", [0]), path, population) == 1


def test_commits_are_made_anew_for_the_next_snapshot(spark, tmp_path):
    path, seen = str(tmp_path / "t"), []

    def add(base):
        if not seen:
            commits.claimed(spark, path, 1, commits.written({"t": spark.range(3)}, path), ["t"])
        seen.append(base.version)
        return {"t": spark.range(base.table("t").count() if base.version else 0, 5)}

    assert commits.commit(spark, path, add) == 2 and seen == [0, 1]
    assert sorted(r.id for r in commits.snapshot(spark, path).table("t").collect()) == list(range(5))
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, lambda base: commits.claimed(spark, path, base.version + 1, "x", []) and {"t": spark.range(1)}, most_tries=2)


def test_a_file_is_put_once(spark, tmp_path):
    path = str(tmp_path / "log" / "1")
    assert commits.put_if_absent(spark, path, "one") and not commits.put_if_absent(spark, path, "two")
    assert open(path).read() == "one" and len(list((tmp_path / "log").iterdir())) == 1
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.once.link./in", f"file://{tmp_path}")
    assert commits.put_if_absent(spark, "viewfs://once/in/log/2", "one") and not commits.put_if_absent(spark, "viewfs://once/in/log/2", "two")
    assert (tmp_path / "log" / "2").read_text() == "one"


EXCEPTION = "exception_id string, arrival long, event_type string, actor_id string, engagement_id string, result_id string, to_status string, note string, title string, idempotency_key string, has_concluded_finding boolean"


def exception_rows(spark):
    made = ("x", 1, "CREATE", "ann", "e1", "r1", None, None, "t", "k1", False)
    rows = [
        ("x", 0, "LINK", "ann", "e1", "r2", None, None, None, "k0", False),  # NOT_FOUND
        made,
        (*made[:1], 2, *made[2:]),  # REPEATED
        ("x", 3, "CREATE", "ann", "e1", "r2", None, None, "t", "k1", False),  # CONFLICT
        ("x", 4, "LINK", "bob", "e1", "r2", None, None, None, "k2", False),
        ("x", 5, "LINK", "bob", "e1", "other", None, None, None, "k3", False),  # OTHER_ENGAGEMENT
        ("x", 6, "LINK", "bob", "e1", "none", None, None, None, "k3", False),  # NO_RESULT
        ("x", 7, "LINK", "eve", "e1", "r3", None, None, None, "k3", False),  # NOT_MEMBER
        ("x", 8, "UNLINK", "bob", "e1", "r1", None, None, None, "k3", False),
        ("x", 9, "STATUS", "bob", "e1", None, "CLOSED_NO_FINDING", " ", None, "k4", False),  # NO_RATIONALE
        ("x", 10, "STATUS", "bob", "e1", None, "CONCLUDED_WITH_FINDING", None, None, "k4", False),  # NO_CONCLUDED_FINDING
        ("x", 11, "STATUS", "bob", "e1", None, "CONCLUDED_WITH_FINDING", None, None, "k4", True),
        ("x", 12, "REOPEN", "ann", "e1", None, "UNDER_INVESTIGATION", "new", None, "k5", True),
        ("x", 13, "REOPEN", "ann", "e1", None, "UNDER_INVESTIGATION", "else", None, "k5", True),  # CONFLICT
        ("y", 1, "MERGE", "ann", "e1", None, None, None, None, "k1", False),  # NOT_FOUND
    ]
    return spark.createDataFrame(rows, EXCEPTION)


OUTCOMES = "NOT_FOUND ACCEPTED REPEATED CONFLICT ACCEPTED OTHER_ENGAGEMENT NO_RESULT NOT_MEMBER ACCEPTED NO_RATIONALE NO_CONCLUDED_FINDING ACCEPTED ACCEPTED CONFLICT NOT_FOUND".split()


def guarded(spark, rows):
    known = spark.createDataFrame([("e1", "ann"), ("e1", "bob"), ("e1", "bob")], "engagement_id string, user_id string")
    results = spark.createDataFrame([("r1", "e1"), ("r2", "e1"), ("r3", "e1"), ("other", "e2")], "result_id string, engagement_id string")
    return events.with_exception_guards(rows, known, results)


def test_exception_events_in_order(spark):
    judged = events.judged_in_order(guarded(spark, exception_rows(spark)), "exception_id", events.judge_exception).orderBy("exception_id", "arrival").collect()
    assert [r.outcome for r in judged] == OUTCOMES
    assert [r.event_seq for r in judged if r.outcome == "ACCEPTED"] == [2, 3, 4, 5, 6]
    assert [r.n_links for r in judged][:9] == [0, 1, 1, 1, 2, 2, 2, 2, 1]
    assert [r.status for r in judged][-4:] == ["CONCLUDED_WITH_FINDING", "UNDER_INVESTIGATION", "UNDER_INVESTIGATION", None]
    assert events.judged_in_order(guarded(spark, exception_rows(spark).limit(0)), "exception_id", events.judge_exception).count() == 0


def test_finding_events_in_order(spark):
    rows = [("CREATE", "ann", None, "c1", "k1"), ("APPROVE", "bob", 1, None, "k1"), ("REVISE", "ann", None, "c2", "k2"), ("REVISE", "ann", None, "c2", "k2"), ("REVISE", "ann", None, "c3", "k2"), ("SUBMIT", "ann", None, None, "k3"), ("SUBMIT", "ann", None, None, "k3")]
    rows += [("SUBMIT", "ann", None, None, "k9"), ("APPROVE", "bob", 1, None, "k4"), ("APPROVE", "ann", 2, None, "k4"), ("APPROVE", "eve", 2, None, "k4"), ("RETURN", "bob", 2, None, "k4"), ("REVISE", "bob", None, "c4", "k5"), ("SUBMIT", "bob", None, None, "k5"), ("APPROVE", "ann", 3, None, "k6"), ("REVISE", "ann", None, "c5", "k7")]
    df = spark.createDataFrame([("f", i, kind, actor, "e1", version, content, key, True) for i, (kind, actor, version, content, key) in enumerate(rows)], "finding_id string, arrival long, event_type string, actor_id string, engagement_id string, version_no long, content_hash string, idempotency_key string, has_active_link boolean")
    known = spark.createDataFrame([("e1", "ann"), ("e1", "bob")], "engagement_id string, user_id string")
    judged = events.judged_in_order(events.with_actors(df, known), "finding_id", events.judge_finding).orderBy("arrival").collect()
    assert [r.outcome for r in judged] == "ACCEPTED NOT_IN_REVIEW ACCEPTED REPEATED CONFLICT ACCEPTED REPEATED NOT_DRAFT NOT_CURRENT OWN_WORK NOT_MEMBER ACCEPTED ACCEPTED ACCEPTED ACCEPTED NOT_DRAFT".split()
    assert judged[-1].status == "CONCLUDED" and judged[-1].version_no_now == 3 and judged[-2].event_seq == 4


def test_a_restarted_stream_goes_on_from_its_state(spark, tmp_path):
    rows = guarded(spark, exception_rows(spark)).select(*exception_rows(spark).columns, "actor_is_member", "result_engagement")
    found = []
    for number, part in enumerate(("arrival < 6", "arrival >= 6")):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        out = matters.judged_stream(stream, "exception_id", events.judge_exception)
        run = out.writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination(120)
    found.sort(key=lambda r: (r.exception_id, r.arrival))
    assert [r.outcome for r in found] == OUTCOMES and [r.event_seq for r in found if r.outcome == "ACCEPTED"] == [2, 3, 4, 5, 6]
