"""Literal facts of the audit engine's operators."""

import hashlib
import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import framing, money, timeparts
from ledgerloom.operators import accounting, analyzers, executors, ingest, reconcile, rules, runs, workflow
from ledgerloom.sources import delimited, objects, sinks

TX = "row_no long, id string, reference string, amount decimal(15,2), vat_amount decimal(15,2), counterparty string, account string, posted_at timestamp, value_date timestamp, has_document boolean"


def tx(spark, *rows):
    defaults = {"reference": "R", "amount": "1.00", "vat_amount": None, "counterparty": "ACME", "account": None, "posted_at": "2025-09-03T09:00:00", "value_date": None, "has_document": None}
    out = []
    for i, row in enumerate(rows):
        r = defaults | {"id": f"t{i}"} | row
        stamp = lambda v: None if v is None else datetime.fromisoformat(v)
        number = lambda v: None if v is None else Decimal(v)
        out.append((i, r["id"], r["reference"], number(r["amount"]), number(r["vat_amount"]), r["counterparty"], r["account"], stamp(r["posted_at"]), stamp(r["value_date"]), r["has_document"]))
    return spark.createDataFrame(out, TX)


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_minor_units(spark):
    assert column(spark, ["1234.50", "100", "-0.05", " 7.1 ", None], money.parse_minor_units) == [123450, 10000, -5, 710, None]
    for bad in ("12.345", "1,000", "+1", "x"):
        with pytest.raises(Exception, match="not an amount"):
            column(spark, [bad], money.parse_minor_units)


def test_expected_vat_rounds_halves_away_from_zero(spark):
    assert column(spark, [10000, 3333, -3333, 10, -10, 0], lambda c: money.expected_vat(c, 0.15), "long") == [1500, 500, -500, 2, -2, 0]


def test_canonical_decimals(spark):
    values = ["1,234.50", "٢٥٠٠", "SAR 2,000.75", "-0", "—", "007", "-0.50", "1.2.3", "", None]
    assert column(spark, values, money.canonical_decimal) == ["1234.50", "2500", "2000.75", "0", None, "7", "-0.50", None, None, None]
    assert column(spark, ["1.0000005"], money.micros) == [Decimal("1.000001")]
    assert column(spark, ["1.005", "0.125", "-0.125", "x"], money.float_rounded) == ["1.00", "0.13", "-0.13", None]


def test_dates(spark):
    values = ["2024-02-29", "2024/2/31", "31/12/2024", "12/31/2024", "31/31/2024", "1.2.2024", None, "x"]
    assert [str(x) if x else None for x in column(spark, values, timeparts.parse_date_strict)] == ["2024-02-29", None, "2024-12-31", None, None, "2024-02-01", None, None]
    assert str(column(spark, ["12/31/2024"], lambda c: timeparts.parse_date_strict(c, "MDY"))[0]) == "2024-12-31"


def test_benford(spark):
    def summary(counts):
        rows = [{"amount": f"{d}00.00"} for d, n in enumerate(counts, 1) for _ in range(n)]
        return analyzers.benford_summary(tx(spark, *rows)).first()

    assert not summary([301, 176, 125, 97, 79, 67, 58, 51, 46]).rejects
    assert summary([0, 0, 0, 0, 0, 0, 0, 0, 200]).rejects
    assert analyzers.benford_findings(tx(spark, *[{"amount": "900.00"}] * 49)).count() == 0
    empty = analyzers.benford_digits(tx(spark, {"amount": "0.00"})).orderBy("digit").collect()
    assert [(r.digit, r.observed, r.proportion) for r in empty] == [(d, 0, 0.0) for d in range(1, 10)]


def test_duplicates(spark):
    rows = tx(
        spark,
        {"reference": "INV-1", "amount": "500.00", "counterparty": "ACME", "posted_at": "2025-07-01T00:00:00"},
        {"reference": " inv-1", "amount": "500.00", "counterparty": "acme ", "posted_at": "2025-07-01T00:00:00"},
        {"reference": "INV-2", "amount": "500.00", "posted_at": "2025-07-02T00:00:00"},
        {"reference": "INV-3", "amount": "500.00", "posted_at": "2025-07-29T00:00:00"},
    )
    assert [r.ids for r in analyzers.exact_duplicates(rows).collect()] == [["t0", "t1"]]
    near = analyzers.near_duplicates(rows).orderBy("first_row", "second_row").collect()
    assert [(r.first_id, r.second_id, r.hours_apart) for r in near] == [("t0", "t2", 24), ("t1", "t2", 24)]


def test_hours(spark):
    rows = tx(spark, {"posted_at": "2025-09-02T00:00:00"}, {"posted_at": "2025-09-05T09:00:00"}, {"posted_at": "2025-09-03T09:00:00"})
    assert [r.id for r in analyzers.off_hours_postings(rows).collect()] == ["t0"]
    assert [r.id for r in analyzers.weekend_postings(rows).collect()] == ["t1"]
    rule = rules.Rule("X", "LOW", {"type": "time_window", "mode": "off_hours", "startHour": 13})
    assert {r.id for r in rules.matching(rows, rule).collect()} == {"t0", "t1", "t2"}


def test_vat(spark):
    rows = tx(spark, {"amount": "1000.00", "vat_amount": "150.00"}, {"amount": "1000.00", "vat_amount": "100.00"}, {"amount": "1000.00"}, {"amount": "0.00", "vat_amount": "9.00"})
    assert [(r.id, r.delta, r.severity, r.score) for r in analyzers.vat_discrepancies(rows).collect()] == [("t1", -5000, "HIGH", 80)]


def test_engine_ranks(spark):
    rows = tx(spark, {"reference": "A", "amount": "5.00"}, {"reference": "A", "amount": "5.00"}, {"posted_at": "2025-09-05T09:00:00"})
    assert [(r.code, r.score) for r in analyzers.audit_engine(rows).collect()] == [("DUPLICATE", 85), ("WEEKEND", 45)]


def test_rules(spark):
    rows = tx(spark, {"amount": "9800.00"}, {"amount": "10000.00"}, {"amount": "5000.00", "has_document": False}, {"amount": "5123.45", "counterparty": " "})
    ids = lambda d: [r.id for r in rules.matching(rows, rules.Rule("X", "LOW", d)).orderBy("row_no").collect()]
    assert ids({"type": "threshold_avoidance", "limit": 10000, "marginPct": 5}) == ["t0"]
    assert ids({"type": "round_amount", "minTrailingZeros": 3}) == ["t1", "t2"]
    assert ids({"type": "missing_field", "field": "document"}) == ["t2"]
    assert ids({"type": "missing_field", "field": "counterparty"}) == ["t3"]
    assert ids({"type": "value_list", "field": "counterparty", "mode": "deny", "values": ["acme"]}) == ["t0", "t1", "t2"]
    assert ids({"type": "value_list", "field": "counterparty", "mode": "allow", "values": ["ACME"]}) == ["t3"]
    assert ids({"type": "field_compare", "field": "amount", "op": "between", "value": 5000}) == []
    assert rules.evaluate(rows, [rules.Rule("X", "LOW", {"type": "nonsense"})]).count() == 0


def test_aggregate_rules(spark):
    rows = tx(spark, {"amount": "30000.00", "posted_at": "2025-09-03T00:00:00"}, {"amount": "25000.00", "posted_at": "2025-09-04T00:00:00"}, {"amount": "25000.00", "posted_at": "2025-09-09T00:00:00"}, {"amount": "30000.00", "counterparty": "OTHER"})
    found = {r.rule: r.ids for r in rules.evaluate(rows, [r for r in rules.LIBRARY if r.definition["type"] == "aggregate"]).collect()}
    assert found == {"DUP-PAYMENTS": ["t1", "t2"], "SPLIT-PAY": ["t0", "t1"]}


def test_groups_without_members(spark):
    """Queries that show a group's first row and its size hold no list of its rows."""
    rows = tx(spark, *({"amount": "30000.00", "counterparty": "ONE", "reference": "R", "posted_at": "2025-09-03T00:00:00"} for _ in range(5)))
    lists = lambda df: "collect_list" in df._jdf.queryExecution().optimizedPlan().toString()
    engine, library = analyzers.audit_engine(rows, with_ids=False), rules.stored(rules.evaluate(rows, list(rules.LIBRARY), with_ids=False))
    assert not lists(engine) and not lists(library)
    assert [(r.ids, r.n_ids) for r in engine.where("code = 'DUPLICATE'").collect()] == [(["t0"], 5)]
    key = lambda found: sorted(tuple(r) for r in found.collect())
    assert key(library) == key(rules.stored(rules.evaluate(rows, list(rules.LIBRARY))))


REC = "idx long, id string, reference string, amount decimal(15,2), counterparty string, value_date timestamp"


def greedy(pairs):
    used_s, used_t, out = set(), set(), []
    for p in sorted(pairs, key=lambda p: (-p.confidence, p.source_idx, p.target_idx)):
        if p.source_idx not in used_s and p.target_idx not in used_t:
            used_s.add(p.source_idx), used_t.add(p.target_idx), out.append((p.source_idx, p.target_idx))
    return sorted(out)


def test_reconcile_equals_greedy(spark):
    draw = random.Random(4)
    side = lambda n: spark.createDataFrame([(i, f"x{i}", f"r{draw.randint(0, 9)}", Decimal(draw.randint(100, 160)) / 100, draw.choice(["a", "b", ""]), datetime(2025, 1, draw.randint(1, 28))) for i in range(n)], REC)
    source, target = side(60), side(60)
    pairs = reconcile.candidates(source, target, reconcile.Settings(10, 5, 0.5)).persist()
    assert sorted((r.source_idx, r.target_idx) for r in reconcile.greedy_matches(pairs).collect()) == greedy(pairs.collect())
    with pytest.raises(ValueError):
        reconcile.Settings(window_days=0)


def test_import(spark):
    headers = ["الحساب", "التاريخ", "مدين", "مدين", "دائن"]
    rows = spark.createDataFrame([(1, ["100", "01/02/2024", "1,000.50", "5", ""]), (2, ["100", "31/31/2024", "", "", "7"])], "source_row_no long, values array<string>")
    cells = rows.select("source_row_no", ingest.raw_cells(headers, F.col("values")).alias("cells"))
    first, second = ingest.prepare_rows(cells, "GENERAL_LEDGER", ingest.suggest_mapping("GENERAL_LEDGER", headers)).orderBy("source_row_no").collect()
    assert (first.status, first.normalized["debit"], first.normalized["postingDate"]) == ("ACCEPTED_WITH_WARNING", "1000.50", "2024-02-01")
    assert (second.status, second.normalized, [i.code for i in second.issues]) == ("REJECTED", None, ["INVALID_DATE"])
    assert len([c for c in first.cells if c.h == "مدين"]) == 2


def test_framing(spark):
    frames = column(spark, ["", "a", None, "x" * 200, "y" * 20000], framing.text)
    assert [bytes(x) for x in frames] == [ingest.frame(v) for v in ("", "a", None, "x" * 200, "y" * 20000)]
    row = spark.range(1).select(framing.raw_hash(F.array(F.struct(F.lit(1).alias("i"), F.lit("h").alias("h"), F.lit(None).cast("string").alias("v")), F.struct(F.lit(0).alias("i"), F.lit("g").alias("h"), F.lit("é").alias("v")))).alias("h"), framing.population_fold(F.array(F.unhex(F.lit("01")), F.unhex(F.lit("02")))).alias("f")).first()
    body = b"\x02" + b"".join(map(ingest.frame, ("0", "g", "é", "1", "h", None)))
    assert row.h == hashlib.sha256(body).hexdigest()
    chain = hashlib.sha256(b"g4pop.seed").hexdigest()
    for member in (b"\x01", b"\x02"):
        chain = hashlib.sha256(bytes.fromhex(chain) + member).hexdigest()
    assert row.f == hashlib.sha256(ingest.frame("g4pop.2") + b"\x02\x02" + ingest.frame(chain) + ingest.frame("2")).hexdigest()


GL = "dataset_id string, source_entry_id string, source_row_no long, entry_date date, transaction_debit decimal(24,6), transaction_credit decimal(24,6), transaction_currency string, functional_debit decimal(24,6), functional_credit decimal(24,6), functional_currency string"


def ledger(spark, *rows):
    number = lambda v: None if v is None else Decimal(v)
    return spark.createDataFrame([("d", e, i + 1, None, number(a), number(b), c, *(more or (None, None, None))) for i, (e, a, b, c, *more) in enumerate(rows)], GL)


def test_balance(spark):
    lines = ledger(spark, ("E1", "100", None, "USD"), ("E1", None, "100", "USD"), ("E2", "100", None, "USD"), ("E2", None, "60", "USD"), ("E3", "100", None, "USD"), ("E3", None, "100", "EUR"), ("E4", "1", None, None))
    found = {r.source_entry_id: (r.balance_capability, r.balance_status, r.difference) for r in accounting.entries(lines).collect()}
    assert found["E1"] == ("AVAILABLE", "BALANCED", Decimal("0.000000")) and found["E2"] == ("AVAILABLE", "UNBALANCED", Decimal("40.000000"))
    assert found["E3"] == ("PARTIAL", "NOT_EVALUABLE", None) and found["E4"] == ("NOT_AVAILABLE", "NOT_EVALUABLE", None)
    members = lines.select("dataset_id", "source_row_no")
    assert [r.source_entry_id for r in executors.unbalanced_entries(members, lines).collect()] == ["E2"]
    with pytest.raises(Exception, match="partly"):
        executors.unbalanced_entries(members.where("source_row_no <> 4"), lines).collect()


def test_invalid_sides(spark):
    lines = ledger(spark, ("a", "-5", None, "X"), ("a", None, "-3", "X"), ("a", "5", "3", "X"), ("a", "-7", "-2", "X"), ("a", "9", None, "X"))
    found = executors.invalid_sides(lines.select("dataset_id", "source_row_no"), lines).orderBy("source_row_no").collect()
    assert [r.reasons for r in found] == ["NEGATIVE_DEBIT", "NEGATIVE_CREDIT", "BOTH_SIDED", "NEGATIVE_DEBIT,NEGATIVE_CREDIT,BOTH_SIDED"]


def test_statistical_tests(spark):
    lines = ledger(spark, *[("a", v, w, "SAR") for v, w in (("100", None), ("200", None), (None, "300"), ("150", None), ("5", "3"), ("-100", None), ("0", None), ("100.000001", None))], ("a", "50", None, "sar"), ("a", "50.00", None, "sar"), ("a", "50.000000", None, "sar"))
    members = lines.select("dataset_id", "source_row_no")
    settings = executors.RoundNumbers.parse({"roundingQuantum": "100", "minimumPopulation": 5, "minimumRoundCount": 3, "rateThresholdNum": 3, "rateThresholdDenom": 5})
    assert [(r.transaction_currency, r.population, r.n_round) for r in executors.round_frequency(members, lines, settings).collect()] == [("SAR", 5, 3)]
    assert [(r.transaction_currency, r.scalar, r.n) for r in executors.duplicate_amounts(members, lines).collect()] == [("sar", "50.000000", 3)]
    assert [r.source_row_no for r in executors.duplicate_evidence(members, lines, k=2).orderBy("position").collect()] == [9, 10]
    for bad in ({"roundingQuantum": "0"}, {"rateThresholdNum": 2, "rateThresholdDenom": 4}, {"minimumPopulation": True}):
        with pytest.raises(executors.ConfigurationError):
            executors.RoundNumbers.parse({"roundingQuantum": "1", "minimumPopulation": 1, "minimumRoundCount": 1, "rateThresholdNum": 1, "rateThresholdDenom": 2} | bad)
    with pytest.raises(executors.ConfigurationError):
        executors.executor("ANALYTICAL", "ANY")


def test_results_are_inserted_once(spark):
    results = spark.createDataFrame([("f", "r", "a"), ("f", "r", "a"), ("f", "r", "b")], "firm_id string, run_id string, occurrence_fingerprint string")
    assert [r.occurrence_fingerprint for r in runs.new_results(results, results.where("occurrence_fingerprint = 'b'")).collect()] == ["a"]
    members = spark.createDataFrame([("d", 1)], "dataset_id string, source_row_no long")
    with pytest.raises(Exception, match="outside"):
        runs.guarded_evidence(spark.createDataFrame([("d", 2)], "dataset_id string, source_row_no long"), members).collect()


def test_workflow(spark):
    events = spark.createDataFrame([("r", 1, "MARK_EXPLAINED"), ("r", 2, "REQUIRE_INVESTIGATION"), ("r", 2, "REQUIRE_INVESTIGATION")], "result_id string, event_seq long, action string")
    results = spark.createDataFrame([("r",), ("s",)], "result_id string")
    assert {r.result_id: r.state for r in workflow.with_disposition(results, events).collect()} == {"r": "INVESTIGATING", "s": "UNREVIEWED"}
    assert workflow.FeedFilter.from_query({"severity": "ALL", "q": " x ", "other": "1"}) == workflow.FeedFilter(severity="ALL", search="x")


def test_delimited_sources(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_bytes("﻿code;nameAr;amount\r\nA;\"1;000\";\"say \"\"x\"\"\"\r\n ; ;\r\nB;\"two\nlines\";3\r\n".encode())
    assert delimited.detect_delimiter(spark, str(path)) == ";"
    headers, rows = delimited.read_positional(spark, str(path))
    assert headers == ["code", "nameAr", "amount"]
    assert [(r.source_row_no, r.cells) for r in rows.orderBy("source_row_no").collect()] == [(1, ["A", "1;000", 'say "x"']), (2, ["B", "two\nlines", "3"])]
    assert delimited.read_objects(spark, str(path)).columns == ["source_row_no", "code", "nameAr", "amount"]
    table = spark.createDataFrame([("A", "n", "high", "", "", '{"type": "round_amount"}'), ("B", "n", "odd", "", "", "{"), ("", "n", "", "", "", "{}")], ", ".join(f"{c} string" for c in delimited.RULE_COLUMNS))
    good, bad = delimited.read_rules(table)
    assert [(r.code, r.severity, r.category) for r in good.collect()] == [("A", "HIGH", "round_amount")]
    assert {r.reason for r in bad.collect()} == {"INVALID_JSON", "MISSING_CODE"}
    assert sinks.template(("a", 'b"')) == '﻿"a","b"""\r\n'.encode()


def test_objects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a", b"x"), ("b", b"x"), ("c", b"y")):
        (tmp_path / "in" / name).write_bytes(data)
    store = str(tmp_path / "store")
    for _ in range(2):
        assert objects.put_objects(spark, str(tmp_path / "in"), store).count() == 2
    assert objects.get_object(spark, store, hashlib.sha256(b"y").hexdigest()) == b"y"
    lines = objects.parse_documents(spark, str(tmp_path / "in"), lambda name, data: [{"reference": "r", "description": data.decode(), "amount": "1"}, {"reference": "r"}])
    assert sorted(r.description for r in lines.collect()) == ["x", "x", "y"]


def test_amounts_of_an_import(spark):
    """Amounts are rounded as binary doubles; no cell ends an import."""
    import random as r
    from decimal import ROUND_HALF_UP, localcontext

    draw = r.Random(8)
    written = ["1.005", "0.125", "-0.125", "2.675", "-0.001", "-0", "9" * 30, "9" * 21, "99999999999999999999.5", "1٫5", "x", "1e5"]
    written += [f"{draw.choice(['', '-'])}{draw.randint(0, 10 ** draw.randint(0, 18))}.{draw.randint(0, 10 ** draw.randint(1, 9))}" for _ in range(400)]

    def expected(text):
        kept = "".join(c for c in text if c in "0123456789.-")
        if not kept or kept in "x" or float(kept) >= 1e21:
            return None
        with localcontext() as context:
            context.prec = 60
            shown = format(Decimal(float(kept)).quantize(Decimal("0.01"), ROUND_HALF_UP), "f")
        return shown.removeprefix("-") if float(kept) == 0 else shown

    rows = spark.createDataFrame(list(enumerate(written)), "source_row_no long, v string")
    cells = rows.select("source_row_no", ingest.raw_cells(["transaction date", "amount"], F.array(F.lit("1/2/2024"), "v")).alias("cells"))
    mapping = ingest.suggest_mapping("BANK", ["transaction date", "amount"])
    for headers in (None, ["transaction date", "amount"]):
        found = ingest.prepare_rows(cells, "BANK", mapping, headers=headers).orderBy("source_row_no").collect()
        assert [f.normalized and f.normalized["amount"] for f in found] == [expected(w) for w in written]
        assert {i.code for f in found if not f.normalized for i in f.issues} == {"INVALID_AMOUNT"}
    assert column(spark, written, money.float_rounded) == [expected(w) for w in written]


def test_long_frames(spark):
    for n in (127, 128, 2**14, 2**21 - 1, 2**21, 2**31, 2**42, 2**63 - 1):
        assert bytes(column(spark, [n], framing.leb128, "long")[0]) == ingest._leb128(n)


def test_dataset_hash_streams(spark):
    """More than 2**21 rows, in pieces and partitions of any order, hash as one sequence."""
    n, head = 2_200_000, {"datasetKind": "OTHER"}
    rows = spark.range(n).repartition(5).select(F.col("id").alias("source_row_no"), F.sha2(F.col("id").cast("string"), 256).alias("raw_hash"))
    found = ingest.dataset_hash(rows, head).first()
    running = hashlib.sha256(ingest._object(head) + ingest._leb128(n))
    for i in range(n):
        running.update(hashlib.sha256(str(i).encode()).digest())
    assert (found.dataset_hash, found.n_rows) == (running.hexdigest(), n)
    assert ingest.dataset_hash(rows.limit(0), head).count() == 0 and len(ingest.empty_dataset_hash(head)) == 64


def test_ragged_rows_keep_their_cells(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_bytes('a,b\r\n1,2,3,4\r\n"x\r\ny","q"",""",,"5\r"\r\n\r\n6\r\n7,"open, and\nno end'.encode())
    headers, rows = delimited.read_positional(spark, str(path))
    assert headers == ["a", "b", None, None]
    assert [r.cells for r in rows.orderBy("source_row_no").collect()] == [["1", "2", "3", "4"], ["x\r\ny", 'q","', "", "5\r"], ["6", "", "", ""], ["7", "open, and\nno end", "", ""]]
    path.write_text("only,headers\n")
    assert delimited.read_positional(spark, str(path))[1].count() == 0
    path.write_text("")
    assert delimited.read_positional(spark, str(path))[0] == []


def test_records_across_parts_of_a_file(spark, tmp_path):
    """Quoted line breaks may cross the parts in which a file is read."""
    draw = random.Random(5)
    lines = [[str(i), "\n".join("w" * draw.randint(0, 40) for _ in range(draw.randint(1, 6))), draw.choice(["", 'say "x"'])] for i in range(400)]
    quoted = lambda v: '"' + v.replace('"', '""') + '"'
    path = tmp_path / "long.csv"
    path.write_text("id,text,more\n" + "".join(",".join(map(quoted, r)) + "\n" for r in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        _, rows = delimited.read_positional(spark, str(path))
        assert [r.cells for r in rows.orderBy("source_row_no").collect()] == lines
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_workbooks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "<a>", "1.50"), (3, "c", "2")], "at int, name string, amount string")
    books = sinks.export_workbooks(rows, {"name": "الاسم", "amount": "المبلغ"}, ["at"], rows_per_book=2).orderBy("book").collect()
    assert len(books) == 2
    for book in books:
        (tmp_path / f"{book.book}.xlsx").write_bytes(bytes(book.content))
    read = delimited.read_workbooks(spark, str(tmp_path)).orderBy("path", "source_row_no").collect()
    assert [r.cells for r in read] == [["الاسم", "المبلغ"], ["<a>", "1.50"], ["b", "—"], ["الاسم", "المبلغ"], ["c", "2"]]
    objects_found = delimited.read_workbook_objects(spark, str(tmp_path)).orderBy("path", "source_row_no").collect()
    assert [(r.source_row_no, r["values"]) for r in objects_found] == [(1, {"الاسم": "<a>", "المبلغ": "1.50"}), (2, {"الاسم": "b", "المبلغ": "—"}), (1, {"الاسم": "c", "المبلغ": "2"})]


def test_matching_by_rounds_equals_one_pass(spark):
    draw = random.Random(6)
    side = lambda n: spark.createDataFrame([(i, f"x{i}", "r", Decimal(draw.randint(100, 900)) / 100, "p", datetime(2025, 1, draw.randint(1, 9))) for i in range(n)], REC)
    for tolerance in (0, 3):
        pairs = reconcile.candidates(side(80), side(80), reconcile.Settings(10, tolerance, 0.1)).persist()
        expected = greedy(pairs.collect())
        for most in (1_000_000, 3, 0):
            assert sorted((r.source_idx, r.target_idx) for r in reconcile.greedy_matches(pairs, most).collect()) == expected


PAIR = "source_idx long, source_id string, target_idx long, target_id string, delta long, days double, confidence double, source_band long, target_band long"


def chain(n, start=0):
    """n pairs in a row, each of which competes with the next and ranks before it."""
    ends = [(start + (k + 1) // 2, start + k // 2) for k in range(n)]
    return [(s, f"s{s}", t, f"t{t}", 0, 0.0, 1 - k / (4 * n), 1, 1) for k, (s, t) in enumerate(ends)]


def test_a_chain_of_a_large_island_takes_few_rounds(spark, monkeypatch):
    passes = []
    one_pass = reconcile._in_one_pass
    monkeypatch.setattr(reconcile, "_in_one_pass", lambda pairs: passes.append(1) or one_pass(pairs))
    others = [p for i in range(300) for p in chain(3, 20_000 + 10 * i)]
    rows = chain(10_000) + others
    pairs = spark.createDataFrame(rows, PAIR)
    found = reconcile.greedy_matches(pairs, 1_000).select("source_idx", "target_idx").collect()
    assert sorted(map(tuple, found)) == greedy(pairs.collect())
    assert len(found) == 5_000 + 2 * 300 and len(passes) < 20 + 2


def test_components_of_pairs(spark):
    rows = chain(40) + chain(7, 1000) + chain(1, 50)
    parts = {}
    for r in reconcile.components(spark.createDataFrame(rows, PAIR).select("source_idx", "target_idx")).collect():
        parts.setdefault(r.part, set()).add((r.source_idx, r.target_idx))
    assert sorted(map(len, parts.values())) == [1, 7, 40]


def test_attempts_of_a_window(spark):
    draw = random.Random(7)
    rows = [(i, draw.choice("ab"), None if i % 9 == 0 else datetime.fromtimestamp(1_700_000_000 + draw.randint(0, 9000))) for i in range(200)]
    found = {r.i: r.attempts for r in workflow.attempts_in_window(spark.createDataFrame(rows, "i int, who string, at timestamp"), "who", "at").collect()}
    for i, who, at in rows:
        same = [t for _, w, t in rows if w == who and (t is None if at is None else t is not None and 0 <= (at - t).total_seconds() <= 900)]
        assert found[i] == len(same)
