"""Length-framed byte encodings and the content identities hashed from them.

A frame says what it holds and how long it is, so that no two different values share one:
null is 00, text is 01, sequences, field sets and multisets are 02, 03 and 04 with their count.
All are binary column expressions; identities are lower-case SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what the seed of a population chain is hashed from.
FOLD_SEED_TEXT = "g4pop.seed"


def _byte(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value), 2, "0"))


def leb128(n: Column, bits: int = 63) -> Column:
    """Unsigned LEB128 of an integer from 0 to 2**bits - 1."""
    n = n.cast("long")
    low, middle, high = n % 128, F.shiftright(n, 7) % 128, F.shiftright(n, 14)
    short = F.when(n < 128, _byte(low)).when(n < 1 << 14, F.concat(_byte(low + 128), _byte(middle)))
    three = F.concat(_byte(low + 128), _byte(middle + 128), _byte(high))
    if bits <= 21:
        return short.otherwise(three)
    more = F.concat(_byte(low + 128), _byte(middle + 128), _byte(high % 128 + 128), leb128(F.shiftright(n, 21), bits - 21))
    return short.when(n < 1 << 21, three).otherwise(more)


def text(value: Column) -> Column:
    """Frame of a string; null and empty differ."""
    data = F.encode(value, "UTF-8")
    return F.when(value.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), leb128(F.octet_length(data), 31), data))


def integer(value: Column) -> Column:
    """Frame of an integer, as decimal text."""
    return text(value.cast("string"))


def joined(frames: Column) -> Column:
    """Bytes of an array of frames, one after the other."""
    return F.unhex(F.array_join(F.transform(frames, lambda x: F.hex(x)), ""))


def sequence(frames: Column | list[Column]) -> Column:
    """Frame of frames in order: of an array, or of a list of columns, which is cheaper."""
    if isinstance(frames, list):
        return F.concat(F.unhex(F.lit("02")), leb128(F.lit(len(frames)), 31), *frames)
    return F.concat(F.unhex(F.lit("02")), leb128(F.size(frames), 31), joined(frames))


def multiset(frames: Column) -> Column:
    """Frame of an array of frames whose order doesn't matter but whose repeats do."""
    return F.concat(F.unhex(F.lit("04")), leb128(F.size(frames), 31), joined(F.array_sort(frames)))


def fields(**frames: Column) -> Column:
    """Frame of named frames; names are ASCII and sorted."""
    parts = [part for name in sorted(frames) for part in (text(F.lit(name)), frames[name])]
    return F.concat(F.unhex(F.lit("03")), leb128(F.lit(len(frames)), 31), *parts)


def fingerprint(tag: str, body: Column) -> Column:
    """SHA-256 of a tagged frame."""
    return F.sha2(F.concat(text(F.lit(tag)), body), 256)


def raw_hash(cells: Column) -> Column:
    """Identity of a source row: its cells (i, h, v) by position."""
    ordered = F.array_sort(cells, lambda a, b: a["i"] - b["i"])
    parts = F.transform(ordered, lambda c: F.concat(text(c["i"].cast("string")), text(c["h"]), text(c["v"])))
    return F.sha2(F.concat(leb128(F.size(cells), 31), joined(parts)), 256)


def object_frame(**values: Column) -> Column:
    """Untagged frame of named strings, sorted by name."""
    parts = [part for name in sorted(values) for part in (text(F.lit(name)), text(values[name]))]
    return F.concat(leb128(F.lit(len(values)), 31), *parts)


def record_identity(dataset_hash: Column, source_row_no: Column, hashed: Column) -> Column:
    """Identity of an imported record within a dataset's content."""
    return fingerprint("g4eoi.1", sequence([text(dataset_hash), integer(source_row_no), text(hashed)]))


def account_identity(dataset_hash: Column, system: Column, entity: Column, ledger: Column, code: Column) -> Column:
    """Identity of a source account."""
    return fingerprint("g4da.1", fields(datasetHash=text(dataset_hash), sourceSystem=text(system), sourceEntity=text(entity), sourceLedger=text(ledger), sourceAccountCode=text(code)))


def target_account_identity(scope_key: Column, code: Column) -> Column:
    return fingerprint("g4acct.1", fields(scopeKey=text(scope_key), accountCode=text(code)))


def mapping_identity(account: Column, version: Column, basis: Column, scope_key: Column, code: Column) -> Column:
    return fingerprint("g4map.1", fields(datasetAccount=text(account), mappingVersion=integer(version), basis=text(basis), targetAccount=text(target_account_identity(scope_key, code))))


def journal_entry_identity(dataset_hash: Column, entry_id: Column) -> Column:
    return fingerprint("g4je.1", fields(datasetHash=text(dataset_hash), sourceEntryId=text(entry_id)))


def scope_anchor(license_no: Column, client_key: Column, fiscal_year: Column) -> Column:
    return fingerprint("g4scope.1", fields(firmLicenseNo=text(license_no), clientSemanticKey=text(client_key), fiscalYear=integer(fiscal_year)))


def stat_population_identity(dataset_hash: Column, currency: Column, basis: Column, method: Column, population: Column, scalar: Column | None = None) -> Column:
    """Identity of a statistical population, or of an amount group of it if `scalar` is given."""
    parts = {"datasetHash": text(dataset_hash), "currency": text(currency), "amountBasis": text(basis), "methodVersion": text(method), "eligiblePopulationFingerprint": text(population)}
    if scalar is None:
        return fingerprint("g4statpop.1", fields(**parts))
    return fingerprint("g4statgrp.1", fields(**parts, scalarAmount=text(scalar)))


def parameters_identity(parameters: dict[str, str | int | bool | None]) -> Column:
    """Identity of a test's effective parameters; scalars only."""
    if any(not isinstance(v, (str, int, bool, type(None))) for v in parameters.values()):
        raise TypeError("parameters must be scalars")
    shown = {k: F.lit(None).cast("string") if v is None else F.lit(str(v).lower() if isinstance(v, bool) else str(v)) for k, v in parameters.items()}
    return fingerprint("g4param.1", fields(**{k: text(v) for k, v in shown.items()}))


def occurrence_identity(run_id: Column, test_version_id: Column, code: Column, evidence: Column) -> Column:
    """Identity of a result within its run; evidence: array of identities, in order."""
    return fingerprint("g4occ.2", fields(runId=text(run_id), auditRunTestVersionId=text(test_version_id), resultCode=text(code), evidence=sequence(F.transform(evidence, text))))


def result_identity(anchor: Column, test_key: Column, test_version: Column, version_hash: Column, rule_hash: Column, parameters: Column, dependencies: Column, code: Column, evidence: Column, payload: Column) -> Column:
    """Identity of a result across runs; payload: its frame, dependencies: array of mapping identities."""
    test = fields(key=text(test_key), version=integer(test_version), versionHash=text(version_hash))
    return fingerprint("g4sem.3", fields(scopeAnchor=text(anchor), test=test, rule=text(rule_hash), effectiveParametersHash=text(parameters), dependencies=multiset(F.transform(dependencies, text)), resultCode=text(code), evidence=sequence(F.transform(evidence, text)), payload=payload))


def population_fold(members: Column, tag: str = "g4pop.2") -> Column:
    """Fingerprint of an ordered array of member bytes: a chain of hashes, sealed with their count."""
    seed = F.sha2(F.encode(F.lit(FOLD_SEED_TEXT), "UTF-8"), 256)
    chain = F.aggregate(members, seed, lambda hashed, member: F.sha2(F.concat(F.unhex(hashed), member), 256))
    return population_seal(chain, F.size(members), tag)


def population_seal(chain: Column, members: Column, tag: str = "g4pop.2") -> Column:
    """Fingerprint of a population's chained hash and its number of members."""
    return fingerprint(tag, sequence([text(chain), integer(members)]))


def node(value: Column, kind: str) -> Column:
    """Frame of a payload value: null, bool, int, dec (decimal text), str."""
    tag = {"bool": "b", "int": "i", "dec": "d", "str": "s"}[kind]
    shown = F.when(value, "1").otherwise("0") if kind == "bool" else value.cast("string")
    return F.when(value.isNull(), fields(n=text(F.lit(None).cast("string")))).otherwise(fields(**{tag: text(shown)}))


def node_sequence(nodes: Column) -> Column:
    """Frame of a payload's array of value frames."""
    return fields(seq=sequence(nodes))


def node_object(**nodes: Column) -> Column:
    """Frame of a payload's named value frames."""
    return fields(obj=fields(**nodes))


def matter_key(engagement_id: Column, result: Column) -> Column:
    """What correlates matters: the engagement and the first linked result."""
    return fingerprint("g5mattercorr.1", fields(engagementId=text(engagement_id), semantic=text(result)))


def membership_identity(results: Column) -> Column:
    """Identity of an array of linked results, in any order."""
    return fingerprint("g5members.1", multiset(F.transform(results, text)))


FINDING_TEXTS = ("category", "condition", "criteria", "cause", "effect", "auditorConclusion", "recommendation", "observedCurrency", "estimatedExposureCurrency")
FINDING_AMOUNTS = ("observedAmount", "estimatedExposureAmount")


def finding_identity(content: dict[str, Column]) -> Column:
    """Identity of a finding version's content; equal amounts are equal however they are written."""
    frames = {c: text(content[c]) for c in FINDING_TEXTS} | {c: text(content[c].cast("decimal(24,6)").cast("string")) for c in FINDING_AMOUNTS}
    return fingerprint("g5finding.1", fields(**frames))
