"""How filters interact: what each removes, repeats and removes alone, under every order.

A document's failing filters are a mask of bits. Per part, three histograms over the masks (all
documents, good ones, toxic ones) are rows of an incidence matrix; integer matrices with a row
for each mask and a column for each step of each order turn them into counts. Documents are
only ever counted, so the product is of a few rows per part, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerloom.llm.tables import table

#: Parts whose rows are made at a time.
_PARTS_AT_ONCE = 64
#: The filter that compares documents; the others judge a text by itself.
REPEATS = "E"


def text_filters(text: Column, least_words: int = 100, least_distinct_pct: int = 80, most_upper_pct: int = 10) -> dict[str, Column]:
    """Failure conditions by letter of the filters that judge a text by itself, in exact integers."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    upper = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))  # one byte each
    return {
        "A": F.size(words) < least_words,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * least_distinct_pct,
        "C": upper.cast("long") * 100 > F.char_length(text).cast("long") * most_upper_pct,
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_histograms(docs: DataFrame, labels: DataFrame, part: Column | str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by part and failing filters (bit i: filter i of ABCDE).

    docs: needs doc_id, text and the columns of `part`; labels: doc_id, quality, toxic. Null
    texts count as empty, null parts as the empty string. Filter E fails a row whose text some
    row with a smaller doc_id has too: rows that share the smallest id all pass, and a null id
    is neither smaller nor larger than any. Repeated rows count each; a document that has
    several rows of labels is good (or toxic) if one of them says so. Equal rows are counted
    together before anything is joined, so copies of a row don't meet in one task.
    """
    part = F.col(part) if isinstance(part, str) else part
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    alone = sum((failed.cast("int") * (1 << i) for i, failed in enumerate(text_filters(F.col("text")).values())), F.lit(0))
    counted = own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), alone.alias("alone")).groupBy("doc_id", "part", "digest", "alone").agg(F.count("*").alias("n"))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("quality"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    sums = lambda prefix, when=None: [F.coalesce(F.sum(c if when is None else F.when(when, F.col(c))), F.lit(0)).alias(f"{prefix}{c}") for c in ("n", "good", "bad")]
    rows = counted.join(marked, "doc_id", "left").select("doc_id", "part", "digest", "alone", "n", (F.col("n") * F.coalesce("quality", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("bad"))
    head = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "good", "bad")))  # (doc_id, part, digest) is unique by now
    texts = rows.groupBy("digest", "part").agg(F.first("alone").alias("alone"), head.alias("head"), *sums(""), *sums("free_", F.col("doc_id").isNull()))
    texts = texts.withColumn("least", F.min("head.doc_id").over(Window.partitionBy("digest")))  # a row for each part that has the text
    first = F.coalesce(F.col("head.doc_id") == F.col("least"), F.lit(False))
    passed = {c: F.col(f"free_{c}") + F.when(first, F.col(f"head.{c}")).otherwise(0) for c in ("n", "good", "bad")}
    both = [F.struct((F.col("alone") + 16 * fails).alias("mask"), *((F.col(c) - passed[c] if fails else passed[c]).alias(c) for c in passed)) for fails in (0, 1)]
    split = texts.select("part", F.explode(F.array(*both)).alias("x")).where("x.n > 0")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum("x.good").alias("good"), F.sum("x.bad").alias("toxic"))


@lru_cache(maxsize=4)
def outcome_matrices(names: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Columns (order, step from 1) and integer matrices masks x columns.

    kept: no filter up to the step fails; removed: the step's fails and none before it;
    redundant: the step's fails and one before it; unique: the step's alone fails. by_filter is
    columns x columns: 1 where two columns' steps are the same filter.
    """
    steps = [(order, at) for order in permutations(range(len(names))) for at in range(len(names))]
    masks = np.arange(1 << len(names))[:, None]
    own = np.array([1 << order[at] for order, at in steps])
    before = np.array([sum(1 << f for f in order[:at]) for order, at in steps])
    failed, earlier = (masks & own) != 0, (masks & before) != 0
    matrices = {"kept": ~failed & ~earlier, "removed": failed & ~earlier, "redundant": failed & earlier, "unique": np.broadcast_to(masks == own, failed.shape)}
    matrices["by_filter"] = own[:, None] == own[None, :]
    return [("".join(names[f] for f in order), at + 1) for order, at in steps], {k: v.astype(np.int64) for k, v in matrices.items()}


def interaction_audit(histograms: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Counts of each part for every order of the filters and each step.

    histograms: part, mask, n, good, toxic; bit i of a mask is the filter names[i]. Returns
    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley (removed by the step's filter, over all orders). A part gives as many rows as there
    are orders times filters; an empty table gives none.
    """

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, matrices = outcome_matrices(names)
        order, step = pa.array([c[0] for c in columns]), pa.array([c[1] for c in columns], pa.int32())
        for whole in batches:
            for at in range(0, whole.num_rows, _PARTS_AT_ONCE):
                batch = whole.slice(at, _PARTS_AT_ONCE)
                incidence = np.zeros((3, batch.num_rows, 1 << len(names)), np.int64)
                for i, cells in enumerate(batch.column(1).to_pylist()):
                    for cell in cells:
                        incidence[:, i, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                every, good, toxic = incidence
                removed = every @ matrices["removed"]
                counts = [every @ matrices["kept"], removed, every @ matrices["redundant"], every @ matrices["unique"], good @ matrices["removed"], toxic @ matrices["removed"], removed @ matrices["by_filter"]]
                n = batch.num_rows
                parts = batch.column(0).take(pa.array(np.repeat(np.arange(n), len(columns))))
                yield pa.RecordBatch.from_arrays([parts, pa.concat_arrays([order] * n), pa.concat_arrays([step] * n), *(pa.array(c.ravel()) for c in counts)], schema.names)

    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in counts)])
    per_part = histograms.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # a cell for each mask at most
    return per_part.mapInArrow(multiplied, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in counts))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over `documents` by language, under all 120 orders."""
    return interaction_audit(mask_histograms(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
