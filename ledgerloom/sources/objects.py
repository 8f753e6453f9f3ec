"""Content-addressed objects and document parsers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.documents import document_format

Parser = Callable[[str, bytes], list[dict[str, str | None]]]


def put_objects(spark: SparkSession, source: str, store: str) -> DataFrame:
    """Stores the files at a path under the SHA-256 of their bytes; what is there already isn't written again."""
    files = spark.read.format("binaryFile").load(source).select(F.sha2("content", 256).alias("sha256"), "length", "content")
    try:
        known = spark.read.parquet(store).select("sha256")
        files = files.join(known, "sha256", "left_anti")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
    files.dropDuplicates(["sha256"]).write.mode("append").parquet(store)
    return stat_objects(spark, store)


def stat_objects(spark: SparkSession, store: str) -> DataFrame:
    """sha256 and length of every stored object."""
    return spark.read.parquet(store).select("sha256", "length")


def get_object(spark: SparkSession, store: str, sha256: str) -> bytes | None:
    """Bytes of one object."""
    row = spark.read.parquet(store).where(F.col("sha256") == sha256).select("content").first()
    return None if row is None else bytes(row.content)


def parse_documents(spark: SparkSession, path: str, parser: Parser) -> DataFrame:
    """Lines of the documents at a path; lines without amount, reference or description are dropped."""
    name = document_format(spark, f"ledgerloom_documents_{uuid.uuid4().hex}", lambda file, stream: parser(file, stream.read()))
    return spark.read.format(name).load(path)


def select_parser(parsers: dict[str, Parser], name: str | None, private: bool, internal: str) -> Parser:
    """The parser of a name; in private mode always the internal one."""
    return parsers[internal if private or name not in parsers else name]


# The stub parser: lines drawn by a 32-bit generator that the file's name seeds. The generator's
# state after k draws is its seed plus k steps, so every draw is a column expression of its own.

#: The seed's basis and factor, the step of the generator, the texts of a line.
_BASIS, _FACTOR, _STEP = 2166136261, 16777619, 0x6D2B79F5
STUB_DESCRIPTION, STUB_COUNTERPARTY = "بند مستخرج من المستند", "طرف مقابل مستخرج"
_WORD = 0xFFFFFFFF


def _product(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of two unsigned 32-bit numbers, by halves, which fit a long."""
    high = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(0xFFFF), 16)
    return (a.bitwiseAND(0xFFFF) * b + high).bitwiseAND(_WORD)


def name_seed(name: Column) -> Column:
    """32-bit seed of a text: each UTF-16 unit is mixed in and multiplied."""
    units = F.encode(name, "UTF-16BE")
    unit = lambda i: F.conv(F.hex(F.substring(units, i * 2 + 1, F.lit(2))), 16, 10).cast("long")
    places = F.when(F.length(units) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (F.length(units) / 2 - 1).cast("int")))
    return F.aggregate(places, F.lit(_BASIS).cast("long"), lambda h, i: _product(h.bitwiseXOR(unit(i)), F.lit(_FACTOR).cast("long")))


def seeded_draw(seed: Column, k: Column | int) -> Column:
    """The k-th draw (from 1) from a seed, at least 0 and below 1."""
    k = F.lit(k) if isinstance(k, int) else k
    a = (seed + k.cast("long") * _STEP).bitwiseAND(_WORD)
    t = _product(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(1))
    t = ((t + _product(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(61))).bitwiseAND(_WORD)).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(float(1 << 32))


def stub_lines(files: DataFrame) -> DataFrame:
    """Lines of files (path, document_type) by the names of the files alone, with their page_count.

    A name gives 3 to 8 lines, whatever the file holds; it isn't opened.
    """
    name = F.element_at(F.split("path", "/"), -1)
    seeded = files.select("path", "document_type", name_seed(name).alias("seed"))
    counted = seeded.withColumn("n", (3 + F.floor(seeded_draw(F.col("seed"), 1) * 6)).cast("int"))
    lines = counted.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cents = F.floor((500 + seeded_draw(F.col("seed"), F.col("i") + 2) * 90000) * 100 + 0.5)
    vat = F.floor(F.col("cents") / 100 * 15 + 0.5)
    shown = lambda c: F.format_string("%d.%02d", F.floor(c / 100), c % 100)
    priced = lines.withColumn("cents", cents).withColumn("vat", vat)
    return priced.select(
        "path",
        (F.col("i") + 1).alias("line_no"),
        F.concat(F.substring("document_type", 1, 3), F.lit("-"), (F.col("i") + 1000).cast("string")).alias("reference"),
        F.lit(STUB_DESCRIPTION).alias("description"),
        shown(F.col("cents")).alias("amount"),
        shown(F.col("vat")).alias("vat_amount"),
        F.lit(STUB_COUNTERPARTY).alias("counterparty"),
        (1 + F.floor(seeded_draw(F.col("seed"), F.col("n") + 2) * 4)).cast("int").alias("page_count"),
    )
