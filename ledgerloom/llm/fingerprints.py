"""Winnowed document fingerprints, with DataFrame functions only.

Every run of `gram` consecutive words has a 64-bit rolling hash. Of each `window` consecutive grams the
one with the least hash is kept, the rightmost where several are equal, together with its
position. Two texts that share gram + window - 1 consecutive words therefore share a kept
hash, and the kept positions are at most `window` grams apart.

A text is handled inside its row by array functions, so the plan has no shuffle. Only pairing a
document with the next one in id order moves rows, once, by blocks of adjacent ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tables import checkpointed, table

GRAM, WINDOW = 5, 4
#: ASCII white space, which separates words.
_SPACE = " \t\n\x0b\x0c\r"
#: Letters of scripts that put no spaces between words.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: A gram's sort key: 33 bits of its hash, then its position counted down in 30 bits.
_POSITION_BITS = 30
_LAST_POSITION = (1 << _POSITION_BITS) - 1
#: Adjacent ids that share a block, as a power of two; and blocks that one window may order.
_BLOCK_BITS, _ORDERED_BLOCKS = 8, 10_000
#: Blocks whose first ids (16 bytes each) may be broadcast.
_BROADCAST_BLOCKS = 100_000
_NO_ID_BLOCKS = 4_096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def units(text: Column) -> Column:
    """What grams are made of: the words of a text, and by themselves the letters of scripts without spaces."""
    spaced = F.when(text.rlike(_UNSPACED), F.regexp_replace(text, f"({_UNSPACED})", " $1 ")).otherwise(text)
    words = F.split(F.btrim(spaced, F.lit(_SPACE)), f"[{_SPACE}]+")
    return F.when(F.btrim(text, F.lit(_SPACE)) == "", F.array().cast("array<string>")).otherwise(words)


def _rotated(value: Column, by: int) -> Column:
    """The bits of a long, turned to the left."""
    by %= 64
    return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by)) if by else value


def _over(values: Column, size: int, join: Callable[[Column, Column, int], Column]) -> Column:
    """`join` over every `size` consecutive values, from those over powers of two: join(left, right, values in right).

    A stretch of 2 n values is joined of two stretches of n that its neighbours share, so each
    place takes the logarithm of `size` in steps, and none looks at `size` values.
    """

    def paired(left: Column, right: Column, apart: int, n: int) -> Column:
        return let(right, lambda r: F.transform(left, lambda x, i: join(x, F.get(r, i + apart), n)))

    def extend(powers: Column, width: int, total: Column | None, done: int) -> Column:
        """powers: over `width` values; total: over the first `done`, which are the lower bits of size."""
        if size & width:
            total, done = (powers, width) if total is None else (paired(total, powers, done, width), done + width)
        if done == size:
            return total
        return let(paired(powers, powers, width, width), lambda wider: extend(wider, 2 * width, total, done))

    whole = let(values, lambda v: extend(v, 1, None, 0))
    return let(whole, lambda w: F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0))))


def gram_hashes(text: Column, gram: int) -> Column:
    """Rolling hash of the `gram` units that end with each unit of a text; before the first one stand `gram` - 1 marks.

    It is the cyclic polynomial: every unit's hash turned by the number of units after it, and
    joined by exclusive or. A hash follows from those of the shorter runs that it shares with its
    neighbours. With the marks a text of few units, too, has a gram for each, and texts that
    begin alike share the first ones.
    """
    start = F.array_repeat(F.xxhash64(F.lit("")), gram - 1)
    hashed = F.concat(start, F.transform(units(text), lambda w: F.xxhash64(w)))
    return _over(hashed, gram, lambda a, b, n: _rotated(a, n).bitwiseXOR(b))


def winnow(grams: Column, window: int) -> Column:
    """Kept (hash, position) of an array of gram hashes, in order of position. Windows slide in from before the first gram, so that one is always kept."""
    keys = F.transform(grams, lambda g, i: F.shiftrightunsigned(g, 31) * F.lit(1 << _POSITION_BITS) + (F.lit(_LAST_POSITION) - i))
    before = F.array_repeat(F.lit((1 << 63) - 1), window - 1)
    least = _over(F.concat(before, keys), window, lambda a, b, n: F.least(a, b))
    kept = F.transform(F.array_distinct(least), lambda k: (F.lit(_LAST_POSITION) - k.bitwiseAND(F.lit(_LAST_POSITION))).cast("int"))
    return let(grams, lambda g: F.when(F.size(g) == 0, F.array().cast("array<struct<hash:bigint,position:int>>")).otherwise(F.transform(kept, lambda p: F.struct(g[p].alias("hash"), p.alias("position")))))


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<struct<hash, position>> of a text; null and wordless texts have an empty one."""
    return let(gram_hashes(F.coalesce(text, F.lit("")), gram), lambda grams: winnow(grams, window))


def likeness(left: Column, right: Column) -> Column:
    """Share of the kept hashes of two fingerprints that both have (0 to 1); 1 for two without any."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / union)


def fingerprint_documents(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, text and fingerprint of each row of docs.

    docs: needs doc_id and text; other columns, whatever their names, are ignored. Null texts
    count as empty and have an empty fingerprint. Grams are of words, and letters of scripts
    without spaces count as words; a position is that of a gram's last word, from 0. A run of
    `gram` + `window` - 1 words that two texts share gives them a hash in common. Ties within a
    window keep the rightmost gram. Repeated rows are answered each for itself, an empty table gives no rows, and a text of any length
    is read whole (positions up to 2**30 words are told apart).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), fingerprint(text, gram, window).alias("fingerprint"))


def _successors(blocks: DataFrame) -> DataFrame:
    """(block, next_block) over distinct blocks in ascending order; the last is followed by the first."""
    least, most = blocks.agg(F.min("block"), F.max("block")).first()
    if least is None:
        return blocks.select("block", F.col("block").alias("next_block"))
    return _linked(blocks).select("block", F.when(F.col("block") == most, F.lit(least)).otherwise(F.col("next_block")).alias("next_block"))


def _linked(blocks: DataFrame) -> DataFrame:
    """(block, next_block) with null for the last. Groups of 256 blocks are linked by themselves, then group to group."""
    if blocks.count() <= _ORDERED_BLOCKS:
        return blocks.select("block", F.lead("block").over(Window.orderBy("block")).alias("next_block"))
    grouped = blocks.withColumn("above", F.shiftright("block", _BLOCK_BITS))
    inside = grouped.withColumn("next_block", F.lead("block").over(Window.partitionBy("above").orderBy("block")))
    heads = grouped.groupBy("above").agg(F.min("block").alias("head"))
    up = _linked(heads.select(F.col("above").alias("block")))
    first_of_next = up.join(heads, F.col("next_block") == heads.above).select(up.block.alias("above"), "head")
    return inside.join(first_of_next, "above", "left").select("block", F.coalesce("next_block", "head").alias("next_block"))


def with_next(docs: DataFrame, add: Callable[[DataFrame], DataFrame], columns: tuple[str, ...]) -> DataFrame:
    """`add` of docs (doc_id, text), and next_<column> of each of `columns`: those of the next row by doc_id.

    After the last row comes the first. Rows of equal doc_id are ordered by text; rows without
    an id come first, in an order of their texts' hashes. Adjacent ids share a block, which one
    window orders, so texts are shuffled once. Only a block's last row looks beyond it, at the
    first row of the next block; these first rows are one in 2**_BLOCK_BITS, and are looked up
    by id: broadcast while they are few, else by a join.
    """
    no_id = F.lit(-(1 << 60)) + F.xxhash64("text").bitwiseAND(F.lit(_NO_ID_BLOCKS - 1))
    blocked = docs.select("doc_id", "text", F.coalesce(F.shiftright("doc_id", _BLOCK_BITS), no_id).alias("block"))
    first_ids = checkpointed(blocked.groupBy(F.col("block").alias("first_block")).agg(F.min("doc_id").alias("first_id")))
    few = first_ids.count() <= _BROADCAST_BLOCKS
    is_first = (F.col("block") == F.col("first_block")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    firsts = blocked.join(F.broadcast(first_ids) if few else first_ids, is_first).groupBy("first_block").agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id"))
    beyond = add(firsts).select(F.col("first_block").alias("next_block"), *(F.col(c).alias(f"beyond_{c}") for c in columns))
    beyond = _successors(first_ids.select(F.col("first_block").alias("block"))).join(beyond, "next_block").drop("next_block")
    added = add(blocked)
    order = Window.partitionBy("block").orderBy("doc_id", "text")
    led = added.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns), F.lead(F.lit(1)).over(order).isNull().alias("is_last"))
    joined = led.join(beyond, "block", "left")
    looked = {f"next_{c}": F.when(F.col("is_last"), F.col(f"beyond_{c}")).otherwise(F.col(f"next_{c}")) for c in columns}
    return joined.withColumns(looked).drop("block", "is_last", *(f"beyond_{c}" for c in columns))


def digest(prints: Column) -> Column:
    """32 hexadecimal digits that stand for a whole fingerprint, hashes and positions."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), prints)), 16, "0") for seed in (1, 2))))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def printed(rows: DataFrame) -> DataFrame:
        full = rows.withColumn("full_print", fingerprint(F.col("text")))
        return full.withColumns({"fingerprint": digest(F.col("full_print")), "hashes": F.col("full_print.hash"), "positions": F.col("full_print.position")}).drop("full_print")

    paired = with_next(docs, printed, ("text", "hashes"))
    n_chars = F.char_length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = paired.withColumn("edited", F.concat(F.substring("text", F.lit(1), n_chars - half), F.substring("next_text", F.lit(1), half)))
    edited = edited.withColumn("edited_print", fingerprint(F.col("edited")))
    return edited.select(
        "doc_id",
        n_chars.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        digest(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_print.hash")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
        "hashes",
        "positions",
    )
