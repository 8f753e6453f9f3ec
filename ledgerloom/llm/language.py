"""Language identification by hyperdimensional letter profiles.

Every letter has a random bipolar vector drawn from its code point. A trigram is bound as
roll(a, 2) * roll(b, 1) * c, a document is the bundle (sum) of its trigrams' vectors, and a
language prototype is the bundle of its training documents' unit vectors. A document takes the
language whose prototype has the largest cosine with it.

Training is one pass that adds up one vector per language and partition; the sums meet by
(language, dimension). Prediction is a second pass. Neither moves texts between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.tables import fold, table
from ledgerloom.llm.text import chunks, utf8

DIMENSIONS = 1024
#: Units into which a document's unit vector is rounded, so that sums don't depend on their order.
_UNIT = 1 << 20
#: Trigram vectors that a worker remembers before it starts again, those added up at once, and letters counted at once.
_MEMO_ROWS, _BLOCK_ROWS, _STRETCH = 30_000, 4_096, 1 << 18
#: Values of lang that may be learnt; a prototype takes 8 KB.
MOST_LANGUAGES = 1_000
_SPACE = 0x20
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else _SPACE for c in range(0x110000)], np.uint32)


class TrigramVectors:
    """Bound vectors of trigrams, made when first asked for and remembered."""

    def __init__(self, dimensions: int, seed: int) -> None:
        self.dimensions, self.seed = dimensions, seed
        self._letters: dict[int, np.ndarray] = {}
        self._vectors = np.empty((_MEMO_ROWS, dimensions), np.int8)
        self._clear()

    def _clear(self) -> None:
        self._codes = np.zeros(0, np.uint64)
        self._rows = np.zeros(0, np.int64)

    def letter(self, code: int) -> np.ndarray:
        """The letter's vector, with its last two entries before it: a stretch of it is the vector turned by up to 2."""
        if code not in self._letters:
            if len(self._letters) >= _MEMO_ROWS:
                self._letters.clear()
            draw = np.random.default_rng((self.seed, code)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
            self._letters[code] = np.concatenate([draw[-2:], draw])
        return self._letters[code]

    def _bind(self, codes: np.ndarray) -> np.ndarray:
        parts = [((codes >> np.uint64(shift)) & np.uint64(0x1FFFFF)).astype(np.int64) for shift in (42, 21, 0)]
        out = np.ones((len(codes), self.dimensions), np.int8)
        for part, turn in zip(parts, (2, 1, 0)):
            letters, index = np.unique(part, return_inverse=True)
            out *= np.stack([self.letter(int(c))[2 - turn : 2 - turn + self.dimensions] for c in letters])[index]
        return out

    def rows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table of vectors, and the row of each of the sorted distinct codes, at most _MEMO_ROWS."""
        new = codes[~np.isin(codes, self._codes, assume_unique=True)]
        if len(self._codes) + len(new) > _MEMO_ROWS:
            self._clear()
            new = codes
        if len(new):
            own = np.arange(len(new)) + len(self._codes)
            self._vectors[own[0] : own[-1] + 1] = self._bind(new)
            known, rows = np.concatenate([self._codes, new]), np.concatenate([self._rows, own])
            order = np.argsort(known, kind="stable")
            self._codes, self._rows = known[order], rows[order]
        return self._vectors, self._rows[np.searchsorted(self._codes, codes)]


@lru_cache(maxsize=2)
def trigram_vectors(dimensions: int, seed: int) -> TrigramVectors:
    """The worker process's memo."""
    return TrigramVectors(dimensions, seed)


def letters_of(text: str) -> np.ndarray:
    """Code points of a text's lower-case letters, with every run of other characters as one space, and one at each end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.empty(len(points) + 2, np.uint32)
    letters[0] = letters[-1] = _SPACE
    letters[1:-1] = letter_table()[points]
    kept = np.ones(len(letters), bool)
    kept[1:] = (letters[1:] != _SPACE) | (letters[:-1] != _SPACE)
    return letters[kept]


def trigrams(letters: np.ndarray) -> np.ndarray:
    """Codes of all trigrams of a run of letters."""
    if len(letters) < 3:
        return np.zeros(0, np.uint64)
    wide = letters.astype(np.uint64)
    return (wide[:-2] << np.uint64(42)) | (wide[1:-1] << np.uint64(21)) | wide[2:]


def _added_up(vectors: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of rows of vectors by their counts, a block at a time."""
    total = np.zeros(vectors.shape[1])
    for at in range(0, len(rows), _BLOCK_ROWS):
        total += counts[at : at + _BLOCK_ROWS].astype(np.float32) @ vectors[rows[at : at + _BLOCK_ROWS]].astype(np.float32)
    return total


def _varied(memo: TrigramVectors, letters: np.ndarray) -> np.ndarray:
    """Bundle of a long or varied text, counted in stretches of letters."""
    bundle = np.zeros(memo.dimensions)
    for at in range(0, max(len(letters) - 2, 0), _STRETCH):
        codes, counts = np.unique(trigrams(letters[at : at + _STRETCH + 2]), return_counts=True)
        for part in range(0, len(codes), _BLOCK_ROWS):
            bundle += _added_up(*memo.rows(codes[part : part + _BLOCK_ROWS]), counts[part : part + _BLOCK_ROWS])
    return bundle


def document_vectors(column: pa.Array, dimensions: int, seed: int) -> Iterator[tuple[int, np.ndarray | None]]:
    """Row and unit vector of each document; None where a text has no letter.

    Short texts are handled together. A text is counted in stretches of letters and its vectors
    are added up in blocks, so a very long or varied text needs a few bytes a character, and no
    vector of each of its trigrams.
    """
    memo = trigram_vectors(dimensions, seed)
    data, offsets = utf8(column)
    for first, end in chunks(offsets):
        letters = [letters_of(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")) for i in range(first, end)]
        ends = np.cumsum([0, *(max(len(x) - 2, 0) for x in letters)])
        few = ends[-1] <= _STRETCH
        if few:
            distinct, index = np.unique(np.concatenate([trigrams(x) for x in letters]), return_inverse=True)
            few = len(distinct) <= _MEMO_ROWS // 2
        if few:
            vectors, rows = memo.rows(distinct)
        for i, own in enumerate(letters):
            if few:
                used, counts = np.unique(index[ends[i] : ends[i + 1]], return_counts=True)
                bundle = _added_up(vectors, rows[used], counts)
            else:
                bundle = _varied(memo, own)
            norm = float(np.linalg.norm(bundle))
            yield first + i, (bundle / norm).astype(np.float32) if norm else None


def language_prototypes(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = 0) -> dict[str, np.ndarray]:
    """Unit prototype of each language; docs: text and lang, rows with a null lang are ignored.

    More than MOST_LANGUAGES values of lang are refused: such a column holds no languages.
    """
    if docs.select("lang").distinct().limit(MOST_LANGUAGES + 2).count() > MOST_LANGUAGES + 1:  # null may be one of them
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for row, vector in document_vectors(batch.column(0), dimensions, seed):
                if vector is not None:
                    total = sums.setdefault(langs[row], np.zeros(dimensions, np.int64))
                    total += np.rint(vector * _UNIT).astype(np.int64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)], ["lang", "dimension", "value"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    summed = rows.mapInArrow(bundled, "lang string, dimension int, value long").groupBy("lang", "dimension").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for lang, dimension, value in summed.collect():  # languages x dimensions rows
        found.setdefault(lang, np.zeros(dimensions))[dimension] = value
    return {lang: vector / norm for lang, vector in sorted(found.items()) if (norm := np.linalg.norm(vector))}


def identify_language(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = 0) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, at least 0) of each row of docs.

    docs: needs doc_id and text; other columns are ignored, and texts are read whole. A null
    text, an empty one, one without a letter, and any text if there are no prototypes give
    `und` with score 0. Equal cosines take the first language in order. Repeated rows are
    answered each for itself; an empty table gives no rows.
    """
    langs = list(prototypes)
    matrix = np.stack([prototypes[x] for x in langs]).astype(np.float32) if langs else None

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            if matrix is not None:
                for row, vector in document_vectors(batch.column(1), dimensions, seed):
                    if vector is not None:
                        cosines = matrix @ vector
                        best = int(cosines.argmax())
                        found[row], scores[row] = langs[best], min(max(float(cosines[best]), 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(compared, "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the folds other than 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    prototypes = language_prototypes(docs.where(fold("doc_id", 4) != 2))
    return identify_language(docs, prototypes).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
