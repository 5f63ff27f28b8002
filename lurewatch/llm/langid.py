"""Language identification by compression.

Each language is a raw-content zstandard dictionary of sample texts. A text is cut into blocks, every block is
compressed once per language, and the language with the smallest total is the prediction: its dictionary holds the
most of what the text repeats. Blocks are short, so that a long text cannot become its own dictionary. The score is the relative
margin to the second language; a margin below ``NARROW`` is rejected.

Fitting reads a bounded sample: ``SAMPLE`` texts per language, ``PIECE`` characters of each, chosen by a hash of the id.
Above ``PIECES`` / ``SAMPLE`` languages, that is 500, each gets an equal share of ``PIECES`` texts, at least one, so about
``PIECES`` * ``PIECE`` characters reach the driver. The model is as large and travels to the tasks with the function;
predicting reads whole texts.

Edge cases: a null text or one without a letter is ``und`` with score 0; equal totals go to the language with more
training documents, then by name. A null id is never learned from. Without any labelled text every prediction is
``und``. With one language the score is 1. Repeated rows are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lurewatch.llm.common import ids_of

SAMPLE = 512
PIECE = 240
PIECES = 256_000
BLOCK = 1024
LEVEL = 6
NARROW = 0.005
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


class Model(NamedTuple):
    """Languages, most frequent first, and their dictionaries."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from the rows of ``docs`` with text and language."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       F.col(f"`{lang}`").alias("lang")).where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").collect()  # one row per language
    if not counts:
        return Model((), ())
    sample = max(1, min(SAMPLE, PIECES // len(counts)))
    # A share of more than the wanted rows by hash, four times ``SAMPLE``, then the smallest hashes: little is moved.
    limits = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (3 * sample + 512) / r["count"]) * 2.0 ** 32)])
    h = F.pmod(F.xxhash64(ids_of("doc_id"), F.lit(31)), F.lit(2 ** 32))
    piece = F.expr(f"substring(text, 1 + pmod(xxhash64(doc_id, 32), greatest(length(text) - {PIECE}, 1)), {PIECE})")
    near = rows.withColumn("_h", h).where(F.col("_h") <= limits[F.col("lang")]).select("lang", "_h", "doc_id", piece.alias("piece"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("_h", "doc_id", "piece"))
    found: dict[str, list[str]] = {}
    for r in near.withColumn("_r", rank).where(F.col("_r") <= sample).orderBy("lang", "_r").collect():
        found.setdefault(r["lang"], []).append(r["piece"])
    languages = tuple(r["lang"] for r in counts)
    return Model(languages, tuple("\n".join(found.get(x, [])).lower().encode() for x in languages))


class Classifier:
    """Predicts single texts with compressors that are prepared once."""

    def __init__(self, model: Model):
        self.languages = model.languages
        self.compress = []
        for data in model.dictionaries:
            content = zstandard.ZstdCompressionDict(data or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(
                dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the text under each language."""
        data = text.lower().encode()
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(map(len, map(compress, blocks))) for compress in self.compress]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted)."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: sizes[i])
        if len(order) == 1:
            return self.languages[0], 1.0, True
        margin = 1.0 - sizes[order[0]] / sizes[order[1]]
        return self.languages[order[0]], margin, margin >= NARROW


def predictor(model: Model):
    """A column function: text to struct of lang, score, accepted."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    @F.arrow_udf("lang string, score double, accepted boolean")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = Classifier(model)
        for array in texts:
            found = [classifier.predict(t.as_py()) for t in array]
            yield pa.array([dict(zip(("lang", "score", "accepted"), x)) for x in found], kind)

    return predict


def fold(doc_id: str, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string")), F.lit(folds))


def identified(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted: one row per document."""
    p = predictor(model)(F.col(f"`{text}`"))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), p.alias("_p")).select(
        "doc_id", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"), F.col("_p.accepted").alias("accepted"))
