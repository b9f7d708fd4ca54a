"""Language identification by compression.

For each language a raw-content dictionary is put together from whole labelled texts.  A text is
encoded with every dictionary by Zstandard, and the language whose dictionary gives the smallest
output is chosen.  The margin is the share by which the runner-up is larger; below ``least_margin``
the choice is rejected (``accepted`` false), while the best language is still reported.

The sample of labelled rows is bounded in bytes: a language's dictionary takes whole texts of at most
``sample_bytes`` in the order of a hash of their ids until no further one fits.  A language that has
none so short is learnt from its shortest text.  Every language of the labelled rows is learnt;
the more there are, the smaller each dictionary, so all of them stay below ``total_bytes``.

* Text is lower-cased before encoding, so capitals do not hide a language.
* Null text and text without any letter get ``und``, score 0, not accepted.
* Equal sizes go to the language that comes first in code-point order.
* Rows with a null language are not learnt from.  If nothing can be learnt, all texts are ``und``.
* Rows that repeat id, language and text are learnt from once and predicted each for itself.
* An empty table gives an empty result.  Whole texts are encoded, whatever their length.
* Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundtable.plans.shared import short_batches


@dataclass(frozen=True)
class LanguageParams:
    """Bytes of a dictionary, of all dictionaries, and of the longest text that is sampled while shorter ones exist."""

    dictionary_bytes: int = 128 << 10
    total_bytes: int = 64 << 20
    sample_bytes: int = 16 << 10
    level: int = 5
    least_margin: float = 0.02


def held_out(id_col: Column) -> Column:
    """True for rows that are never learnt from: crc32 of the id's text divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    params: LanguageParams = LanguageParams(),
) -> dict[str, bytes]:
    """Dictionary content by language, from labelled rows that are not held out.

    One pass counts the bytes that each language offers; a second takes the rows whose hash lies below
    the share that fills a dictionary half as full again, so what reaches the driver is bounded by
    ``total_bytes`` and no language gathers in one task.
    """
    raw = F.col(text_col).cast("string")
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), raw.alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("id"))
    )
    size = F.octet_length("text")
    offered = labelled.groupBy("lang").agg(F.sum(F.when(size <= params.sample_bytes, size)).alias("bytes"))
    offers = {row["lang"]: row["bytes"] for row in offered.collect()}  # one row per language
    if not offers:
        return {}
    each = min(params.dictionary_bytes, max(1 << 10, params.total_bytes // len(offers)))
    shares = {lang: min(1.0, 1.5 * max(each, params.sample_bytes) / size) for lang, size in offers.items() if size}
    found: dict[str, list[bytes]] = {lang: [] for lang in offers}
    if shares:
        table = docs.sparkSession.createDataFrame(list(shares.items()), "lang string, share double")
        place = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53)
        sample = (
            labelled.where(size <= params.sample_bytes)
            .join(F.broadcast(table), "lang")  # one row per language
            .where(place < F.col("share"))
            .groupBy("lang", "id", "text").agg(F.min(place).alias("place"))
        )
        left = dict.fromkeys(shares, each)
        for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["place"], r["text"])):
            text = row["text"].lower().encode("utf-8", "surrogatepass") + b"\n"
            if len(text) <= left[row["lang"]]:
                found[row["lang"]].append(text)
                left[row["lang"]] -= len(text)
    bare = [lang for lang, texts in found.items() if not texts]
    if bare:
        shortest = labelled.where(F.col("lang").isin(bare)).groupBy("lang").agg(F.min_by("text", F.struct(size, F.xxhash64("id"), "text")).alias("text"))
        for row in shortest.collect():  # one text per language without short ones
            found[row["lang"]] = [row["text"].lower().encode("utf-8", "surrogatepass")]
    return {lang: b"".join(texts) for lang, texts in found.items()}


def classify_languages(
    docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", params: LanguageParams = LanguageParams()
) -> Column:
    """A struct column (lang_pred, score, margin, accepted) of a text column."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(sorted(dictionaries.items()))

    def encoders() -> list[zstandard.ZstdCompressor]:
        settings = zstandard.ZstdCompressionParameters.from_level(
            params.level, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        return [
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                compression_params=settings,
            )
            for _, content in shared.value
        ]

    @F.arrow_udf("lang_pred string, score double, margin double, accepted boolean")
    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, tools = [lang for lang, _ in shared.value], encoders()
        for texts in batches:
            names, scores, margins = [], [], []
            for text in texts:
                if not text.is_valid or not tools:
                    names.append("und"), scores.append(0.0), margins.append(0.0)
                    continue
                raw = b" " + text.as_py().encode("utf-8", "surrogatepass") + b" "
                sizes = np.array([len(tool.compress(raw)) for tool in tools], dtype=np.float64)
                best = int(sizes.argmin())
                others = np.delete(sizes, best)
                names.append(langs[best])
                scores.append(float(1.0 / np.exp(-0.5 * (sizes - sizes[best])).sum()))
                margins.append(float((others.min() - sizes[best]) / others.min()) if len(others) else 1.0)
            accepted = [m >= params.least_margin and n != "und" for m, n in zip(margins, names)]
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(accepted, pa.bool_())],
                ["lang_pred", "score", "margin", "accepted"],
            )

    text = F.col(text_col).cast("string")
    return classify(F.when(text.rlike(r"\p{L}"), F.lower(text)))


def identify_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    params: LanguageParams = LanguageParams(),
) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, margin, accepted."""
    dictionaries = learn_languages(docs, id_col, text_col, lang_col, params)
    found = docs.select(
        F.col(id_col), held_out(F.col(id_col)).alias("held_out"), classify_languages(docs, dictionaries, text_col, params).alias("found")
    )
    return found.select(id_col, "held_out", "found.*")
