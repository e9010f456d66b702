"""Language by compression: each text is compressed against one raw-content zstandard dictionary per language.

The language whose dictionary gives the fewest bytes wins; ties go to the language with more rows in the sample, then to the first by name. The margin to
the second best, in bits a byte of text, is the confidence: below ``narrow`` the operator rejects, while the best
guess stays readable.

Cases: a null text, an empty one and one without a letter are ``und`` with score 0 and rejected; very long texts
are compressed whole, window by window; repeated rows get equal results; an empty table gives an empty result;
training rows with a null text or language are left out, and without any fitting raises ``ValueError``. Other
columns pass through untouched.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sampled_texts, whole
from .toxicity import contextual_counts, windows

_LETTER = regex.compile(r"\p{L}")
_REST = re.compile(r"[\W\d_]+")
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def letters(text: str) -> bytes:
    """The words of a text in lower case, a space between them: marks and digits say nothing of the language."""
    return _REST.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


@dataclass
class LanguageModel:
    """One dictionary a language, the likelier languages first."""

    dictionaries: dict[str, bytes]
    window: int = 512
    level: int = 13
    narrow: float = 0.02
    steep: float = 20.0

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        plain = {"window_log": 17, "format": zstandard.FORMAT_ZSTD1_MAGICLESS, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
        params = zstandard.ZstdCompressionParameters.from_level(self.level, **plain)
        made = []
        for lang in self.dictionaries:
            content = zstandard.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=params)
            made.append((lang, zstandard.ZstdCompressor(compression_params=params, dict_data=content)))
        return made

    def predict(self, text: str | None, compressors: list | None = None) -> tuple[str, float, float, bool]:
        """Language, score, margin in bits a byte, and whether the margin is too narrow."""
        if not text or not _LETTER.search(text):
            return "und", 0.0, 0.0, True
        data = letters(text)
        pieces = windows(data, self.window)
        sizes = sorted(((sum(len(c.compress(x)) for x in pieces), lang) for lang, c in compressors or self.compressors()), key=lambda x: x[0])
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 8.0, False
        margin = 8 * (sizes[1][0] - sizes[0][0]) / len(data)
        return sizes[0][1], 1 - math.exp(-self.steep * margin) / 2, margin, margin < self.narrow


def train(texts: dict[str, list[str]], *, content: int = 49152) -> LanguageModel:
    """Each dictionary holds the words that stand in the most surroundings, the most common last and so nearest."""
    dictionaries = {}
    for lang, own in texts.items():
        counts = contextual_counts(own)
        words = sorted(counts, key=lambda w: (counts[w], w))
        dictionaries[lang] = (" ".join(words) + " ").encode("utf-8", "surrogatepass")[-content:].rjust(8)
    if not dictionaries:
        raise ValueError("texts with a language are needed")
    return LanguageModel(dictionaries)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, rows_per_language: int = 600, chars: int = 4000) -> LanguageModel:
    """Fits on a bounded sample: ``rows_per_language`` rows of each language, ``chars`` code points of each."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    texts = sampled_texts(rows, "l", rows_per_language, chars)
    if not texts:
        raise ValueError("texts with a language are needed")
    return train({name: texts[name] for name in sorted(texts, key=lambda n: (-len(texts[n]), n))})


def identify(model: LanguageModel, text: Column) -> Column:
    """A struct of lang, score, margin and rejected."""
    own: list = []

    @F.arrow_udf(RESULT)
    def identified(column: pa.Array) -> pa.Array:
        if not own:
            own.extend(model.compressors())
        rows = [model.predict(x, own) for x in column.to_pylist()]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.bool_())], ["lang", "score", "margin", "rejected"])

    return identified.asNondeterministic()(whole(text))
