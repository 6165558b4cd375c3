"""Quality rules: word and line counts, and the fertility of a public tokenizer.

Every whole text is cut by a public byte-fallback vocabulary. Three figures follow: characters per
token (low where letters form no words of any language the vocabulary knows, high for runs of one
sign), the share of byte-fallback tokens (damaged encodings, signs of no script) and the entropy of
the token distribution in bits (low for text that says one thing again and again). A text's band
is that of its language where ``bands`` names it, else that of the script most of its letters
belong to; outside the band it is rejected. Bands are parameters, not fitted to a corpus, so that a
text's verdict depends on that text alone and is the same at every size of the corpus.

One pass, no shuffle. A text beyond ``CHUNK_CHARS`` is cut in pieces at single spaces, over
which no token reaches, so that memory follows the piece and the counts are those of the whole.

Edge cases: null text is empty; it has no words and fails the base rules; bytes that are no UTF-8
count as U+FFFD; a text without letters has the script ``none``; rows are judged one by one, so
repeated rows, null ids and an empty table need no care; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
CHUNK_CHARS = 1 << 20


class Band(NamedTuple):
    """What is accepted: characters per token from and to, at most this share of byte-fallback
    tokens, at least this token entropy."""

    chars_from: float
    chars_to: float
    fallback_to: float
    entropy_from: float


# Alphabets cut into words give more characters a token than scripts whose signs are tokens or
# fall back to their three bytes.
BANDS = {
    "latin": Band(1.5, 9.0, 0.15, 3.0),
    "greek": Band(0.8, 6.0, 0.40, 3.0),
    "cyrillic": Band(1.0, 8.0, 0.25, 3.0),
    "semitic": Band(0.6, 5.0, 0.50, 3.0),
    "indic": Band(0.3, 4.0, 0.90, 3.0),
    "cjk": Band(0.3, 3.0, 0.95, 3.0),
    "other": Band(0.2, 9.0, 1.00, 3.0),
    "none": Band(0.9, 9.0, 0.50, 2.0),
}
# (first code point, script); a range ends where the next begins, "" holds no letters
RANGES = [
    (0x0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0xD7, ""), (0xD8, "latin"), (0xF7, ""), (0xF8, "latin"),
    (0x250, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "semitic"), (0x780, "other"), (0x900, "indic"), (0xE00, "other"),
    (0x1100, "cjk"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3041, "cjk"), (0xA000, "other"),
    (0xAC00, "cjk"), (0xD7B0, ""), (0xF900, "cjk"), (0xFB00, "latin"), (0xFB1D, "semitic"), (0xFE00, ""), (0x10000, "other"), (0x1F000, ""), (0x20000, "cjk"), (0x32000, ""),
]
_STARTS = np.array([a for a, _ in RANGES], np.uint32)
_SCRIPTS = sorted({s for _, s in RANGES})
_SCRIPT_OF = np.array([_SCRIPTS.index(s) for _, s in RANGES])
SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_tokens bigint, chars_per_token double, fallback_share double, token_entropy double, script string"
)


def repeated_words(words: list, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    if len(words) <= width:
        return 0
    ids: dict = {}
    key = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    base = key
    for k in range(1, width):  # windows of k + 1 words, numbered anew so that the key stays small
        _, key = np.unique(key[:-1] * len(ids) + base[k:], return_inverse=True)
    twice = np.bincount(key)[key] > 1
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return int((step.cumsum()[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """words, their code points, symbols, repeated lines, words in repeated windows."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def script_of(text: str) -> str:
    """The script of most letters; among equals the first by name."""
    n = np.zeros(len(_SCRIPTS), np.int64)
    for at in range(0, len(text), CHUNK_CHARS):
        codes = np.frombuffer(text[at : at + CHUNK_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        n += np.bincount(_SCRIPT_OF[np.searchsorted(_STARTS, codes, side="right") - 1], minlength=len(_SCRIPTS))
    n[_SCRIPTS.index("")] = 0
    return _SCRIPTS[int(n.argmax())] if n.any() else "none"


class Fertility:
    """Token counts of a public vocabulary with byte fallback."""

    CUT = re.compile(r"(?<=[^ ]) (?=[^ ])")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.size)])
        pieces = [self.model.id_to_piece(i).lstrip("▁") for i in range(self.size) if not self.fallback[i]]
        if any("▁" in p for p in pieces):
            raise ValueError("tokens of the vocabulary must not reach over a space")

    def pieces(self, text: str, size: int = CHUNK_CHARS):
        """Cuts at a single space, which the vocabulary's prefix space then stands for."""
        while len(text) > size:
            cut = self.CUT.search(text, size)
            if cut is None:
                break
            yield text[: cut.start()]
            text = text[cut.end() :]
        yield text

    def counts(self, text: str, size: int = CHUNK_CHARS) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        for p in self.pieces(text, size):
            out += np.bincount(np.array(self.model.encode(p), np.int64), minlength=self.size)
        return out

    def figures(self, text: str) -> tuple[int, float, float, float]:
        """tokens, characters per token, share of byte-fallback tokens, entropy in bits."""
        c = self.counts(text)
        n = int(c.sum())
        if not n:
            return 0, 0.0, 0.0, 0.0
        fallback, p = int(c[self.fallback].sum()), np.sort(c[c > 0]) / n
        return n, len(text) / n, fallback / n, float(-(p * np.log2(p)).sum())


@lru_cache(maxsize=2)
def fertility(path: str) -> Fertility:
    return Fertility(path)


def measured(path: str):
    """A column function: every count and figure of a text (as binary) in one struct."""
    fields = [(n, {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[t]) for n, t in (f.split() for f in SCHEMA.split(", "))]

    @F.arrow_udf(f"struct<{', '.join(f.replace(' ', ': ', 1) for f in SCHEMA.split(', '))}>")
    def measure(col: pa.Array) -> pa.Array:
        f = fertility(path)
        rows = []
        for raw in col:
            text = (raw.as_py() or b"").decode("utf-8", "replace")
            rows.append((*base_counts(text), *f.figures(text), script_of(text)))
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

    return measure


def inside(band: Band, m: str = "__m") -> Column:
    return (
        F.col(f"{m}.chars_per_token").between(band.chars_from, band.chars_to)
        & (F.col(f"{m}.fallback_share") <= band.fallback_to)
        & (F.col(f"{m}.token_entropy") >= band.entropy_from)
    )


def quality_rules(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str | None = None,
    bands: dict[str, Band] | None = None,
) -> DataFrame:
    """Counts, figures and verdicts of every document.

    ``bands`` maps scripts, and with ``lang`` languages too, to bands; it adds to or replaces
    ``BANDS``. ``base_failed`` follows from the counts alone, ``kept`` needs both.
    """
    prepare(docs.sparkSession)
    rules = {**BANDS, **(bands or {})}
    own = F.col(lang) if lang else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("__id"), own.alias("__lang"), measured(path)(F.col(text).cast("binary")).alias("__m"))
    name = F.when(F.col("__lang").isin(*rules), F.col("__lang")).otherwise(F.col("__m.script"))
    verdict = F.lit(False)
    for key, band in rules.items():
        verdict = F.when(F.col("band") == key, inside(band)).otherwise(verdict)
    rows = rows.select("*", name.alias("band"))
    failed = (F.col("__m.n_words") < MIN_WORDS) | (F.col("__m.n_repeat_words") * 100 > F.col("__m.n_words") * MAX_REPEAT_PERCENT)
    return rows.select(F.col("__id").alias(id_col), "__m.*", "band", failed.alias("base_failed"), (~failed & verdict).alias("kept"))
