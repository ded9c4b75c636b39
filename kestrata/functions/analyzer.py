"""Text analysis for the index: character filter, tokenizer, token transform, added and deleted tokens.

Everything but Unicode normalisation and case folding is built from Spark's own
functions.  Every step also takes a function from Column to Column.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TableError

# fixed values: names of the built-in steps, and the public 33-word stop list
NORMAL_FORMS = ("nfc", "nfd", "nfkc", "nfkd")
TOKENIZERS = ("unicode_word_boundaries",)
TRANSFORMS = ("lowercase", "uppercase", "casefold")
LUCENE_STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()

PART_BYTES = 1 << 20
Step = str | Callable[[Column], Column] | None


@dataclass(frozen=True)
class Analyzer:
    char_filter: Step = None
    tokenizer: Step = "unicode_word_boundaries"
    transform: Step = "lowercase"
    add: tuple[Any, ...] = ()
    delete: tuple[Any, ...] = ()
    stats: bool = True
    exact: bool = False

    @classmethod
    def of(cls, options: Mapping[str, Any] | str | None) -> Analyzer:
        """From index options: None for the defaults, "exact" for the whole value as one term, or a map of steps."""
        if options is None:
            return cls()
        if options == "exact":
            return cls(exact=True)
        o = dict(options)
        t = o.pop("token_filter", None) or {}
        out = cls(o.pop("char_filter", None), o.pop("tokenizer", None) or "unicode_word_boundaries", t.get("transform"), _many(t.get("add")), _many(t.get("delete")), o.pop("stats", "all") != "unique")
        if o:
            raise TableError((next(iter(o)), "invalid_option"))
        return out

    def for_query(self) -> Analyzer:
        """Added tokens belong to indexing only."""
        return Analyzer(self.char_filter, self.tokenizer, self.transform, (), self.delete, False, self.exact)


def _many(x: Any) -> tuple[Any, ...]:
    if x is None:
        return ()
    return tuple(x) if isinstance(x, (list, tuple)) and not isinstance(x, str) else (x,)


def _parts(s: pa.Array) -> Iterator[pa.Array]:
    """Parts of a batch of some ``PART_BYTES``: Python strings take several times the bytes of an Arrow batch."""
    rows = max(1, len(s) * PART_BYTES // max(1, s.nbytes))
    return (s.slice(lo, rows) for lo in range(0, len(s), rows))


def _in_parts(work: Callable[[pa.Array], Iterator[pa.Array]], kind: str) -> Callable[[Column], Column]:
    """An Arrow function that holds the strings of one part at a time; the worker then gives back what it freed."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in batches:
            done = list(work(s))
            yield pa.concat_arrays(done) if done else pa.array([], s.type)
        pa.default_memory_pool().release_unused()
        _trim()

    return run.asNondeterministic()  # a filter on the result would else be moved below it, and a second worker do all again


def _trim() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps or gives back as it will
        pass


def normalize(text: Column, form: str) -> Column:
    if form not in NORMAL_FORMS:
        raise TableError((form, "invalid_char_filter"))

    def work(s: pa.Array) -> Iterator[pa.Array]:
        for part in _parts(s):
            yield pa.array([x if x is None else unicodedata.normalize(form.upper(), x) for x in part.to_pylist()], pa.string())

    # ASCII is its own normal form and stays in the JVM
    ascii_ = F.char_length(text) == F.octet_length(text)
    return F.when(ascii_, text).otherwise(_in_parts(work, "string")(F.when(~ascii_, text)))


def casefold(tokens: Column) -> Column:
    def work(s: pa.Array) -> Iterator[pa.Array]:
        for part in _parts(s):
            yield pa.array([x if x is None else [t if t is None else t.casefold() for t in x] for x in part.to_pylist()], pa.list_(pa.string()))

    return _in_parts(work, "array<string>")(tokens)


def tokenize(text: Column, tokenizer: Step) -> Column:
    if callable(tokenizer):
        return tokenizer(text)
    if tokenizer not in TOKENIZERS:
        raise TableError((tokenizer, "invalid_tokenizer"))
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)


def transform(tokens: Column, how: Step) -> Column:
    if how is None:
        return tokens
    if callable(how):
        return how(tokens)
    if how == "lowercase":
        return F.transform(tokens, F.lower)
    if how == "uppercase":
        return F.transform(tokens, F.upper)
    if how == "casefold":
        return casefold(tokens)
    raise TableError((how, "invalid_transform"))


def stopwords(name: str) -> Sequence[str]:
    if name == "lucene_stopwords":
        return LUCENE_STOPWORDS
    if name in ("english_stopwords", "wikipages_stopwords"):
        from pyspark.ml.feature import StopWordsRemover

        return StopWordsRemover.loadDefaultStopWords("english")
    raise TableError((name, "invalid_stopwords"))


def analyze(text: Column, a: Analyzer) -> Column:
    """The tokens of a text, in order."""
    if a.exact:
        return F.array(text.cast("string"))
    if a.char_filter is not None:
        text = a.char_filter(text) if callable(a.char_filter) else normalize(text, a.char_filter)
    tokens = transform(tokenize(text, a.tokenizer), a.transform)
    for x in a.add:
        tokens = F.concat(tokens, x(tokens) if callable(x) else F.array(F.lit(x)))
    drop: list[str] = []
    for x in a.delete:
        if callable(x):
            tokens = x(tokens)
        else:
            drop += stopwords(x) if x.endswith("_stopwords") else [x]
    if drop:
        words = sorted(set(drop))
        tokens = F.filter(tokens, lambda t: ~t.isin(words))
    return tokens
