"""Analyzers: a text column becomes an array of tokens (term, pos, start, end).

Positions start at 1 and rise by a token's increment; offsets are code points.  Where built-in functions express an analyzer
it stays in them and leaves offsets null unless ``offsets`` is asked for; the others run over Arrow batches and write columns,
so no token is an object of its own for longer than its piece of a batch.  ``make_analyzer`` makes one from a name and properties, ``normalize`` gives the canonical form of a configuration.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quern.functions.similarity import minhash as minhash_column
from quern.functions.stemming import stem_english

TOKEN = "struct<term:string,pos:int,start:int,end:int>"
TOKENS = f"array<{TOKEN}>"
#: (term, increment, start, end)
Raw = tuple[str, int, int, int]


#: Tokens that are held as objects before they become columns; characters of a piece of text that is remembered; how many are.
PIECE, CHUNK_CHARS, CHUNKS = 1 << 17, 64, 300_000


def placed(tokens: Iterable[Raw]) -> list[dict[str, Any]]:
    pos, out = 0, []
    for term, step, start, end in tokens:
        pos += step
        out.append({"term": term, "pos": max(pos, 1), "start": start, "end": end})
    return out


_TOKEN = [pa.field("term", pa.string()), pa.field("pos", pa.int32()), pa.field("start", pa.int32()), pa.field("end", pa.int32())]


class Tokens:
    """Tokens of several texts as columns."""

    def __init__(self) -> None:
        self.terms: list[str] = []
        self.numbers: list[np.ndarray] = []

    def add(self, terms: Iterable[str], steps: Any, starts: Any, ends: Any) -> None:
        """Of a whole text, at most once for each."""
        self.terms.extend(terms)
        step = np.cumsum(np.asarray(steps, np.int64))
        self.numbers.append(np.stack([np.maximum(step, 1), np.asarray(starts, np.int64), np.asarray(ends, np.int64)]).astype(np.int32))

    def columns(self) -> list[pa.Array]:
        """Terms, positions, starts and ends."""
        numbers = np.concatenate(self.numbers, axis=1) if self.numbers else np.zeros((3, 0), np.int32)
        return [pa.array(self.terms, pa.string()), *map(pa.array, numbers)]


def token_columns(analyzer: Analyzer, texts: pa.Array) -> Iterator[tuple[list[int], pa.Array, pa.Array, pa.Array, pa.Array]]:
    """For following texts, in pieces of about ``PIECE`` tokens: each one's number of tokens, and the tokens' terms, positions, starts and ends."""
    counts, tokens = [], Tokens()
    for text in texts:
        had = len(tokens.terms)
        if text.is_valid:
            analyzer.add(text.as_py(), tokens)
        counts.append(len(tokens.terms) - had)
        if len(tokens.terms) >= PIECE:
            yield counts, *tokens.columns()
            counts, tokens = [], Tokens()
    if counts:
        yield counts, *tokens.columns()


def token_rows(df: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(id, term, pos, start, end) for rows (id, text), a row per token, for analyzers that run in Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for counts, *columns in token_columns(analyzer, batch.column(1)):
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(at, at + len(counts)), counts)))
                at += len(counts)
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", "term", "pos", "start", "end"])

    return df.mapInArrow(run, f"id {df.schema[0].dataType.simpleString()}, term string, pos int, start int, end int")


class Analyzer:
    """``raw`` defines the tokens; ``tokens`` is the column form, native where a subclass has one."""

    type_name = ""
    has_offsets = True

    def raw(self, text: str) -> list[Raw]:
        raise NotImplementedError

    def add(self, text: str, into: Tokens) -> None:
        """Appends the text's tokens: what ``raw`` gives."""
        if tokens := self.raw(text):
            into.add(*zip(*tokens))

    def tokens(self, col: Column, offsets: bool = False) -> Column:
        @arrow_udf(TOKENS)
        def run(texts: pa.Array) -> pa.Array:
            counts, parts = [0], []
            for n, *columns in token_columns(self, texts):
                counts += n
                parts.append(pa.StructArray.from_arrays(columns, names=["term", "pos", "start", "end"]))
            return pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.concat_arrays(parts) if parts else pa.array([], pa.struct(_TOKEN)))

        return run(col)

    def in_python(self, offsets: bool = False) -> bool:
        """Whether ``tokens`` is but ``raw`` over batches."""
        return type(self).tokens is Analyzer.tokens

    def properties(self) -> dict[str, Any]:
        return {k: v for k, v in vars(self).items() if not k.startswith("_")}


def _native(terms: Column) -> Column:
    """Tokens at following positions without offsets."""
    return F.coalesce(F.transform(terms, lambda t, k: F.struct(t.alias("term"), (k + 1).cast("int").alias("pos"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))), F.expr(f"cast(array() as {TOKENS})"))


def _one(term: Column, whole: Column) -> Column:
    return F.when(term.isNull(), F.expr(f"cast(array() as {TOKENS})")).otherwise(F.array(F.struct(term.alias("term"), F.lit(1).alias("pos"), F.lit(0).alias("start"), F.length(whole).alias("end"))))


@dataclass
class Identity(Analyzer):
    type_name = "identity"

    def raw(self, text: str) -> list[Raw]:
        return [(text, 1, 0, len(text))]

    def tokens(self, col: Column, offsets: bool = False) -> Column:
        return _one(col, col)


@dataclass
class Empty(Analyzer):
    type_name = "empty"

    def raw(self, text: str) -> list[Raw]:
        return []

    def tokens(self, col: Column, offsets: bool = False) -> Column:
        return F.expr(f"cast(array() as {TOKENS})")


_GAP_WORD = regex.compile(r"([^\p{L}\p{N}]*+)([\p{L}\p{N}]++)")


@dataclass
class Words(Analyzer):
    """Runs of letters and digits, lower-cased: the native tokenizer, for which SQL has an equal."""

    type_name = "words"
    lower: bool = True

    PATTERN = r"[\p{L}\p{N}]+"

    def raw(self, text: str) -> list[Raw]:
        return [(m[0].lower() if self.lower else m[0], 1, m.start(), m.end()) for m in regex.finditer(self.PATTERN, text)]

    def tokens(self, col: Column, offsets: bool = False) -> Column:
        return super().tokens(col) if offsets else _native(self.words(col))

    def in_python(self, offsets: bool = False) -> bool:
        return offsets

    def words(self, col: Column) -> Column:
        return F.regexp_extract_all(F.lower(col) if self.lower else col, F.lit(self.PATTERN), F.lit(0))

    def add(self, text: str, into: Tokens) -> None:
        if found := _GAP_WORD.findall(text):
            gaps, words = zip(*found)
            gap, size = (np.fromiter(map(len, x), np.int64, len(found)) for x in (gaps, words))
            ends = np.cumsum(gap + size)
            into.add(map(str.lower, words) if self.lower else words, np.ones(len(found), np.int64), ends - size, ends)


@dataclass
class Delimiter(Analyzer):
    """Split at one delimiter with quoting: delimiters inside quotes don't count, a doubled quote is one, mismatched quotes stay as
    they are, empty tokens are kept; an empty delimiter splits every character."""

    type_name = "delimiter"
    delimiter: str = ","

    def raw(self, text: str) -> list[Raw]:
        d, out, at = self.delimiter, [], 0
        if not d:
            return [(c, 1, k, k + 1) for k, c in enumerate(text)]
        while True:
            end = self._end(text, at)
            out.append((self._unquoted(text[at:end]), 1, at, end))
            if end >= len(text):
                return out
            at = end + len(d)

    def _end(self, text: str, at: int) -> int:
        if text[at : at + 1] == '"':
            k, inside = at + 1, True
            while k < len(text):
                if inside:
                    if text[k] == '"':
                        if text[k + 1 : k + 2] == '"':
                            k += 1
                        else:
                            inside = False
                elif text.startswith(self.delimiter, k):
                    return k
                k += 1
            if not inside:
                return len(text)
        found = text.find(self.delimiter, at)
        return len(text) if found < 0 else found

    @staticmethod
    def _unquoted(token: str) -> str:
        if len(token) >= 2 and token[0] == '"' == token[-1] and '"' not in token[1:-1].replace('""', ""):
            return token[1:-1].replace('""', '"')
        return token

    def tokens(self, col: Column, offsets: bool = False) -> Column:
        if offsets or not self.delimiter:
            return super().tokens(col)
        plain = _native(F.split(col, re.escape(self.delimiter), -1))
        return F.when(F.contains(col, F.lit('"')), super().tokens(F.when(F.contains(col, F.lit('"')), col))).otherwise(plain)


@dataclass
class MultiDelimiter(Analyzer):
    """Split at any of several delimiters; empty tokens are skipped; none given: the whole input."""

    type_name = "multi_delimiter"
    delimiters: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for k, d in enumerate(self.delimiters):
            if not d or any(o.startswith(d) for j, o in enumerate(self.delimiters) if j != k):
                raise ValueError("a delimiter is empty or another's prefix")

    def _pattern(self) -> str:
        return "|".join(map(re.escape, self.delimiters))

    def raw(self, text: str) -> list[Raw]:
        if not self.delimiters:
            return [(text, 1, 0, len(text))] if text else []
        out, at = [], 0
        for m in re.finditer(self._pattern(), text):
            if m.start() > at:
                out.append((text[at : m.start()], 1, at, m.start()))
            at = m.end()
        return out + ([(text[at:], 1, at, len(text))] if at < len(text) else [])

    def tokens(self, col: Column, offsets: bool = False) -> Column:
        if offsets:
            return super().tokens(col)
        if not self.delimiters:
            return _one(F.when(col != "", col), col)
        return _native(F.filter(F.split(col, self._pattern(), -1), lambda t: t != ""))


@dataclass
class NGram(Analyzer):
    """N-grams from each start in ascending length; the first at a start moves on, the others share its place.  ``utf8`` counts
    characters, ``binary`` bytes (grams that aren't UTF-8 are written with replacement signs)."""

    type_name = "ngram"
    min: int = 1
    max: int = 1
    preserve_original: bool = False
    stream_type: str = "binary"
    start_marker: str = ""
    end_marker: str = ""

    def __post_init__(self) -> None:
        self.min = max(self.min, 1)
        self.max = max(self.max, self.min)

    def raw(self, text: str) -> list[Raw]:
        data: Any = text if self.stream_type == "utf8" else text.encode()
        show: Callable[[Any], str] = (lambda x: x) if self.stream_type == "utf8" else (lambda x: x.decode("utf-8", "replace"))
        n, out = len(data), []
        for start in range(n):
            first, original = True, start > 0 or not self.preserve_original

            def emit(term: str, end: int) -> None:
                nonlocal first
                out.append((term, int(first), start, end))
                first = False

            for size in range(self.min, self.max + 1):
                if start + size > n:
                    break
                end = start + size
                if not original and end == n and not self.start_marker and not self.end_marker:
                    original = True
                gram = show(data[start:end])
                if start == 0 and self.start_marker:
                    emit(self.start_marker + gram, end)
                    if end == n and self.end_marker:
                        emit(gram + self.end_marker, end)
                elif end == n and self.end_marker:
                    emit(gram + self.end_marker, end)
                else:
                    emit(gram, end)
            if not original:
                emit(show(data), n)
        return out

    def tokens(self, col: Column, offsets: bool = False) -> Column:
        if self.stream_type != "utf8" or self.start_marker or self.end_marker or self.preserve_original:
            return super().tokens(col)
        n = F.length(col)
        starts = F.when(n >= self.min, F.sequence(F.lit(0), n - self.min)).otherwise(F.expr("cast(array() as array<int>)"))
        grams = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(self.min), F.least(F.lit(self.max), n - s)), lambda k: F.struct(F.substr(col, s + 1, k).alias("term"), (s + 1).cast("int").alias("pos"), s.cast("int").alias("start"), (s + k).cast("int").alias("end")))))
        return F.coalesce(grams, F.expr(f"cast(array() as {TOKENS})"))


def _case(text: str, case: str) -> str:
    return text.lower() if case == "lower" else text.upper() if case == "upper" else text


def without_accents(text: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


@dataclass
class Norm(Analyzer):
    """One token: composed, cased, accents kept or removed."""

    type_name = "norm"
    locale: str = "en"
    case: str = "none"
    accent: bool = True

    def raw(self, text: str) -> list[Raw]:
        out = _case(unicodedata.normalize("NFC", text), self.case)
        return [(out if self.accent else without_accents(out), 1, 0, len(text))]

    def tokens(self, col: Column, offsets: bool = False) -> Column:
        ascii_only = F.when(F.length(col) == F.octet_length(col), F.lower(col) if self.case == "lower" else F.upper(col) if self.case == "upper" else col)
        return F.when(F.length(col) == F.octet_length(col), _one(ascii_only, col)).otherwise(super().tokens(F.when(F.length(col) != F.octet_length(col), col)))


@dataclass
class Stem(Analyzer):
    """The whole input's stem; languages other than English pass unchanged."""

    type_name = "stem"
    locale: str = "en"

    def raw(self, text: str) -> list[Raw]:
        return [(stem_english(text) if self.locale.split("_")[0].split(".")[0] == "en" else text, 1, 0, len(text))]


@dataclass
class StopWords(Analyzer):
    """One token, dropped if it is a stop word; with ``hex`` the words are given in hexadecimal."""

    type_name = "stopwords"
    stopwords: list[str] = field(default_factory=list)
    hex: bool = False

    def __post_init__(self) -> None:
        if self.hex:
            self.stopwords, self.hex = [bytes.fromhex(w).decode("utf-8", "replace") for w in self.stopwords], False

    def raw(self, text: str) -> list[Raw]:
        return [] if text in self.stopwords else [(text, 1, 0, len(text))]

    def tokens(self, col: Column, offsets: bool = False) -> Column:
        return _one(F.when(~col.isin(self.stopwords), col) if self.stopwords else col, col)


@dataclass
class Collation(Analyzer):
    """One token whose order is a collation's: the text without case and accents, then the text.  ``order`` gives the locale's
    own collation for sorting; raw key bytes aren't reproduced."""

    type_name = "collation"
    locale: str = "en"

    def raw(self, text: str) -> list[Raw]:
        return [(f"{without_accents(text).casefold()}\x01{text.swapcase()}", 1, 0, len(text))]

    def order(self, col: Column) -> Column:
        """For ORDER BY: the text under the locale's collation."""
        language = self.locale.split("_")[0].split(".")[0]
        return F.collate(col, "UNICODE" if language in ("", "en", "root") else language)


def segments(text: str) -> list[tuple[str, int, int]]:
    """Word-boundary segments after UAX#29."""
    cuts = [m.start() for m in regex.finditer(r"(?w)\b", text)]
    edges = sorted({0, len(text), *cuts})
    return [(text[a:b], a, b) for a, b in zip(edges, edges[1:])]


# Where all characters are of these, whose classes are known, a word is letters, digits and low lines, with a sign within letters or within digits.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHER = re.compile(f"[^\\t-\\r -~{_LETTER}¡-©«¬®±¿–—“”„…€]|(?<![{_LETTER}])'(?=[{_LETTER}])")
_PLAIN = re.compile(f"([^{_LETTER}0-9_]*+)((?:[{_LETTER}0-9_]++|(?<=[{_LETTER}])[:.'](?=[{_LETTER}])|(?<=[0-9])[.',;](?=[0-9]))++)")
_ALPHA = regex.compile(r"[\p{L}\p{N}]")
#: There is a word boundary on both sides of ASCII white space, unless what follows extends it, or halves of flags are about.
_CHUNK = re.compile("[^ \\t-\\r]+")
_EXTENDS = regex.compile(r"(?:\A|\s)[\p{WB=Extend}\p{WB=Format}\p{WB=ZWJ}]|\p{RI}")


class _Known(dict):
    """Distinct pieces of text -> what ``make`` makes of them."""

    def __init__(self, make: Callable[[str], Any]) -> None:
        self.make = make

    def __missing__(self, piece: str) -> Any:
        made = self.make(piece)
        if len(piece) <= CHUNK_CHARS:
            if len(self) >= CHUNKS:
                self.clear()
            self[piece] = made
        return made


class Segmented(Analyzer):
    """Looks at each word segment with a letter or digit alone; ``made`` gives its tokens' terms and increments."""

    def made(self, segment: str) -> list[tuple[str, int]]:
        raise NotImplementedError

    def raw(self, text: str) -> list[Raw]:
        return [(t, step, a, b) for s, a, b in segments(text) if _ALPHA.search(s) for t, step in self.made(s)]

    def _known(self, name: str, make: Callable[[str], Any]) -> _Known:
        return vars(self).setdefault(name, _Known(make))

    def add(self, text: str, into: Tokens) -> None:
        """A distinct word, or chunk between white space, is looked at once."""
        if not _OTHER.search(text):
            found = _PLAIN.findall(text)
            if not found:
                return
            gaps, words = zip(*found)
            gap, size = (np.fromiter(map(len, x), np.int64, len(found)) for x in (gaps, words))
            at = np.cumsum(gap + size) - size
            known = self._known("_words", lambda w: tuple(zip(*((t, step, 0, len(w)) for t, step in (self.made(w) if w.strip("_:.',;") else ())))) or ((), (), (), ()))
        elif not _EXTENDS.search(text):
            words, at = _CHUNK.findall(text), np.array([m.start() for m in _CHUNK.finditer(text)], np.int64)
            known = self._known("_chunks", lambda c: tuple(zip(*self.raw(c))) or ((), (), (), ()))
        else:
            super().add(text, into)
            return
        made = list(map(known.__getitem__, words))
        terms, steps, starts, ends = (list(chain.from_iterable([m[k] for m in made])) for k in range(4))
        if terms:
            at = np.repeat(at, [len(m[0]) for m in made])
            into.add(terms, steps, starts + at, ends + at)


@dataclass
class Segmentation(Segmented):
    """Unicode word segments: all of them, those with something to see (graphic), or those with a letter or digit (alpha)."""

    type_name = "segmentation"
    case: str = "lower"
    break_: str = "alpha"

    def made(self, segment: str) -> list[tuple[str, int]]:
        return [(_case(segment, self.case), 1)]

    def raw(self, text: str) -> list[Raw]:
        keep = {"all": lambda s: True, "graphic": lambda s: not s.isspace(), "alpha": _ALPHA.search}[self.break_]
        return [(_case(s, self.case), 1, a, b) for s, a, b in segments(text) if keep(s)]

    def add(self, text: str, into: Tokens) -> None:
        if self.break_ == "alpha":
            super().add(text, into)
        else:
            Analyzer.add(self, text, into)


def load_stopwords(locale: str, path: str | None = None) -> set[str]:
    """First words of the lines of all files in <path>/<language>; lines that start with white space are ignored."""
    folder = os.path.join(path or os.environ.get("QUERN_STOPWORD_PATH", "."), locale.split("_")[0].split(".")[0])
    found: set[str] = set()
    if os.path.isdir(folder):
        for name in sorted(os.listdir(folder)):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                found |= {line.split()[0] for line in f if line.strip() and not line[0].isspace()}
    return found


@dataclass
class Text(Segmented):
    """Words, composed, cased, accents removed, stop words dropped (before stemming, without a gap), stemmed, or cut into edge
    n-grams."""

    type_name = "text"
    locale: str = "en"
    case: str = "lower"
    stopwords: list[str] | None = None
    stopwords_path: str | None = None
    accent: bool = False
    stemming: bool = True
    edge_ngram: dict[str, Any] | None = None

    def __post_init__(self) -> None:
        e = self.edge_ngram
        if e and e.get("max") is not None and e.get("min", 1) > e["max"]:
            raise ValueError("edge n-grams: min exceeds max")
        words = set(self.stopwords or ())
        if self.stopwords_path is not None or self.stopwords is None:
            words |= load_stopwords(self.locale, self.stopwords_path)
        self._stop = words

    def made(self, segment: str) -> list[tuple[str, int]]:
        w = _case(unicodedata.normalize("NFC", segment), self.case)
        w = w if self.accent else without_accents(w)
        if w in self._stop:
            return []
        w = stem_english(w) if self.stemming and self.locale.split("_")[0].split(".")[0] == "en" else w
        if not (e := self.edge_ngram):
            return [(w, 1)]
        low, high = max(e.get("min", 1), 1), e.get("max") or len(w)
        grams = [w[:k] for k in range(low, min(high, len(w)) + 1)]
        if e.get("preserveOriginal") and w not in grams:
            grams.append(w)
        return [(g, int(k == 0)) for k, g in enumerate(grams)]


@dataclass
class Pipeline(Analyzer):
    """Each token goes through the next analyzer; its increment counts on the first token made of it, a dropped token's is
    kept as a gap."""

    type_name = "pipeline"
    stages: list[Analyzer] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.stages = [s for x in self.stages for s in (x.stages if isinstance(x, Pipeline) else [x])]

    def raw(self, text: str) -> list[Raw]:
        tokens: list[Raw] = [(text, 1, 0, len(text))]
        for stage in self.stages:
            made: list[Raw] = []
            gap = 0
            for term, step, a, b in tokens:
                own = stage.raw(term)
                exact = b - a == len(term)
                for k, (t, s, x, y) in enumerate(own):
                    made.append((t, s - 1 + step + gap if k == 0 else s, a + x if exact else a, a + y if exact else b))
                gap = gap + step if not own else 0
            tokens = made
        return tokens


@dataclass
class MinHash(Analyzer):
    """The sketch of another analyzer's tokens, all at one place, from the first token's start to the last one's end."""

    type_name = "minhash"
    num_hashes: int = 1
    analyzer: Analyzer = field(default_factory=Identity)

    def __post_init__(self) -> None:
        if self.num_hashes < 1:
            raise ValueError("numHashes must be at least 1")

    def tokens(self, col: Column, offsets: bool = False) -> Column:
        tokens = self.analyzer.tokens(col, offsets)
        sketch = minhash_column(F.transform(tokens, lambda t: t["term"]), self.num_hashes)
        return F.transform(sketch, lambda h: F.struct(F.regexp_replace(F.base64(F.unhex(F.lpad(F.hex(h), 16, "0"))), "=+$", "").alias("term"), F.lit(1).alias("pos"), F.element_at(tokens, 1)["start"].alias("start"), F.element_at(tokens, -1)["end"].alias("end")))


@dataclass
class Classification(Analyzer):
    """Labels of a model as tokens at one place.  ``model``: text -> [(label, probability)], best first."""

    type_name = "classification"
    model: Callable[[str], list[tuple[str, float]]] | None = None
    top_k: int = 1
    threshold: float = 0.0

    def raw(self, text: str) -> list[Raw]:
        labels = [x for x, p in self.model(text)[: self.top_k] if p >= self.threshold]
        return [(x, int(k == 0), 0, len(text)) for k, x in enumerate(labels)]


@dataclass
class NearestNeighbors(Analyzer):
    """For each known word its nearest words.  ``vectors``: word -> vector; cosine similarity."""

    type_name = "nearest_neighbors"
    vectors: dict[str, list[float]] = field(default_factory=dict)
    top_k: int = 1

    def raw(self, text: str) -> list[Raw]:
        words = list(self.vectors)
        m = np.array([self.vectors[w] for w in words], dtype=float).reshape(len(words), -1)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        out: list[Raw] = []
        for w in text.split():
            if w in self.vectors:
                order = np.argsort(-(m @ m[words.index(w)]), kind="stable")
                near = [words[k] for k in order if words[k] != w][: self.top_k]
                out += [(x, int(k == 0), 0, len(text)) for k, x in enumerate(near)]
        return out


def _of(kind: type, names: dict[str, str]) -> Callable[[dict[str, Any]], Analyzer]:
    def make(p: dict[str, Any]) -> Analyzer:
        if missing := [k for k, v in names.items() if v.endswith("!") and k not in p]:
            raise ValueError(f"{kind.type_name}: missing {missing}")
        return kind(**{names[k].rstrip("!"): v for k, v in p.items() if k in names})

    return make


_REGISTRY: dict[str, Callable[[dict[str, Any]], Analyzer]] = {
    "identity": _of(Identity, {}),
    "empty": _of(Empty, {}),
    "words": _of(Words, {"lower": "lower"}),
    "delimiter": _of(Delimiter, {"delimiter": "delimiter!"}),
    "multi_delimiter": _of(MultiDelimiter, {"delimiters": "delimiters!"}),
    "ngram": _of(NGram, {"min": "min!", "max": "max!", "preserveOriginal": "preserve_original!", "streamType": "stream_type", "startMarker": "start_marker", "endMarker": "end_marker"}),
    "norm": _of(Norm, {"locale": "locale!", "case": "case", "accent": "accent"}),
    "stem": _of(Stem, {"locale": "locale!"}),
    "stopwords": _of(StopWords, {"stopwords": "stopwords!", "hex": "hex"}),
    "collation": _of(Collation, {"locale": "locale!"}),
    "segmentation": _of(Segmentation, {"case": "case", "break": "break_"}),
    "text": _of(Text, {"locale": "locale!", "case": "case", "stopwords": "stopwords", "stopwordsPath": "stopwords_path", "accent": "accent", "stemming": "stemming", "edgeNgram": "edge_ngram"}),
    "pipeline": lambda p: Pipeline([make_analyzer(s["type"], s.get("properties", {})) for s in p["pipeline"]]),
    "minhash": lambda p: MinHash(p["numHashes"], make_analyzer(p["analyzer"]["type"], p["analyzer"].get("properties", {})) if "analyzer" in p else Identity()),
    "classification": _of(Classification, {"model": "model!", "top_k": "top_k", "threshold": "threshold"}),
    "nearest_neighbors": _of(NearestNeighbors, {"vectors": "vectors!", "top_k": "top_k"}),
}


def register_analyzer(name: str, factory: Callable[[dict[str, Any]], Analyzer]) -> None:
    """For analyzers of one's own."""
    _REGISTRY[name] = factory


def make_analyzer(name: str, properties: dict[str, Any] | str | None = None) -> Analyzer:
    """``properties``: a mapping or its JSON; a delimiter's may be the delimiter alone."""
    if name not in _REGISTRY:
        raise ValueError(f"no analyzer {name}")
    if isinstance(properties, str):
        properties = json.loads(properties) if properties.lstrip()[:1] == "{" else {"delimiter": properties} if name == "delimiter" else {"locale": properties}
    return _REGISTRY[name](properties or {})


def normalize(name: str, properties: dict[str, Any] | str | None = None) -> str:
    """The configuration with all defaults, as canonical JSON."""

    def plain(a: Analyzer) -> dict[str, Any]:
        return {k: [plain(x) for x in v] if isinstance(v, list) and v and isinstance(v[0], Analyzer) else plain(v) if isinstance(v, Analyzer) else v if isinstance(v, (str, int, float, bool, list, dict, type(None))) else str(v) for k, v in a.properties().items()} | {"type": a.type_name}

    return json.dumps(plain(make_analyzer(name, properties)), sort_keys=True)
