"""Exact token counts of every prefix of a text, by dynamic programming.

In byte-level BPE a sequence of tokens is what the encoder makes of its bytes if, and only if, it makes each pair of
neighbours of their bytes. So the encoding of a prefix ends in one token, found among those whose bytes end the prefix:
the one that the encoder leaves beside the last token of the shorter prefix before it. Going through a pre-token from
left to right this gives, for each prefix, its last token and its count from that shorter prefix's.

A text is cut at stable places (see ``bpe``); counts of a piece's prefixes are kept by piece, and the count of any prefix
of the text is that of the pieces before plus one entry. Truncation and budget questions are looked up in these tables.

The store of pieces is emptied when it holds ``STORE_PIECES``, which costs time, never results.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows each get a row; very long texts, runs of white
space, words and sequences of special strings cost in proportion to their length; an empty table gives an empty
result; extra columns pass through, and results take the place of columns with their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewarden.llm.bpe import PATTERN, PIECE, WHITE, default_path, vocabulary
from gatewarden.llm.common import others as kept
from gatewarden.llm.common import table

#: Entries that the stores hold at most, and the longest piece that is kept in one.
STORE_PIECES, STORE_PAIRS, KEPT_PIECE = 400_000, 1_000_000, 200
LIMIT = 1024
BLANK = re.compile(f"^[{WHITE}]+")
#: Characters outside Latin, Greek, Cyrillic and general punctuation.
UNSURE = re.compile("[^\x00-\u052f\u2000-\u2064]")


class PrefixCounter:
    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary(path)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.pattern = regex.compile(PATTERN)
        self.merged = self.vocabulary.encoding()._encode_single_piece  # the encoder on the bytes of one pre-token
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.contractions = {"'re", "'ve", "'ll"}
        self.ends = ahocorasick.Automaton()
        for b, i in self.vocabulary.ids.items():
            if self.merged(b) == [i]:  # others are never what the encoder makes of their own bytes
                self.ends.add_word(b.decode("latin-1"), (len(b), i))
        self.ends.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def pre_tokens(self, text: str) -> list[tuple[int, int]]:
        """Where the pre-tokens begin and end; by a pattern for scripts that every version of Unicode knows alike."""
        if UNSURE.search(text):
            return [span for _, span in self.split(text)]
        return [m.span() for m in self.pattern.finditer(text)]

    def _beside(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= STORE_PAIRS:
                self.pairs.clear()
            of = self.vocabulary.bytes
            found = self.pairs[a, b] = self.merged(of[a] + of[b]) == [a, b]
        return found

    def _pre_token(self, data: str) -> list[int]:
        """Counts of each prefix of a pre-token given as Latin-1, from 0 bytes on."""
        n = len(data)
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        pairs = self.pairs
        done = -1
        for end, (size, token) in self.ends.iter(data):
            if end == done:
                continue
            start = end + 1 - size
            if start == 0 or ((ok := pairs.get((last[start], token))) or ok is None and self._beside(last[start], token)):
                counts[end + 1], last[end + 1], done = counts[start] + 1, token, end
        return counts

    def _counts(self, part: str) -> list[int]:
        """Counts of each prefix of a pre-token by characters, from 1 on."""
        data = part.encode()
        counts = self._pre_token(data.decode("latin-1"))
        return counts[1:] if len(data) == len(part) else [counts[k] for k in accumulate(len(c.encode()) for c in part)]

    def _run(self, text: str) -> list[int]:
        """Counts of each prefix by characters, from the empty one on, of white space followed by other characters, read
        as a text of its own without special strings.

        A prefix that ends within the white space is one pre-token. Behind it, the last white-space character begins the
        next pre-token or stands alone, and pre-tokens of a prefix are those of the whole, the last one cut - but for
        the first two of a contraction's three characters, which are two pre-tokens.
        """
        white = len(text) - len(BLANK.sub("", text, count=1))
        out = [0, *(self._counts(text[:white]) if white else [])]
        if white == len(text):
            return out
        at = max(white - 1, 0)
        before = out[at]
        for a, b in self.pre_tokens(text[at:]):
            part = text[at + a : at + b]
            counts = self._counts(part)
            if part in self.contractions:
                counts[1] = counts[0] + self._counts(part[1])[0]
            out.extend([before + c for c in counts[(a == 0 and white > 0) :]])
            before += counts[-1]
        return out

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Counts of each prefix of a piece by characters, from the empty one on, in one pass: what stands before a special
        string is a text of its own, and until that string ends its characters are ordinary ones."""
        letters = piece[1:] if piece[0] == " " else piece
        if letters.isalpha() and letters.isascii():
            return tuple(self._pre_token(piece))
        out, before, at = [0], 0, 0
        for m in self.special.finditer(piece) if self.special else ():
            counts = self._run(piece[at : m.end() - 1])
            out.extend([before + c for c in counts[1:]])
            before += counts[m.start() - at] + 1
            out.append(before)
            at = m.end()
        out.extend([before + c for c in self._run(piece[at:])[1:]])
        return tuple(out)

    def counts_of(self, piece: str) -> tuple[int, ...]:
        found = self.pieces.get(piece)
        if found is None:
            found = self._piece(piece)
            if len(piece) <= KEPT_PIECE:
                if len(self.pieces) >= STORE_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def total(self, text: str | None) -> int:
        """Tokens of the whole text."""
        pieces, out = self.pieces, 0
        for piece in PIECE.findall(text or ""):
            counts = pieces.get(piece)
            out += counts[-1] if counts is not None else self.counts_of(piece)[-1]
        return out

    def prefixes(self, text: str | None) -> np.ndarray:
        """Tokens of text[:k] at k, for every k up to the length."""
        out, before = [np.zeros(1, np.int64)], 0
        for piece in PIECE.findall(text or ""):
            counts = np.array(self.counts_of(piece)[1:], np.int64)
            out.append(counts + before)
            before += int(counts[-1])
        return np.concatenate(out)

    def truncated(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens (counts may fall by a merge, so the last)."""
        return int(np.flatnonzero(self.prefixes(text) <= budget)[-1])


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count(docs: DataFrame, path: str | None = None, text: str = "text", to: str = "n_tokens", budget: int | None = None) -> DataFrame:
    """``docs`` without ``text``, with the token count of each row's whole text and, if a budget is given, the characters
    of the longest prefix within it as ``fits_chars``."""
    path = path or default_path()
    made = [T.StructField(to, T.LongType())] + [T.StructField("fits_chars", T.LongType())] * (budget is not None)
    others = kept(docs, text, *[f.name for f in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = [x.as_py() for x in batch.column(len(others))]
            arrays = [pa.array([own.total(x) for x in texts], pa.int64())]
            if budget is not None:
                arrays.append(pa.array([own.truncated(x, budget) for x in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *arrays], names=[f.name for f in [*others, *made]])

    return docs.select(*[F.col(f"`{f.name}`") for f in others], F.col(f"`{text}`")).mapInArrow(run, T.StructType(others + made))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return count(sized).withColumn("over_limit", F.col("n_tokens") > LIMIT)
