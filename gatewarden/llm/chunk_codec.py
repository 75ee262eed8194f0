"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts a text where its own content says so, so the same passage gives the same chunks in
whatever document it stands. A chunk is encoded the first time a worker meets it; later documents with the same chunk
take its tokens from the worker's store. Tokens near a cut may differ from those of the whole text: each chunk keeps
the tokens between its first and last stable place (see ``bpe``) only, and the seam from the last stable place of one
chunk to the first of the next is encoded anew. A chunk without a stable place joins the seam, which so grows until both
sides agree, up to the whole text.

The store holds whole chunk bytes as keys (no hash can confuse two chunks) and drops the least recently used beyond
``STORE_BYTES``, which costs time, never results. Nothing is shuffled or broadcast, and a lost executor's tasks simply
run again.

Edge cases: a null text counts as empty (no tokens, hashes of the empty string); repeated rows each get a row; extra
columns pass through, and results take the place of columns with their names.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewarden.llm.bpe import FIRST_STABLE, LAST_STABLE, default_path, vocabulary
from gatewarden.llm.common import others as kept
from gatewarden.llm.common import table

#: Chunks have MIN to MAX bytes, MIN + 2 ** AVERAGE_BITS on average; the hash sees the last 32.
AVERAGE_BITS, MIN_CHUNK, MAX_CHUNK = 10, 256, 8192
STORE_BYTES = 48_000_000
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Where chunks end, the end of the data last; every cut is between two characters of UTF-8."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):  # h[i] sums GEAR of the byte k places back, shifted by k, for k under 2 * step
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    marked = np.flatnonzero(h >> np.uint32(32 - AVERAGE_BITS) == 0) + 1
    marked = marked[marked < n]
    marked = marked[(raw[marked] & 0xC0) != 0x80]
    out, last = [], 0
    for cut in [*marked.tolist(), n]:
        while cut - last > MAX_CHUNK:
            last += MAX_CHUNK
            while last < n and data[last] & 0xC0 == 0x80:
                last += 1
            out.append(last)
        if cut - last >= MIN_CHUNK or cut == n and cut > last:
            out.append(cut)
            last = cut
    return out


class ChunkCodec:
    """Encodes texts; chunks seen before come from the store."""

    def __init__(self, path: str, store_bytes: int = STORE_BYTES):
        self.vocabulary = vocabulary(path)
        self.encoding = self.vocabulary.encoding()
        self.names = {i: str(i) for i in self.vocabulary.bytes}
        self.store: OrderedDict[bytes, tuple] = OrderedDict()
        self.room = store_bytes
        self.hits = self.misses = 0

    def _tokens(self, text: str) -> tuple[list[int], str, bytes]:
        """Ids, their decimal forms joined by commas, and the bytes they decode to."""
        ids = self.encoding.encode(text, allowed_special="all")
        names = self.names
        return ids, ",".join([names[i] for i in ids]), self.encoding.decode_bytes(ids)

    def _chunk(self, data: bytes) -> tuple:
        """(text before the first stable place, tokens up to the last one, text after it); no tokens without a place."""
        found = self.store.get(data)
        if found is not None:
            self.hits += 1
            self.store.move_to_end(data)
            return found
        self.misses += 1
        text = data.decode("utf-8")
        first = FIRST_STABLE.search(text)
        if first is None:
            found = text, None, ""
        else:
            last = LAST_STABLE.match(text).end()
            found = text[: first.end()], self._tokens(text[first.end() : last]), text[last:]
        self.store[data] = found
        self.room -= 8 * len(data) + 500
        while self.room < 0 and len(self.store) > 1:
            old, _ = self.store.popitem(last=False)
            self.room += 8 * len(old) + 500
        return found

    def pieces(self, text: str) -> list[tuple[list[int], str, bytes]]:
        """Tokens of successive parts of the text, which together are those of the whole."""
        out, seam, last = [], "", 0
        data = text.encode("utf-8")
        for cut in cuts(data):
            head, body, tail = self._chunk(data[last:cut])
            last = cut
            seam += head
            if body is not None:
                out.append(self._tokens(seam))
                out.append(body)
                seam = tail
        if seam:
            out.append(self._tokens(seam))
        return [x for x in out if x[0]]

    def encode(self, text: str | None) -> list[int]:
        return [i for ids, _, _ in self.pieces(text or "") for i in ids]

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8", "replace")


_codecs: dict[str, ChunkCodec] = {}


def codec(path: str) -> ChunkCodec:
    """One a worker process, so that the store serves all its tasks."""
    if path not in _codecs:
        _codecs[path] = ChunkCodec(path)
    return _codecs[path]


#: What ``encode`` can add, by name.
OUTPUTS = {
    "n_tokens": ("bigint", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def _results(codec: ChunkCodec, text: str | None, outputs: tuple[str, ...]) -> list:
    parts = codec.pieces(text or "")
    out = []
    for name in outputs:
        if name == "n_tokens":
            out.append(sum(len(p[0]) for p in parts))
        elif name == "ids":
            out.append([i for p in parts for i in p[0]])
        elif name == "decoded":
            out.append(b"".join(p[2] for p in parts).decode("utf-8", "replace"))
        elif name == "ids_sha256":
            out.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
        else:
            whole = b"".join([p[2] for p in parts])
            out.append(hashlib.sha256(whole.decode("utf-8", "replace").encode()).hexdigest())
    return out


def encode(docs: DataFrame, path: str | None = None, text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """``docs`` without ``text``, with the columns named in ``outputs`` (see ``OUTPUTS``) for each row's whole text."""
    path = path or default_path()
    others = kept(docs, text, *outputs)
    schema = T.StructType(others + [T.StructField(n, T._parse_datatype_string(OUTPUTS[n][0])) for n in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            rows = [_results(own, x.as_py(), outputs) for x in batch.column(len(others))]
            made = [pa.array([r[k] for r in rows], OUTPUTS[n][1]) for k, n in enumerate(outputs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *made], names=[*[f.name for f in others], *outputs])

    return docs.select(*[F.col(f"`{f.name}`") for f in others], F.col(f"`{text}`")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the texts that its id lists decode to; null lists give null."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text_of(column):  # noqa: ANN001, ANN202
        own = codec(path)
        return column.map(lambda x: None if x is None else own.decode([int(i) for i in x]))

    return encoded.withColumn(to, text_of(F.col(f"`{ids}`")))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
