"""BPE encoding and decoding that encodes repeated chunks of text once.

A text is cut where a rolling hash of its last 32 bytes says so, so equal passages are cut alike wherever they stand (chunks of ``LEAST`` to ``MOST`` bytes, about
``LEAST`` + 256 on average, cut between characters). A chunk's ids are kept by the chunk's text in a store of bounded size that a worker holds across documents and tasks:
a chunk that documents share is encoded once there.

The ids of chunks put side by side are wrong where a token crosses a join. The vocabulary's split pattern has places where no token can cross, whatever stands before and
after them (``SURE``): between a visible character and white space, between a letter and ASCII punctuation, and so on. Between two such places ids depend on the text between
them alone, so there the chunk's encoding and the document's agree exactly. A join is repaired by re-encoding from the last such place of one chunk to the
first of the next; if a chunk has none, the window grows over it to the next one that has, at worst to the whole text.

Strings of special tokens are ids of their own and part a text first, as the library does. A vocabulary with another split pattern, a normalizer or a prefix
space has no sure places known here; its texts are encoded whole.

No row moves: documents are encoded where they are read, and a lost executor costs its tasks only. Memory is one batch, one text and the store.

Cases: null and empty texts have no ids, and decode to an empty text. Repeated rows have equal ids. Very long texts are encoded chunk by chunk. An empty
table gives no rows. Columns of other names are carried; ``ids`` and ``decoded`` are the names of the results (parameters), which replace columns of these names.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .tokens import default_path

LEAST, MOST, BITS = 64, 4096, 8
BLOCK = 1 << 20
#: Characters of texts that the store may hold, and of windows.
STORE = 16 << 20
#: No token of a byte-level vocabulary with the usual split pattern crosses such a place. All come after a visible character: how white space is parted
#: depends on what follows it. Only characters whose class is the same in all versions of Unicode are named.
SURE = re.compile(
    r"(?<=[!-~À-ÖØ-öø-ʯ一-龥])(?=[ \t\n\r])"  # visible before white space
    r"|(?<=[A-Za-zÀ-ÖØ-öø-ʯ])(?=[!-@\[-`{-~])"  # letter before digit or sign
    r"|(?<=[0-9])(?=[!-/:-~À-ÖØ-öø-ʯ])"  # digit before letter or sign
    r"|(?<=[一-龥])(?=[、。，！？])"
)


@lru_cache(maxsize=4)
def gear() -> np.ndarray:
    """A random 32-bit number for each byte."""
    return np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def candidates(data: bytes) -> np.ndarray:
    """Places behind a byte at which the rolling hash of the 32 bytes before has BITS leading zeros."""
    out = []
    for at in range(0, len(data), BLOCK):
        start = max(0, at - 31)
        raw = np.frombuffer(data, dtype=np.uint8, count=min(at + BLOCK, len(data)) - start, offset=start)
        h = gear()[raw]
        for step in (1, 2, 4, 8, 16):  # h[i] = sum of gear[byte i-j] << j over j < 2 step
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        out.append(np.flatnonzero(h[at - start :] >> np.uint32(32 - BITS) == 0) + at + 1)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def cuts(data: bytes, found: list[int] | None = None) -> list[int]:
    """Ends of the chunks of data, the last of them len(data). As no cut lies in the first LEAST bytes, candidates may have been found with other bytes before."""
    out, last = [], 0
    for end in candidates(data).tolist() if found is None else found:
        while end - last > MOST:
            last = _whole(data, last + MOST)
            out.append(last)
        end = _whole(data, end)
        if end - last >= LEAST and end < len(data):
            out.append(end)
            last = end
    while len(data) - last > MOST:
        last = _whole(data, last + MOST)
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


def _whole(data: bytes, end: int) -> int:
    """The first place from end on that is not inside a character."""
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end += 1
    return end


class Codec:
    """Encodes and decodes with one vocabulary file and a bounded store of chunks."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        added = d.get("added_tokens") or []
        self.sure = not d.get("normalizer") and {k: v for k, v in (d.get("pre_tokenizer") or {}).items() if k in plain} == plain
        self.sure = self.sure and not any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.special = {a["content"]: a["id"] for a in added}
        self.parting = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks: dict[str, tuple] = {}
        self.windows: dict[str, array] = {}
        self.held = [0, 0]
        self.encoded_chunks = 0  # chunks that were not in the store

    @property
    def library(self):
        if not hasattr(self, "_library"):
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def window(self, text: str) -> array:
        found = self.windows.get(text)
        if found is None:
            found = array("i", tokens.encode(text, self.path))
            if self.held[1] > STORE:
                self.windows, self.held[1] = {}, 0
            if len(text) <= MOST:
                self.windows[text] = found
                self.held[1] += len(text) + 64
        return found

    def chunk(self, text: str) -> tuple:
        """(text up to the first sure place, ids between the first and the last, text from the last on); a single text if there is none."""
        found = self.chunks.get(text)
        if found is None:
            self.encoded_chunks += 1
            first = SURE.search(text)
            if first is None:
                found = (text,)
            else:
                start, end = first.start(), first.start()
                for m in SURE.finditer(text, max(start, len(text) - 24)):
                    end = m.start()
                if end == start:
                    for m in SURE.finditer(text, start):
                        end = m.start()
                found = (text[:start], array("i", tokens.encode(text[start:end], self.path)), text[end:])
            if self.held[0] > STORE:
                self.chunks, self.held[0] = {}, 0
            self.chunks[text] = found
            self.held[0] += len(text) + 64
        return found

    def ordinary(self, data: bytes, found: list[int] | None = None) -> array:
        """Ids of a text without special tokens, given as UTF-8."""
        ids, open_text, at = array("i"), [], 0
        for end in cuts(data, found):
            found = self.chunk(data[at:end].decode("utf-8"))
            at = end
            open_text.append(found[0])
            if len(found) == 3:
                ids += self.window("".join(open_text))
                ids += found[1]
                open_text = [found[2]]
        ids += self.window("".join(open_text))
        return ids

    def encode(self, text: str | None) -> array:
        if not text:
            return array("i")
        if not self.sure:
            return array("i", self.library.encode(text, add_special_tokens=False).ids)
        ids = array("i")
        for part in self.parting.split(text) if self.parting else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self.ordinary(part.encode("utf-8"))
        return ids

    def encode_all(self, texts: Iterable[str]) -> Iterator[array]:
        """Texts in turn; hashes of short ones are taken together."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > BLOCK:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[array]:
        plain = [t.encode("utf-8") if self.sure and not any(s in t for s in self.special) else None for t in texts]
        found = candidates(b"".join(p for p in plain if p is not None))
        at = 0
        for text, data in zip(texts, plain, strict=True):
            if data is None:
                yield self.encode(text)
            else:
                first, last = np.searchsorted(found, (at + 1, at + len(data)))
                yield self.ordinary(data, (found[first:last] - at).tolist())
                at += len(data)

    @property
    def spelt(self) -> pa.LargeBinaryArray:
        """The bytes of each id."""
        if not hasattr(self, "_spelt"):
            # the printable form of byte-level vocabularies: bytes that print stand for themselves, the others follow from U+0100 on
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            vocabulary = self.library.get_vocab(with_added_tokens=True)
            spelt = [b""] * (max(vocabulary.values(), default=-1) + 1)
            for token, i in vocabulary.items():
                spelt[i] = bytes(byte[c] for c in token)
            self._spelt = pa.array(spelt, type=pa.large_binary())
        return self._spelt

    def decode(self, ids: np.ndarray | array | list[int]) -> str:
        if not self.sure:
            return self.library.decode(list(map(int, ids)), skip_special_tokens=False)
        if not len(ids):
            return ""
        # bytes of the ids one behind another are the data of a column of them
        taken = pc.take(self.spelt, pa.array(np.asarray(ids, dtype=np.int32)))
        data = taken.buffers()[2]
        return bytes(data).decode("utf-8", "replace") if data is not None else ""


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, tokenizer_path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column ids: the whole text's token ids, as the ``tokenizers`` library gives them without added special tokens."""
    path = tokenizer_path or default_path()

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        c = codec(path)
        flat, ends = array("i"), array("i", [0])
        for ids in c.encode_all(t.as_py() for t in texts):
            flat += ids
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32)))

    return docs.withColumn(ids, encoded(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def decoded_text(ids: Column, tokenizer_path: str | None = None) -> Column:
    """The text of token ids, special tokens included; null ids give null."""
    path = tokenizer_path or default_path()

    @F.arrow_udf("string")
    def decoded(rows: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([None if r is None else c.decode(r) for r in _lists(rows)], type=pa.string())

    return decoded(ids)


def _lists(rows: pa.Array) -> Iterator[np.ndarray | None]:
    ends, values, nulls = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False), rows.is_null().to_numpy(zero_copy_only=False)
    for a, b, null in zip(ends[:-1], ends[1:], nulls, strict=True):
        yield None if null else values[a:b]


def decode(encoded: DataFrame, tokenizer_path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encoded with the column decoded: the text of its ids."""
    return encoded.withColumn(decoded, decoded_text(F.col(ids), tokenizer_path))


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows with ids and decoded."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
