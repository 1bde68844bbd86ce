"""Whole columns through a tokenizer's word cache: ids for packing, greedy word-piece counts without pieces."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructType

from chainloom.llm.common import small_batches, tidy

#: Words kept in a worker's caches before they start anew: a bound on its memory.
CACHED = 400_000
#: Bytes of text handled at a time.
BLOCK = 4 << 20


def text_blocks(column):
    """(first row, slice) of a pyarrow string column, whole rows of about BLOCK bytes; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        yield i, column.slice(i, j - i)
        i = j


def chunks(column):
    """(chunks, chunk number of every place, row offsets) of a slice: texts cut at blanks and line ends, each different chunk once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
    coded = parts.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    offsets = np.asarray(parts.offsets)
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), offsets - offsets[0]


@lru_cache(1)
def byte_signs() -> dict[int, str]:
    """The sign for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


#: What the file's own pre-tokenizer takes as pieces of a word; Latin text without white space needs no other normalising than lower case.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_latin = re.compile("[\x21-\x7e¡-įı-ɏ]*")


class Words(dict):
    """A cache of what `make` gives for a word."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word):
        if len(self) >= CACHED:
            self.clear()
        out = self[word] = self.make(word)
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Ids of a chunk without blanks, as the tokenizer file gives them: plain Latin chunks by its model from their pieces, all others by its whole pipeline.
    As the file drops white space and no piece spans any, a text's ids are those of its chunks in turn."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.signs = self.tokenizer.model, byte_signs()
        self.find = regex.compile(PIECES).findall
        self.pieces, self.chunks = Words(self.piece), Words(self.chunk)

    def piece(self, piece: str) -> bytes:
        signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.signs)  # printable ASCII stands for itself
        return _packed([t.id for t in self.model.tokenize(signs)])

    def chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self.pieces[chunk.lower()]  # one piece
        if _latin.fullmatch(chunk) and "<|" not in chunk:
            return b"".join(map(self.pieces.__getitem__, self.find(chunk.lower())))
        return _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def column(self, column, end: int):
        """(ids, row offsets) of a slice, with the id `end` after each row."""
        different, places, offsets = chunks(column)
        coded = [*map(self.chunks.__getitem__, different), np.array([end], "<u4").tobytes()]
        sizes = np.array([len(x) >> 2 for x in coded], np.int32)
        flat = np.frombuffer(b"".join(coded), "<u4")
        places = np.insert(places, offsets[1:], len(coded) - 1)
        size = sizes[places]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        kind = np.int32 if max(total[-1], len(flat)) < 1 << 31 else np.int64  # half the memory for all but a giant text
        at = np.repeat(((np.cumsum(sizes, dtype=np.int64) - sizes)[places] - total[:-1]).astype(kind), size)
        at += np.arange(len(at), dtype=kind)
        return flat[at], total[offsets + np.arange(len(offsets))]


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    """One for each worker process, kept between tasks."""
    return WordIds(path)


class LongestMatch:
    """Greedy longest match over a vocabulary in one pass: a trie with failure links. When a state has no way on, the pieces it holds for certain are popped and its failure
    link gives the state of what is left; here only their number is kept, added up when the trie is built. Every single byte is in the vocabulary, so each match goes on."""

    def __init__(self, vocabulary):
        after: list[dict[int, int]] = [{}]
        whole = [False]
        for token in {bytes([b]) for b in range(256)} | {t for t in vocabulary if t}:
            at = 0
            for b in token:
                if b not in after[at]:
                    after[at][b] = len(after)
                    after.append({})
                    whole.append(False)
                at = after[at][b]
            whole[at] = True
        link, popped = [-1] * len(after), [0] * len(after)
        queue = [0]
        for at in queue:  # breadth first: links lead to shorter strings
            for b, to in after[at].items():
                queue.append(to)
                if whole[to]:
                    link[to], popped[to] = 0, 1
                    continue
                back, n = link[at], popped[at]
                while b not in after[back]:
                    back, n = link[back], n + popped[back]
                link[to], popped[to] = after[back][b], n
        self.after, self.link, self.popped = after, link, popped

    def count(self, word: bytes) -> int:
        after, link, popped, at, n = self.after, self.link, self.popped, 0, 0
        for b in word:
            while b not in after[at]:
                n += popped[at]
                at = link[at]
            at = after[at][b]
        while at:
            n += popped[at]
            at = link[at]
        return n


def piece_vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file as bytes, word-end marks dropped."""
    import json

    signs = {s: b for b, s in byte_signs().items()}
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)
    special = {t["content"] for t in entries["added_tokens"]}
    return sorted({bytes(signs[c] for c in t.removesuffix("</w>")) for t in entries["model"]["vocab"] if t not in special})


class WordCounts:
    """Numbers of greedy word pieces of chunks without blanks."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        self.find = regex.compile(PIECES).findall
        self.match = LongestMatch(piece_vocabulary(path))
        self.pieces, self.chunks = Words(lambda p: self.match.count(p.encode())), Words(self.chunk)

    def chunk(self, chunk: str) -> int:
        text = chunk.lower() if _latin.fullmatch(chunk) else self.normalize(chunk)
        return sum(map(self.pieces.__getitem__, self.find(text)))


@lru_cache(2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chunks (runs without blanks or line ends), n_tokens (greedy word pieces of the whole text) of each row of `docs`. No shuffle.

    Cases: null or empty text: 0. Repeated rows and null ids: counted alike. Texts of any length are counted whole. Empty table: no rows. Other columns are ignored."""
    small_batches(docs.sparkSession)
    schema = StructType([docs.select(docs[doc_id].alias("doc_id")).schema[0]]).add("n_chunks", LongType()).add("n_tokens", LongType())

    def counted(batches):
        import pyarrow as pa

        counts = word_counts(path).chunks
        for batch in batches:
            for i, column in text_blocks(batch.column(1)):
                different, places, offsets = chunks(column)
                number = np.array([counts[w] for w in different], np.int64)[places]
                totals = np.concatenate([[0], np.cumsum(number)])[offsets]
                filled = np.concatenate([[0], np.cumsum(np.array([w != "" for w in different], bool)[places])])[offsets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(column)), pa.array(np.diff(filled), pa.int64()), pa.array(np.diff(totals), pa.int64())], names=["doc_id", "n_chunks", "n_tokens"])

    return docs.select(docs[doc_id], docs[text]).mapInArrow(tidy(counted), schema)
