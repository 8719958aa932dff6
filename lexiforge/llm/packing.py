"""Operator 8: bounded-space best-fit packing of documents into token sequences.

A document becomes the ids of its text and an end id. Only a document longer than a
sequence is cut: into full pieces, which fill sequences of their own, and the remainder in
front as its first piece. Pieces are dealt by a hash to as many partitions as their number
asks for and taken as they come, in the order of the hash; each goes to the open sequence
with the least space that holds it. Open
sequences are kept in stacks keyed by free space, the spaces in use in a bitset; when
`OPEN` are open, the fullest closes.

Ids are those of the public byte-level BPE vocabulary. Words are encoded once and then
looked up in a bounded cache; the merges run in a rank encoder of the same
vocabulary. Texts in which white space is more than single blanks and newlines go
through the tokenizer file itself.

Defined cases: null text is empty and still has its end id; special-token strings in a text
are ordinary text; repeated rows are packed as often as they occur; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import Scratch

LENGTH = 1024
END = 2
OPEN = 512
CACHED = 200_000
#: Pieces of a partition: enough that the sequences left open at its end don't count.
PIECES = 60_000
_ODD_SPACE = re.compile(r"[^\S \n]|[ \n][ \n]|^[ \n]|[ \n]$|[^\x21-\x7e¡-ɏͰ-ӿ‐-‧‰-⁞₠-₿一-鿌 \n]")


def _asset(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """text -> ids as little-endian uint32 bytes."""

    def __init__(self, tokenizer: str, ranks: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.words = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe.encode_ordinary
        self.blank = np.zeros(max(table.values()) + 2, bool)
        self.blank[[v for k, v in table.items() if k[:1] == b" "]] = True
        self.newline = np.array([table[b"\n"]], "<u4").tobytes()
        self.whole = Tokenizer.from_file(tokenizer)
        self.whole.encode_special_tokens = True
        self.cache: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        ids = np.array(self.words("".join([" " + w for w in words])), "<u4")
        at = (np.flatnonzero(self.blank[ids]) * 4).tolist()
        if len(at) != len(words):
            raise ValueError("a word has more than one id that begins with a blank")
        data = ids.tobytes()
        for word, a, b in zip(words, at, [*at[1:], len(data)]):
            self.cache[word] = data[a:b]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        lines = [line.partition(" ") for line in text.split("\n")]
        rests = [rest.split(" ") if blank else [] for _, blank, rest in lines]
        new = {w for rest in rests for w in rest if w not in self.cache}
        if new:
            if len(self.cache) + len(new) > CACHED:
                self.cache.clear()
                new = {w for rest in rests for w in rest}
            self.learn(sorted(new))
        out: list[bytes] = []
        for (first, _, _), rest in zip(lines, rests):
            out.append(self.newline)
            out.append(np.array(self.words(first), "<u4").tobytes())
            out += map(self.cache.__getitem__, rest)
        return b"".join(out[1:])


def pieces_of(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), one row for each piece."""
    tokenizer, ranks = tokenizer or _asset("byte_bpe_50k.json"), ranks or _asset("byte_bpe_50k.tiktoken")
    end = np.array([END], "<u4").tobytes()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ranks)
        for batch in it:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encoder.encode(text or "") + end
                n = len(data) // 4
                first = n % length or length
                for piece, start in enumerate([0, *range(first, n, length)]):
                    size = first if piece == 0 else length
                    rows.append((doc_id, piece, start, size, zlib.crc32(data[4 * start : 4 * (start + size)])))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    shown = docs.select("doc_id", "text")
    return shown.mapInArrow(cut, f"doc_id {shown.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """At most `most` open bins, found by free space."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.open, self.bits, self.next = length, most, 0, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        bin_id = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for an item."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_id, self.next = self.length, self.next, self.next + 1
        left = free - size
        if left:
            self.stacks[left].append(bin_id)
            self.bits |= 1 << left
            self.open += 1
        return bin_id, self.length - free


def pack(pieces: DataFrame, length: int = LENGTH, most_open: int = OPEN, partitions: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset."""
    if partitions is None:
        # Written once: counted here and packed below.
        pieces = Scratch(pieces.sparkSession, "pack").save(pieces, "pieces")
        partitions = max(1, math.ceil(pieces.count() / PIECES))
    place = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.repartition(partitions, place).sortWithinPartitions(F.xxhash64(place, F.lit(1)), "doc_id", "piece", "ids_crc32", "length")

    def fill(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = Bins(length, most_open)
        base = TaskContext.get().partitionId() << 40
        for pdf in it:
            placed = [bins.place(s) for s in pdf["length"].tolist()]
            yield pdf.assign(sequence_id=np.array([base + b for b, _ in placed], np.int64), offset=np.array([o for _, o in placed], np.int64))

    return dealt.mapInPandas(fill, pieces.schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(pieces_of(docs))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
