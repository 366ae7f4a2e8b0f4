"""Best-fit decreasing packing of documents into sequences of bounded length.

Pieces of one length are alike to the packer, so it needs only how many there are of each length, at most SIZE numbers
whatever the corpus holds. Lengths go from long to short; a segment tree over remaining capacities finds the tightest open
bins that a length fits in, in logarithmic time, and fills all of them at once. What comes out is a plan of runs, "so many
pieces of this length, from this bin on, at this offset", of which there are at most a few for each length and halving of a
capacity. Each piece finds its run by its number among the pieces of its length. The result is what best-fit decreasing
gives piece by piece.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from trafficjobs.llm.bpe import byte_alphabet
from trafficjobs.llm.common import fresh, in_arrow, materialize, named, small

SIZE, END = 4096, 1
#: Words, and pre-tokens, that a generation of a worker's cache may hold, bytes of text encoded at once, and pieces numbered in one task.
CACHE, PART, NUMBERED = 500_000, 1_000_000, 200_000

# The normalizer and pre-token pattern of the file whose words can be encoded one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE = re.compile(rb"[ \t-\r]")
#: Letters whose lower case and normal form hang on no other letter: below the combining marks, and Cyrillic without its own.
_ALONE = re.compile(r"[\x00-\u012f\u0131-\u02ff\u0400-\u0482\u048a-\u052f]*")


class Known(dict):
    """What learn gives for a key, kept for two generations of at most about CACHE keys each."""

    def __init__(self, learn: Callable):
        super().__init__()
        self.learn, self.old = learn, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.learn(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()


class Words:
    """A tokenizer file; a text's ids as packed little-endian unsigned 32-bit integers.

    No pre-token of word tokenizers holds white space, so the ids of a text are those of its words between ASCII white space,
    one after the other. A worker encodes each word once and keeps it in a cache of bounded size. Files of another shape are
    left to the tokenizers library, text by text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        parts = json.loads(Path(path).read_text(encoding="utf-8"))
        normal, split = (parts[k] or {} for k in ("normalizer", "pre_tokenizer"))
        first, *rest = split.get("pretokenizers") or [{}]
        self.by_word = (
            normal.get("normalizers") == NORMALIZERS and first.get("pattern") == {"Regex": PATTERN} and first.get("invert") is True and first.get("behavior") == "Removed"
            and [(s["type"], s["add_prefix_space"], s["use_regex"]) for s in rest] == [("ByteLevel", False, False)] and parts["model"]["type"] == "BPE" and not parts["model"]["dropout"]
            and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in parts["added_tokens"])
        )
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.pattern, self.tokenize = regex.compile(PATTERN), self.library.model.tokenize
        self.words, self.tokens = Known(self._word), Known(self._token)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _token(self, token: str) -> bytes:
        spelled = token if token.isascii() and token.isprintable() else "".join(self.letters[b] for b in token.encode())
        ids = [t.id for t in self.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        """A word without ASCII white space: a simple one by its pre-tokens, another by the library."""
        letters = word.rstrip(b".,;:!?")
        if letters.isalpha():  # ASCII letters, then a mark or several
            ids = self.tokens[letters.lower().decode()]
            return ids if len(letters) == len(word) else ids + self.tokens[word[len(letters) :].decode()]
        text = word.decode()
        if not _ALONE.fullmatch(text) or any(s in text for s in self.special):
            return self._whole([text])[0]
        return b"".join(map(self.tokens.__getitem__, self.pattern.findall(text.lower())))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of some UTF-8 texts."""
        if not self.by_word:
            return self._whole([t.decode() for t in texts])
        of = self.words.__getitem__
        out = [b"".join(map(of, t.split())) for t in texts]
        self.words.trim()
        self.tokens.trim()
        return out

    def encode_long(self, text: bytes) -> bytes:
        """The ids of one text, about PART bytes at a time."""
        if not self.by_word:
            return self._whole([text.decode()])[0]
        out, at = bytearray(), 0
        while at < len(text):
            cut = _SPACE.search(text, min(len(text), at + PART))
            end = cut.start() if cut else len(text)
            out += self.encode([text[at:end]])[0]
            at = end
        return bytes(out)


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def _packed(parts: list[bytes]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(parts))])


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with keep_ids, ids for each piece of each document.

    A document's ids are those that the tokenizers library gives for the file at path without special tokens added, then the
    id end. Only what is longer than size is cut. A null or empty text is the end id alone; rows that repeat a doc_id are
    documents of their own, a null doc_id stays. The path must hold the file on every machine; other columns are left out.
    """
    last = np.array([end], "<u4").tobytes()

    def cut(rows: list[int], ids: list[bytes], names: pa.Array) -> pa.RecordBatch:
        own, number, blobs = [], [], []
        for row, packed in zip(rows, ids):
            packed += last
            for k in range(0, len(packed), 4 * size):
                own.append(row)
                number.append(k // (4 * size))
                blobs.append(packed[k : k + 4 * size])
        number = np.array(number, dtype=np.int64)
        columns = [names.take(pa.array(own, pa.int64())), pa.array(number, pa.int32()), pa.array(number * size), pa.array([len(b) // 4 for b in blobs], pa.int64()), pa.array([zlib.crc32(b) for b in blobs], pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *([_packed(blobs)] if keep_ids else [])], names=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words_of(path)
        for batch in batches:
            names, column = batch.column(0), batch.column(1)
            rows, texts, held = [], [], 0
            for row in range(len(batch)):
                buffer = column[row].as_buffer()
                text = b"" if buffer is None else buffer.to_pybytes()
                if len(text) > PART:
                    yield cut([row], [own.encode_long(text)], names)
                    continue
                rows.append(row)
                texts.append(text)
                held += len(text)
                if held > PART:
                    yield cut(rows, own.encode(texts), names)
                    rows, texts, held = [], [], 0
            if rows:
                yield cut(rows, own.encode(texts), names)

    schema = f"doc_id {docs.select('doc_id').schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    out = [f.split()[0] for f in schema.split(", ")]
    return in_arrow(docs.select("doc_id", F.col("text").cast("string")), run, schema)


class Open:
    """Open bins by remaining capacity: a segment tree of how many there are, and ranges of bin numbers at its leaves."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, room: int, first: int, n: int) -> None:
        """n bins from number first on have so much room."""
        if n:
            self.ranges[room].append((first, n))
            self._add(room, n)

    def tightest(self, length: int) -> int | None:
        """The least room that the length fits in and some bin has."""
        at = length + self.leaves
        if self.count[at]:
            return length
        while at > 1:
            if not at & 1 and self.count[at + 1]:  # the sibling on the right holds greater rooms
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to most bins of one range with that room, out of the tree: their first number and how many."""
        first, n = self.ranges[room].pop()
        used = min(n, most)
        if used < n:
            self.ranges[room].append((first + used, n - used))
        self._add(room, -used)
        return first, used


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, int]:
    """Best-fit decreasing for counts of pieces by length. Returns runs, a row each, and the number of bins.

    A run is (length, number of its first piece, pieces a bin, first bin, offset): the pieces of that length, numbered from 0,
    go one after the other into the bins.
    """
    bins, open_bins, runs = 0, Open(size), []
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        done, n = 0, counts[length]
        while done < n:
            room = open_bins.tightest(length)
            left = n - done
            each = (size if room is None else room) // length
            if room is None:
                room, first, used = size, bins, -(-left // each)
                bins += used
            else:
                first, used = open_bins.take(room, -(-left // each))
            # equal pieces fill a bin before the next: what is left in it stays the tightest
            runs.append((length, done, each, first, size - room))
            whole, part = divmod(min(left, used * each), each)
            open_bins.put(room - each * length, first, whole)
            if part:
                open_bins.put(room - part * length, first + whole, 1)
            done += whole * each + part
    return np.array(runs, dtype=np.int64).reshape(-1, 5), bins


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """cut with sequence_id and offset: where each row of that length lies. Other columns stay, whatever their names, but these two.

    Sequences hold at most size and are numbered from 0. Rows of equal length are numbered by doc_id and piece inside hashed
    ranges, so that a length that most rows have is many tasks. An empty table gives an empty result; lengths must be from 1
    to size.
    """
    bucket, number, at = fresh(cut, "bucket", "number", "at")
    columns = named(cut, "sequence_id", "offset")
    rows = materialize(cut.select(*columns), "pieces")
    counted = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most size rows
    runs, _ = plan({r["length"]: r["n"] for r in counted}, size)
    ranges = max(8, -(-sum(r["n"] for r in counted) // NUMBERED))
    dealt = rows.withColumn(bucket, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(ranges)).cast("int"))
    met = materialize(dealt.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("n")), "ranges")
    before = F.sum("n").over(Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("length", bucket).orderBy("doc_id", "piece", "ids_crc32")) - 1
    dealt = dealt.withColumn(number, inside).join(small(met.select("length", bucket, before.alias(at))), ["length", bucket])

    keys = (runs[:, 0] << 48) + runs[:, 1]  # in the order of lengths and numbers
    order = np.argsort(keys)
    keys, runs = keys[order], runs[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, own = (batch.column(batch.num_columns - k).to_numpy() for k in (2, 1))
            _, first, each, start, offset = runs[np.searchsorted(keys, (length << 48) + own, side="right") - 1].T
            own = own - first
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(start + own // each), pa.array(offset + own % each * length)], names=names)

    kept = rows.select(*named(rows))
    names = [*kept.columns, "sequence_id", "offset"]
    schema = kept.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return in_arrow(dealt.select(*named(rows), F.col("length").cast("long").alias(bucket), (F.col(number) + F.col(at)).cast("long").alias(number)), run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, starts: the packed ids of each sequence and where in it each document's piece begins."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))


def n_sequences_at_least(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """One row, least: no packing has fewer sequences. Of pieces over half the size each needs its own, and the rest at least its share."""
    big = F.count_if(F.col("length") * 2 > size)
    return cut.agg(F.greatest(big, F.ceil(F.coalesce(F.sum("length"), F.lit(0)) / size)).alias("least"))
