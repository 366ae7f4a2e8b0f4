"""Byte-level BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over 16 bytes cuts texts into chunks of about 1,000 bytes where the content says so, hence copies and shared
passages give equal chunks. A worker encodes each chunk once and keeps the ids in a cache of bounded size. Where chunks
join, the tokens around are encoded again between two white-space starts; the new ids must agree with the old ones in a
whole segment on either side, else the window widens, up to the whole text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficjobs.llm.common import cuts, in_arrow, mix, named, strings

WINDOW, CUT_BITS = 16, 10
#: Bytes of chunk text that a worker's cache may hold, in either of its two generations, and of texts encoded at once.
CACHE_BYTES, PIECE = 8_000_000, 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


# Fixed value: the pre-token pattern of byte-level tokenizers with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else the next free code point from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def safe_start(before: str, after: str) -> bool:
    """Whether a pre-token surely ends between the two characters: ASCII white space after ASCII that is none."""
    return after in " \t\n\r\v\f" and before < "\x80" and not before.isspace() and not "\x1c" <= before <= "\x1f"


class Codec:
    """A tokenizer file, the bytes of its tokens, and a cache of encoded chunks.

    If the file is plain byte-level BPE whose ids follow its merges, tiktoken encodes with the same vocabulary, which is
    several times as fast and small; the tokenizers library is loaded only otherwise, and where tiktoken's pattern matching
    gives up.
    """

    def __init__(self, path: str):
        self.path, self.library, self.fast = path, None, None
        parts = json.loads(Path(path).read_text(encoding="utf-8"))
        added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        ranks = self._ranks(parts, added)
        if ranks is not None:
            import tiktoken

            special = {i: t.encode() for t, i in added.items()}
            pieces = {i: p for p, i in ranks.items()} | special
            self.pieces = [pieces.get(i, b"") for i in range(max(pieces, default=-1) + 1)]
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        else:
            library, alphabet, special = self._library(), byte_alphabet(), set(added.values())
            tokens = ((i, library.id_to_token(i) or "") for i in range(library.get_vocab_size()))
            self.pieces = [t.encode() if i in special else bytes(alphabet[c] for c in t) for i, t in tokens]
        self.starts = np.array([safe_start("a", chr(p[0])) if p else False for p in self.pieces])
        self.solid = np.array([safe_start(chr(p[-1]), " ") if p else False for p in self.pieces])
        self.young: dict[str, np.ndarray] = {}
        self.old: dict[str, np.ndarray] = {}
        self.held = self.asked = self.met = 0

    def _library(self):
        if self.library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library

    @staticmethod
    def _ranks(parts: dict, added: dict[str, int]) -> dict[bytes, int] | None:
        """The bytes of each token and its id, if tiktoken gives the same ids as the file's own rules; else None."""
        model, split = parts["model"], parts["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not parts["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        merges = (m if isinstance(m, str) else " ".join(m) for m in model.get("merges", []))
        if not plain or any(model["vocab"].get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)):
            return None
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"]):
            return None
        alphabet, special = byte_alphabet(), set(added.values())
        return {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if i not in special}

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its pattern engine gives up on very long runs
                pass
        return np.array(self._library().encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def learn(self, chunks: set[str]) -> dict[str, np.ndarray]:
        """The ids of all these chunks; those not in the cache are encoded."""
        known = {c: x for c in chunks if (x := self.young.get(c, self.old.get(c))) is not None}
        self.asked, self.met = self.asked + len(chunks), self.met + len(known)
        fresh = [c for c in chunks if c not in known]
        for c in fresh:
            known[c] = self.encode(c)
        for c in chunks:
            if c not in self.young:
                self.young[c] = known[c]
                self.held += len(c) + 4 * len(known[c])
        if self.held > CACHE_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        return known

    def safe(self, ids: np.ndarray) -> np.ndarray:
        """Indices at which a token starts a pre-token whatever the context is."""
        return np.flatnonzero(self.starts[ids[1:]] & self.solid[ids[:-1]]) + 1

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joined text. left is right but for its end, right but for its start and end."""
        if not len(left) or not len(right):
            return right if len(right) else left
        if self.starts[right[0]] and self.solid[left[-1]]:
            return np.concatenate((left, right))
        near, wide = 48, 1
        while True:
            tail, head = left[-near:], right[:near]
            a, b = self.safe(tail), self.safe(head)
            all_left, all_right = len(tail) == len(left), len(head) == len(right)
            # the outer segments, of known ids, are the context in which old and new ids have to agree
            i, i2 = (a[-wide], a[-wide - 1]) if len(a) > wide else (None, None)
            j, j2 = (b[wide - 1], b[wide]) if len(b) > wide else (None, None)
            if (i is None and not all_left) or (j is None and not all_right):
                near *= 2
                continue
            if i is None:
                i = i2 = 0
            if j is None:
                j = j2 = len(head)
            new = self.encode(self.text(np.concatenate((tail[i2:], head[:j2]))))
            p, q = i - i2, j2 - j
            if np.array_equal(new[:p], tail[i2:i]) and np.array_equal(new[len(new) - q :], head[j:j2]):
                return np.concatenate((left[: len(left) - len(tail) + i2], new, right[j2:]))
            wide *= 2

    def encode_rows(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of UTF-8 text."""
        bounds = chunk_bounds(raw, offsets)
        whole = raw.tobytes()
        pieces = [whole[a:b].decode("utf-8") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        known = self.learn(set(pieces))
        first = np.searchsorted(bounds, offsets).tolist()
        empty, out = np.zeros(0, np.uint32), []
        for row in range(len(offsets) - 1):
            ids = empty
            if offsets[row + 1] > offsets[row]:
                ids = known[pieces[first[row]]]
                for k in range(first[row] + 1, first[row + 1]):
                    ids = self.join(ids, known[pieces[k]])
            out.append(ids)
        return out


def chunk_bounds(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted distinct offsets of chunks: row starts and ends, and where the hash of the last WINDOW bytes of the row ends in CUT_BITS zeros, not inside a character."""
    n = len(raw)
    found = np.zeros(0, np.int64)
    if n > WINDOW:
        value = raw.astype(np.uint64) + np.uint64(1)
        rolled = np.zeros(n - WINDOW, dtype=np.uint64)
        for k in range(WINDOW):
            rolled = rolled * _BASE + value[k : k + n - WINDOW]
        cut = (mix(rolled) >> np.uint64(64 - CUT_BITS)) == 0
        cut &= (raw[WINDOW:] & 0xC0) != 0x80
        found = np.flatnonzero(cut) + WINDOW
        row = np.searchsorted(offsets, found, side="right") - 1
        found = found[found - offsets[row] >= WINDOW]
    return np.unique(np.concatenate((offsets, found)))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _blobs(parts: list[bytes], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))).astype(np.int32)
    return pa.Array.from_buffers(kind, len(parts), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(parts))])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with a binary column ids: the token ids of each whole text as little-endian unsigned 32-bit integers.

    Equal to what the tokenizers library gives for the file at path without special tokens added. A null or empty text gives
    no ids. The path must hold the file on every machine. Other columns stay, but one named ids is replaced. With a name for
    decoded the ids are decoded again in the same pass, so that a task needs one Python worker and not two.
    """
    spare = "_ids_of_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            raw, offsets = strings(batch.column(batch.num_columns - 1))
            for lo, hi in cuts(offsets, PIECE):
                rows = own.encode_rows(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                columns = [*batch.slice(lo, hi - lo).columns[:-1], _blobs([x.tobytes() for x in rows], pa.binary())]
                if decoded:
                    columns.append(_blobs([own.text(x).encode() for x in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])

    added = [ids, decoded] if decoded else [ids]
    columns = named(docs, *added)
    kept = docs.select(*columns).columns
    schema = docs.select(*columns, F.lit(b"").alias(ids), *([F.lit("").alias(decoded)] if decoded else [])).schema
    return in_arrow(docs.select(*columns, F.col(text).cast("string").alias(spare)), run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with a string column of the decoded ids, special tokens kept; no or null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            size = max(1, 4_000_000 // max(1, batch.nbytes // max(1, len(batch))))
            for lo in range(0, len(batch), size):
                part = column.slice(lo, size)
                texts = [own.text(np.frombuffer(x, np.uint32)).encode() if x else b"" for x in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, size).columns[:-1], _blobs(texts, pa.string())], names=[*kept, text])

    columns = named(encoded, text)
    kept = encoded.select(*columns).columns
    schema = encoded.select(*columns, F.lit("").alias(text)).schema
    return in_arrow(encoded.select(*columns, F.col(ids).alias("_ids_to_decode")), run, schema)


def n_tokens(ids: str = "ids"):
    """Number of ids in a packed column; 0 for null."""
    return (F.coalesce(F.octet_length(F.col(ids)), F.lit(0)) / 4).cast("long")
