"""Edit-aware token counts: a segment tree over each document's text, of which edits re-encode only what they touch.

Leaves are runs of pre-tokens between places where a pre-token surely starts whatever stands around (ASCII white space after
ASCII that is none, and punctuation or symbols outside ASCII after a letter). A leaf knows its characters and tokens, an inner
node the sums below it. An edit descends to the leaves it touches; where it changes the characters at a leaf's border the
neighbour is taken in as context; the joined text alone is encoded again, and the sums on the way up are updated. Counts equal
those of the whole edited text. The leaves' characters and tokens are kept as columns, from which later edits go on without
encoding the text again.
"""

from __future__ import annotations

from collections.abc import Iterator

from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficjobs.llm.bpe import Codec, codec, safe_start
from trafficjobs.llm.common import cuts, fresh, in_arrow, named

#: Characters of a leaf at least, and at most before it is split again if it can be.
LEAF, LARGE = 400, 4000
EDITS = "array<struct<start:bigint,length:bigint,text:string>>"


def sure_start(before: str, after: str) -> bool:
    """Whether a pre-token surely starts between the two characters; special tokens are taken to be ASCII without white space."""
    return safe_start(before, after) or (after >= "\x80" and category(after)[0] in "PS" and category(before)[0] == "L")


def split_leaves(text: str, size: int = LEAF) -> list[str]:
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not sure_start(text[cut - 1], text[cut]):
            cut += 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) or not out else out


class Tree:
    """Segment tree of (characters, tokens) over leaves of text, in an array: node i has the children 2i and 2i + 1."""

    def __init__(self, own: Codec, leaves: list[str], tokens: list[int] | None = None):
        self.own, self.encoded = own, 0
        self.build(leaves, self.count(leaves) if tokens is None else tokens)

    def count(self, texts: list[str]) -> list[int]:
        self.encoded += sum(map(len, texts))
        return [len(self.own.encode(t)) for t in texts]

    def build(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves, self.width = leaves, 1
        while self.width < len(leaves):
            self.width *= 2
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (text, n) in enumerate(zip(leaves, tokens)):
            self.chars[self.width + i], self.tokens[self.width + i] = len(text), n
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at that place, or the last one, and the place in it."""
        node = 1
        while node < self.width:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= self.chars[node]
                node += 1
        return node - self.width, at

    def put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self.width + leaf
        self.chars[node], self.tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    def beside(self, leaf: int, step: int) -> int | None:
        """The next leaf with text on that side."""
        leaf += step
        while 0 <= leaf < len(self.leaves):
            if self.leaves[leaf]:
                return leaf
            leaf += step
        return None

    def edit(self, start: int, length: int, new: str) -> None:
        size = self.chars[1]
        start = min(max(start, 0), size)
        stop = min(start + max(length, 0), size)
        first, at = self.find(start)
        last, to = self.find(stop - 1) if stop > start else (first, at - 1)
        if last == first:
            text = self.leaves[first][:at] + new + self.leaves[first][to + 1 :]
        else:
            text = self.leaves[first][:at] + new + self.leaves[last][to + 1 :]
        while True:  # context: as long as a border is no sure start of a pre-token
            left, right = self.beside(first, -1), self.beside(last, 1)
            if left is not None and (not text or not sure_start(self.leaves[left][-1], text[0])):
                first, text = left, self.leaves[left] + text
            elif right is not None and (not text or not sure_start(text[-1], self.leaves[right][0])):
                last, text = right, text + self.leaves[right]
            else:
                break
        parts = split_leaves(text) if len(text) > LARGE else [text]
        counts = self.count(parts)
        if len(parts) > last - first + 1:
            tokens = self.tokens[self.width : self.width + len(self.leaves)]
            self.build(self.leaves[:first] + parts + self.leaves[last + 1 :], tokens[:first] + counts + tokens[last + 1 :])
        else:
            for k in range(first, last + 1):
                i = k - first
                self.put(k, *((parts[i], counts[i]) if i < len(parts) else ("", 0)))

    def text(self) -> str:
        return "".join(self.leaves)

    def kept(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that hold text."""
        at = [self.width + i for i, text in enumerate(self.leaves) if text]
        return [self.chars[i] for i in at], [self.tokens[i] for i in at]


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with a column edits from a log (doc_id, seq, start, length, text), in the order of seq; none for documents without any.

    Ties of seq go by start, length and text. Edits of a null doc_id apply to nothing; rows that repeat a doc_id get the same ones.
    """
    (log_,) = fresh(docs, "_log")
    log = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "length", "text"))).alias(log_))
    kept = named(docs, "edits")
    return docs.select(*kept).join(log, "doc_id", "left").select(*kept, F.transform(log_, lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["text"].alias("text"))).cast(EDITS).alias("edits"))


TREE = ("leaf_chars", "leaf_tokens")


def _pieces(text: str, sizes: list[int]) -> list[str]:
    ends = np.cumsum(sizes).tolist()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def count_tokens(docs: DataFrame, path: str, edits: str = "edits", keep: bool = False) -> DataFrame:
    """docs with n_before, n_after, n_chars_after and n_reencoded: tokens before and after the edits of each document, its characters
    after them, and how many characters the edits made encode again; columns of these names are replaced.

    edits is an array of (start, length, text) in code points of the text as the edits before left it; what reaches beyond
    the text is cut, a null start or length is 0, a null text empty. A null text is empty; null or no edits change nothing.
    With keep the edited text takes the place of text, and leaf_chars and leaf_tokens hold the tree. Where docs has such
    columns, and they fit the text, the tree comes from them and only what edits touch is encoded.
    """
    added = ["n_before", "n_after", "n_chars_after", "n_reencoded"]
    columns, has_tree = named(docs, *added, *TREE, edits, *(["text"] if keep else [])), set(TREE) <= set(docs.columns)
    kept = docs.select(*columns).columns
    tree_columns = [F.lit("").alias("text"), *(F.array().cast("array<int>").alias(c) for c in TREE)] if keep else []
    schema = docs.select(*columns, *(F.lit(0).cast("long").alias(a) for a in added), *tree_columns).schema
    names = [*kept, *added, *(["text", *TREE] if keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            chars, tokens, texts, logs = batch.columns[-4:]
            texts = texts.fill_null("")
            ends = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))))
            for lo, hi in cuts(ends):
                rows = []
                for text, sizes, counts, log in zip(*(c[lo:hi].to_pylist() for c in (texts, chars, tokens, logs))):
                    if sizes and counts and len(sizes) == len(counts) and sum(sizes) == len(text):
                        tree = Tree(own, _pieces(text, sizes), counts)
                    else:
                        tree = Tree(own, split_leaves(text))
                        tree.encoded = 0
                    before = tree.tokens[1]
                    for e in log or ():
                        if e is not None:
                            tree.edit(e["start"] or 0, e["length"] or 0, e["text"] or "")
                    rows.append((before, tree.tokens[1], tree.chars[1], tree.encoded, *((tree.text(), *tree.kept()) if keep else ())))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())] * keep
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-4], *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds))], names=names)

    tree = [F.col(c).cast("array<int>") if has_tree else F.lit(None).cast("array<int>") for c in TREE]
    inner = fresh(docs, "_leaf_chars", "_leaf_tokens", "_text_to_count", "_edits_to_apply")
    given = [*tree, F.col("text").cast("string"), F.col(edits).cast(EDITS) if edits in docs.columns else F.lit(None).cast(EDITS)]
    return in_arrow(docs.select(*columns, *(c.alias(n) for c, n in zip(given, inner))), run, schema)


def derived_edits(doc_id: str = "doc_id", text: str = "text", n: int = 3, first: int = 0) -> Column:
    """An edit log for a document from its own hash: in turn a deletion, an insertion of an earlier passage, a replacement by a mark.

    Edits are numbered from first, so that a later log of the same document edits other places.
    """
    size = F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("long")
    at = lambda k, m: F.pmod(F.xxhash64(F.col(doc_id), F.lit(k)), F.greatest(m, F.lit(1).cast("long")))
    passage = lambda k: F.coalesce(F.substr(F.col(text), (at(k + 100, size) + 1).cast("int"), F.lit(30)), F.lit(""))

    def one(k: int) -> Column:
        length = at(k + 50, F.lit(40).cast("long"))
        new = [F.lit(""), passage(k), F.lit("[REMOVED]")][k % 3]
        return F.struct(at(k, size + 1).alias("start"), (F.lit(0).cast("long") if k % 3 == 1 else length).alias("length"), new.alias("text"))

    return F.array(*(one(k) for k in range(first, first + n)))
