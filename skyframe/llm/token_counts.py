"""Token counts that follow edits without counting whole texts again.

Every document keeps a segment tree over its pre-token segments: a leaf is a stretch of about
``LEAF`` code points that ends where no token can cross, with its length and its number of tokens.
That is after white space or, where there is none for long, between letters, digits and other
signs of ASCII, which the tokenizer parts. (Text with neither, such as a long run of letters or
CJK signs without punctuation, is one token segment and one leaf.) An inner node holds the sums of its subtree, the root those of the
document. The trees are written once (``build_trees``): what is stored are the leaves, the sums
above them are put back when a tree is loaded.

An edit (``doc_id, seq, start, length, replacement``; code points of the text as the edits
before it left it) descends the tree to the leaves it touches. Their new text, with the leaves
beside it as boundary context if the edit took away the border between them, is encoded
again and put into the first of them (a leaf that has grown is split, and only that leaf); the sums on the paths to the root are updated, nothing
else is read or counted. Edits of one document depend on each other and are applied in order
in one task; documents are independent of each other. Edits that come next in their documents
are encoded together.

Tokens are counted without an end token. The tokenizer must drop white space (see ``packing``
for ``by_unit``).

Defined cases: a null or empty text has no tokens and can be edited like an empty one; an edit
reaches from its start, clipped to the text, over ``length`` code points or to the end; nulls
in an edit mean start 0, length 0 and an empty replacement; edits of a null or unknown id
change nothing; rows that repeat a document are edited alike; equal ``seq`` are ordered by
start, length and replacement; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .packing import UnitEncoder, _encoders, _slices

LEAF = 256
GROWN = 8 * LEAF  # a leaf that edits have made larger is split into leaves again
BLANK, SOLID = re.compile(r"[ \t\n\r]"), re.compile(r"[^ \t\n\r]")
_SIGN = r"[^A-Za-z0-9' \t\n\r\x0b\x0c\x1c-\x1f\x80-\U0010ffff]"
UNIT = re.compile(rf"(?<=[A-Za-z])(?=[0-9']|{_SIGN})|(?<=[0-9])(?=[A-Za-z0-9']|{_SIGN})|(?<={_SIGN})(?=[A-Za-z0-9])")
SPECIAL = "<|"  # may open a special token, which holds such borders


def leaves(text: str) -> list[str]:
    """``text`` cut after white space, every LEAF code points or as soon as possible then; at a unit
    border where white space is farther than as many again."""
    out, begin = [], 0
    by_unit = SPECIAL not in text
    while begin < len(text):
        blank = BLANK.search(text, begin + LEAF)
        solid = blank and SOLID.search(text, blank.end())
        end = solid.start() if solid else len(text)
        if by_unit and end > begin + 2 * LEAF:
            unit = UNIT.search(text, begin + LEAF, end)
            end = unit.start() if unit else end
        out.append(text[begin:end])
        begin = end
    return out


def parted(before: str, behind: str) -> bool:
    """Whether no token crosses from one text into the next."""
    return bool(BLANK.match(before[-1])) or (SPECIAL not in before and bool(UNIT.match(before[-1] + behind[0], 1)))


def heap(values: list[int]) -> list[int]:
    """Sums of all subtrees: node 1 is the root, node i has the children 2i and 2i + 1."""
    size = 1 << max(0, len(values) - 1).bit_length()
    tree = [0] * size + values + [0] * (size - len(values))
    for i in range(size - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


class SegmentTree:
    """Of leaves given by their code points and tokens."""

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = heap(chars), heap(tokens)
        self.size = len(self.chars) // 2
        self.texts, at = [], 0
        for n in self.chars[self.size:]:
            self.texts.append(text[at:at + n])
            at += n
        self.counted = 0  # code points encoded again

    def leaves(self) -> tuple[list[int], list[int]]:
        """Code points and tokens of the leaves that have any text."""
        some = [i for i in range(self.size, 2 * self.size) if self.chars[i]]
        return [self.chars[i] for i in some], [self.tokens[i] for i in some]

    def locate(self, place: int) -> tuple[int, int]:
        """Leaf that holds code point ``place`` (or the last that has any), and the place in it."""
        node = 1
        while node < self.size:
            left = self.chars[2 * node]
            if place < left or not self.chars[2 * node + 1]:
                node = 2 * node
            else:
                place -= left
                node = 2 * node + 1
        return node - self.size, place

    def split(self, leaf: int, texts: list[str], tokens: list[int]) -> None:
        """Several leaves in the place of one; the others keep their counts."""
        some = [i for i, t in enumerate(self.texts) if t]
        at = some.index(leaf)
        kept = [self.tokens[i + self.size] for i in some]
        counted, own = self.counted + sum(map(len, texts)), [self.texts[i] for i in some]
        own[at:at + 1], kept[at:at + 1] = texts, tokens
        self.__init__("".join(own), [len(t) for t in own], kept)
        self.counted = counted

    def put(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        node, chars, more = leaf + self.size, len(text) - self.chars[leaf + self.size], tokens - self.tokens[leaf + self.size]
        while node:
            self.chars[node] += chars
            self.tokens[node] += more
            node //= 2

    def touched(self, start: int, length: int, replacement: str) -> tuple[list[int], str]:
        """Leaves that an edit changes, and the text that takes their place."""
        total = self.chars[1]
        start = min(max(start, 0), total)
        end = min(start + max(length, 0), total)
        first, offset = self.locate(start)
        last, _ = self.locate(max(start, end - 1))
        left, right = first, last + 1
        old = "".join(self.texts[left:right])
        new = old[:offset] + replacement + old[offset + end - start:]
        while True:  # boundary context: what a token may share with the new text belongs to it
            before = next((i for i in range(left - 1, -1, -1) if self.texts[i]), None)
            behind = next((i for i in range(right, self.size) if self.texts[i]), None)
            if before is not None and not parted(self.texts[before], new or (self.texts[behind] if behind is not None else " ")):
                left, new = before, self.texts[before] + new
            elif new and behind is not None and not parted(new, self.texts[behind]):
                right, new = behind + 1, new + self.texts[behind]
            else:
                return list(range(left, right)), new


def count_many(encoder: UnitEncoder, texts: list[str], by_unit: bool) -> list[int]:
    return [len(ids) for ids in encoder.encode([t.encode("utf-8", "replace") for t in texts], by_unit)]


def _encoder(tokenizer: str) -> UnitEncoder:
    return _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, UnitEncoder(tokenizer))


def build_trees(docs: DataFrame, tokenizer: str, by_unit: bool = True) -> DataFrame:
    """Written table (doc_id, text_hash, n_tokens, chars, tokens), a row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for part in _slices(texts):
                cut = [leaves(t.decode("utf-8", "replace")) if t else [] for t in texts[part]]
                found = iter(count_many(encoder, [x for one in cut for x in one], by_unit))
                chars = [[len(x) for x in one] for one in cut]
                tokens = [[next(found) for _ in one] for one in cut]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(cut)), batch.column(1).slice(part.start, len(cut)),
                     pa.array([sum(t) for t in tokens], pa.int64()),
                     pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))],
                    names=["doc_id", "text_hash", "n_tokens", "chars", "tokens"])

    return materialise(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "doc_id long, text_hash long, n_tokens long, chars array<int>, tokens array<int>"), "token-trees",
        compression="zstd")


class EditedDocument:
    """A document's tree and the edits still to come."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], edits: list[dict]):
        self.tree, self.edits, self.done = SegmentTree(text, chars, tokens), edits, 0

    def region(self) -> str:
        """Text to be encoded for the next edit."""
        e = self.edits[self.done]
        self.inside, self.new = self.tree.touched(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
        return self.new

    def settle(self, tokens: int) -> None:
        for leaf in self.inside[1:]:
            self.tree.put(leaf, "", 0)
        self.tree.put(self.inside[0], self.new, tokens)
        self.tree.counted += len(self.new)
        self.done += 1


def edit_all(documents: list[EditedDocument], encoder: UnitEncoder, by_unit: bool) -> None:
    """Apply all edits, the next one of every document at once."""
    while todo := [d for d in documents if d.done < len(d.edits)]:
        for d, n in zip(todo, count_many(encoder, [d.region() for d in todo], by_unit)):
            d.settle(n)
        for d in todo:
            if d.done < len(d.edits) and len(d.new) > GROWN:
                pieces = leaves(d.new)
                if len(pieces) > 1:
                    d.tree.split(d.inside[0], pieces, count_many(encoder, pieces, by_unit))


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, tokenizer: str, by_unit: bool = True) -> DataFrame:
    """Per row of ``trees``: doc_id, text_hash, n_tokens, n_edits, n_tokens_edited, n_chars_edited,
    chars_reencoded and the updated tree (chars, tokens)."""
    # a replacement that is no UTF-8 is decoded as texts are
    order = F.struct("seq", "start", "length", F.make_valid_utf8("replacement").alias("replacement"))
    logs = (edits.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.sort_array(F.collect_list(order)).alias("edits")))  # one document's history
    # rows that repeat a document are dropped where the join by id has brought them together
    wanted = (trees.select("doc_id", "text_hash", "chars", "tokens").join(logs, "doc_id")
              .dropDuplicates(["doc_id", "text_hash"]))
    texts = (docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
             .join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for part in _slices(texts):
                rows = batch.slice(part.start, part.stop - part.start)
                edited = [EditedDocument((t or b"").decode("utf-8", "replace"), c, k, e) for t, c, k, e in zip(
                    texts[part], *[rows.column(i).to_pylist() for i in (3, 4, 5)])]
                edit_all(edited, encoder, by_unit)
                trees = [d.tree for d in edited]
                new = [t.leaves() for t in trees]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array([len(d.edits) for d in edited], pa.int64()),
                     pa.array([t.tokens[1] for t in trees], pa.int64()), pa.array([t.chars[1] for t in trees], pa.int64()),
                     pa.array([t.counted for t in trees], pa.int64()),
                     pa.array([c for c, _ in new], pa.list_(pa.int32())),
                     pa.array([k for _, k in new], pa.list_(pa.int32()))],
                    names=["doc_id", "text_hash", "n_edits", "n_tokens_edited", "n_chars_edited", "chars_reencoded",
                           "new_chars", "new_tokens"])

    changed = materialise(texts.select("doc_id", "text_hash", "text", "chars", "tokens", "edits").mapInArrow(
        run, "doc_id long, text_hash long, n_edits long, n_tokens_edited long, n_chars_edited long, "
             "chars_reencoded long, new_chars array<int>, new_tokens array<int>"), "token-edits", compression="zstd")
    zero = F.lit(0).cast("long")
    root = F.aggregate("chars", zero, lambda a, x: a + x)
    return (trees.join(changed, ["doc_id", "text_hash"], "left")
            .select("doc_id", "text_hash", "n_tokens", F.coalesce("n_edits", zero).alias("n_edits"),
                    F.coalesce("n_tokens_edited", "n_tokens").alias("n_tokens_edited"),
                    F.coalesce("n_chars_edited", root).alias("n_chars_edited"),
                    F.coalesce("chars_reencoded", zero).alias("chars_reencoded"),
                    F.coalesce("new_chars", "chars").alias("chars"), F.coalesce("new_tokens", "tokens").alias("tokens")))
