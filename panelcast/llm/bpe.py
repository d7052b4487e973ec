"""Byte-level BPE encoding and decoding; merges come from segment trees over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words whose ids a Python worker keeps at most; they are forgotten together.
KEPT_WORDS = 200_000
#: Tree leaves moved on at once, the longest words whose trees are, and characters split into words at once.
TREE_LEAVES = 1 << 18
LONG_WORD = 64
SPLIT_CHARS = 1 << 20
#: The contractions the pre-tokenizer keeps as words of their own, and Unicode white space.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers of Unicode 16, first and last, which the tokenizer knows and Python 3.13 does not.
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
)
NEWER_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_NONE, _FREE = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, spans in ((_LETTER, NEWER_LETTERS), (_NUMBER, NEWER_NUMBERS)):
        for first, last in spans:
            out[first:last + 1] = kind
    out[list(WHITE_SPACE)] = _SPACE
    return out


@dataclass
class Codec:
    """Vocabulary, merges and special tokens of one tokenizer, and the words met so far."""

    pieces: list[bytes]
    first: np.ndarray  # id of each byte
    pairs: np.ndarray  # pairs of ids by rank, left << 32 | right
    new_id: np.ndarray  # what each becomes
    slots: np.ndarray  # hash table of pairs, _FREE where there is none
    slot_rank: np.ndarray
    special: dict[str, int]
    known: dict[str, str] = field(default_factory=dict)
    ranks: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    classes: np.ndarray | None = None

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, in lists for about ``SPLIT_CHARS`` characters; special tokens are words of their own."""
        parts = [text]
        if any(s in text for s in self.special):
            longest = sorted(self.special, key=len, reverse=True)
            parts = regex.split("(" + "|".join(map(regex.escape, longest)) + ")", text)
        for part in parts:
            if part in self.special:
                yield [part]
                continue
            start, reach = 0, SPLIT_CHARS
            while start < len(part):
                some = part[start:start + reach]
                cuts = self._cuts(some)
                if start + reach < len(part):
                    # The last words may go on behind the end.  A blank behind a character that isn't white space begins a word
                    # whatever follows.
                    safe = [c for c in cuts[-64:-1].tolist() if c and some[c] == " " and not some[c - 1].isspace()]
                    if not safe:
                        reach *= 2
                        continue
                    cuts = cuts[:np.searchsorted(cuts, safe[-1]) + 1]
                bounds = cuts.tolist()
                yield [some[a:b] for a, b in zip(bounds, bounds[1:])]
                start, reach = start + bounds[-1], SPLIT_CHARS

    def _cuts(self, text: str) -> np.ndarray:
        """Positions at which words begin, and the end."""
        if self.classes is None:
            self.classes = _classes()
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.classes[code]
        size = len(code)
        begins = np.empty(size + 1, bool)
        begins[0] = begins[size] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:size])
        after = np.nonzero(begins[1:size] & (kind[:-1] == _SPACE))[0] + 1  # a run of white space ends before these
        begins[after - 1] = True
        begins[after[code[after - 1] == 32]] = False
        for at in np.nonzero((code == 39) & begins[:size])[0].tolist() if 39 in code else ():
            # An apostrophe that begins a word, not one behind a blank.
            for short in CONTRACTIONS:
                if text.startswith(short, at):
                    begins[at + 1:at + len(short)] = False
                    begins[at + len(short)] = True
                    break
        return np.nonzero(begins)[0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where they don't merge; an id below 0 merges with nothing."""
        code = left << 32 | right
        slot = _slot(code, len(self.slots))
        found = self.slots[slot]
        rank = np.where(found == code, self.slot_rank[slot], -1)
        left_over = np.nonzero((found != code) & (found >= 0))[0]
        while len(left_over):  # another pair sits there: look further on
            slot[left_over] = (slot[left_over] + 1) % len(self.slots)
            found = self.slots[slot[left_over]]
            hit = found == code[left_over]
            rank[left_over[hit]] = self.slot_rank[slot[left_over[hit]]]
            left_over = left_over[~hit & (found >= 0)]
        return rank

    def _merge(self, words: list[bytes], leaves: int) -> list[np.ndarray]:
        """Ids of words of up to ``leaves`` bytes, one segment tree each, all trees moved on together.

        A leaf holds the rank of the pair that begins at its position, then the position, so the root of a tree is
        its leftmost pair of lowest rank.  A merge changes three leaves, each with its path to the root.
        """
        count, wide = len(words), leaves + 2
        lengths = np.fromiter(map(len, words), np.int64, count)
        # Positions 1..length; 0 and length + 1 hold -1, which merges with nothing.
        square = np.full((count, wide), -1, np.int64)
        inside = np.arange(leaves) < lengths[:, None]
        square[:, 1:-1][inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ids = square.ravel()
        following = np.tile(np.arange(1, wide + 1), count)
        before = np.tile(np.arange(-1, wide - 1), count)
        tall = np.full((count, 2 * leaves), _NONE, np.int64)
        tree = tall.ravel()
        rank = self._rank(square[:, 1:-1].ravel(), square[:, 2:].ravel())
        tall[:, leaves:] = np.where(rank >= 0, rank * leaves + np.tile(np.arange(leaves), count), _NONE).reshape(count, leaves)
        level = leaves
        while level > 1:
            np.minimum(tall[:, level:2 * level:2], tall[:, level + 1:2 * level:2], out=tall[:, level // 2:level])
            level //= 2

        def put(base: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
            node = leaf + leaves
            tree[base + node] = value
            span = leaves
            while span > 1:
                both = base + (node & -2)
                node = node >> 1
                tree[base + node] = np.minimum(tree[both], tree[both + 1])
                span >>= 1

        rows = np.nonzero(tall[:, 1] != _NONE)[0]
        while len(rows):
            base, line = rows * (2 * leaves), rows * wide
            root = tree[base + 1]
            leaf = root % leaves
            here = line + leaf + 1
            then = following[here]
            beyond = following[line + then]
            ahead = before[here]
            ids[here] = self.new_id[root // leaves]
            ids[line + then] = -1
            following[here] = beyond
            before[line + np.minimum(beyond, wide - 1)] = leaf + 1
            put(base, then - 1, _NONE)
            rank = self._rank(ids[here], ids[line + beyond])
            put(base, leaf, np.where(rank >= 0, rank * leaves + leaf, _NONE))
            back = ahead > 0
            base, line, ahead, here = base[back], line[back], ahead[back], here[back]
            rank = self._rank(ids[line + ahead], ids[here])
            put(base, ahead - 1, np.where(rank >= 0, rank * leaves + ahead - 1, _NONE))
            rows = rows[tall[rows, 1] != _NONE]
        kept = ids >= 0
        return np.split(ids[kept], np.cumsum(kept.reshape(count, wide).sum(axis=1))[:-1])

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with one tree, for a word that would be alone in its shape."""
        rank_of = self._ranks()
        ids, size = [int(self.first[b]) for b in word], len(word)
        leaves = 1 << (size - 1).bit_length()
        following, before = list(range(1, size + 1)), list(range(-1, size - 1))
        none = (len(rank_of), leaves)
        tree = [none] * (2 * leaves)

        def key(at: int) -> tuple[int, int]:
            then = following[at]
            found = rank_of.get((ids[at], ids[then])) if then < size else None
            return none if found is None else (found[0], at)

        def climb(at: int, value: tuple[int, int]) -> None:
            node = leaves + at
            tree[node] = value
            while node > 1:
                node //= 2
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        tree[leaves:leaves + size] = [key(at) for at in range(size)]
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != none:
            at = tree[1][1]
            then = following[at]
            ids[at], ids[then] = rank_of[ids[at], ids[then]][1], -1
            following[at] = following[then]
            if following[at] < size:
                before[following[at]] = at
            climb(then, none)
            climb(at, key(at))
            if before[at] >= 0:
                climb(before[at], key(before[at]))
        return [i for i in ids if i >= 0]

    def _ranks(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not self.ranks:
            self.ranks = {(p >> 32, p & 0xFFFFFFFF): (rank, new)
                          for rank, (p, new) in enumerate(zip(self.pairs.tolist(), self.new_id.tolist()))}
        return self.ranks

    def learn(self, words: set[str]) -> None:
        """Ids of new words, kept as text; words of like length share their trees' shape."""
        shapes: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            shapes.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((word, data))
        for leaves, mine in shapes.items():
            if leaves > LONG_WORD:
                self.known.update((word, ",".join(map(str, self._merge_long(data)))) for word, data in mine)
                continue
            step = TREE_LEAVES // leaves
            for k in range(0, len(mine), step):
                part = mine[k:k + step]
                self.known.update((word, ",".join(map(str, ids.tolist())))
                                  for (word, _), ids in zip(part, self._merge([data for _, data in part], leaves)))

    def encode_texts(self, texts: Iterator[str]) -> Iterator[str]:
        """The ids of each text, comma-joined; new words of many texts are learnt together."""
        waiting: list[list[str]] = []  # word lists of whole texts and of the one that goes on
        lengths: list[int] = []  # of whole texts: how many lists
        done, chars, begun = [], 0, 0

        def flush() -> list[str]:
            new = set().union(*waiting).difference(self.known)
            if len(self.known) + len(new) > KEPT_WORDS:
                self.known = {s: str(i) for s, i in self.special.items()}
                new = set().union(*waiting).difference(self.known)
            self.learn(new)
            return [",".join(map(self.known.__getitem__, words)) for words in waiting]

        for text in texts:
            for words in self.words(text):
                waiting.append(words)
                begun += 1
                chars += sum(map(len, words))
                if chars >= SPLIT_CHARS:
                    done += flush()
                    waiting, chars = [], 0
            lengths.append(begun)
            begun = 0
            if not waiting:
                yield from _joined(done, lengths)
                done, lengths = [], []
        done += flush()
        yield from _joined(done, lengths)

    def decode_ids(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
        size = len(self.pieces)
        return b"".join([self.pieces[i] for i in ids if 0 <= i < size]).decode("utf-8", "replace")


def _slot(code: np.ndarray, size: int) -> np.ndarray:
    """Where a pair is looked for first in a hash table of ``size``, a power of two."""
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _joined(lists: list[str], lengths: list[int]) -> Iterator[str]:
    at = 0
    for n in lengths:
        yield ",".join(lists[at:at + n])
        at += n


def load_codec(path: str) -> Codec:
    """The codec of a byte-level BPE file in the ``tokenizers`` format."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, letters = data["model"], _byte_letters()
    if model["type"] != "BPE" or data["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        raise ValueError("not a byte-level BPE file whose words this codec knows")
    byte_of, vocab = {c: b for b, c in enumerate(letters)}, model["vocab"]
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    pieces = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for piece, i in vocab.items():
        pieces[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    for piece, i in special.items():
        pieces[i] = piece.encode()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
    new_id = np.array([vocab[a + b] for a, b in merges], np.int64)
    slots = np.full(1 << max(4, (8 * len(pairs)).bit_length()), _FREE, np.int64)
    slot_rank = np.zeros(len(slots), np.int64)
    for rank, (code, slot) in enumerate(zip(pairs.tolist(), _slot(pairs, len(slots)).tolist())):
        while slots[slot] >= 0 and slots[slot] != code:
            slot = (slot + 1) % len(slots)
        if slots[slot] < 0:
            slots[slot], slot_rank[slot] = code, rank
    return Codec(pieces, np.array([vocab[c] for c in letters], np.int64), pairs, new_id, slots, slot_rank, special,
                 {s: str(i) for s, i in special.items()})


def share_codec(spark: SparkSession, path: str) -> Broadcast:
    """The codec as a broadcast; its size is that of the vocabulary file, which must stay under 64 MB."""
    codec = load_codec(path)
    if sum(map(len, codec.pieces)) + codec.pairs.nbytes + codec.slots.nbytes > 64 << 20:
        raise ValueError("vocabulary too large to broadcast")
    return spark.sparkContext.broadcast(codec)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, n_tokens, ids) per row, whole texts; a null text is empty and has no ids.

    Special tokens of the file are found in texts and get their ids; nothing is added, truncated or padded.  Repeated rows
    and null ids stay, an empty table gives none.
    """
    shared = share_codec(docs.sparkSession, path)
    rows = docs.select(id_col, *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col))
    names = [id_col, *keep, "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            found_all = codec.encode_texts(t.as_py() for t in batch.column(len(names) - 2))
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                found = list(islice(found_all, 256))
                ids = [np.fromstring(f, np.int32, sep=",") if f else np.empty(0, np.int32) for f in found]
                sizes = np.array([len(i) for i in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)),
                                                 pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes), lists], names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, n_tokens long, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) per row of ids; null ids give a null text, a null or unknown id within gives nothing."""
    shared = share_codec(rows.sparkSession, path)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            texts = [None if ids is None else codec.decode_ids([i for i in ids if i is not None]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: encodes, decodes the ids, and keeps only digests of both."""
    shared = share_codec(docs.sparkSession, path)
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            counts, marks, backs = [], [], []
            for joined in codec.encode_texts(t.as_py() for t in batch.column(1)):
                ids = np.fromstring(joined, np.int32, sep=",").tolist() if joined else []
                counts.append(len(ids))
                marks.append(hashlib.sha256(joined.encode()).hexdigest())
                backs.append(hashlib.sha256(codec.decode_ids(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(marks), pa.array(backs)],
                                             [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
