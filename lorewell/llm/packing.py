"""Token sequences by sum-of-squares online packing.

A document's tokens (an end mark after them) are cut into full windows and a rest. A rest of s tokens goes to
the fill level h, or to a new window, that makes the sum of squared counts of partly filled windows, by
level, smallest; the counts are an array of WINDOW levels, and of levels that are as good the lowest one is taken. Every partition packs its own
documents in order. The rests in windows that stay partly filled there go, with their ids, to groups of about GROUP rests from many
partitions, and are packed again by the same rule, so that the method decides on all but a small part of the rests however small partitions are. What is partly filled
in the end of a group is laid end to end and cut into full windows and then sequences of powers of two, so no sequence has padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.shared import documents_text, lean, materialize, text_buffers

WINDOW = 2048
END = 1
#: Rests of partly filled windows that are packed together again, about.
GROUP = 20_000
#: What column how says of a piece: a full window of its document, placed by the rule in its partition, placed by it in a group, laid end to end.
FULL, PLACED, REGROUPED, CUT = "full", "placed", "regrouped", "cut"
#: Distinct words whose ids a worker remembers; beyond that it keeps, of those met again, half as many at most.
REMEMBERED = 700_000
#: Bytes of text tokenized at a time; a longer text is handled alone.
TOKENIZED_BYTES = 6 << 20
#: Marks that, after a letter, end a piece of a word for the tokenizer whatever they are followed by.
_MARKS = ".,;:!?*#%&$"


#: Fixed value: how a tokenizer must part normalised text for its words to be tokenized one by one: letters, a digit, or anything else but white space, and English endings.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _parts_words(definition: dict) -> bool:
    """Whether a tokenizer, by its definition, gives the ids of a text as those of its words between spaces and line ends, whatever the text: it normalises by NFC, white space and
    lower case alone (no composition starts with a space), parts by _PARTS, of which no match has white space, and knows no added token with white space or a mark in it."""
    normal, parts = (((definition.get(k) or {}).get(v) or []) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    parts = [{k: v for k, v in q.items() if k != "trim_offsets"} for q in parts]
    split = {"type": "Split", "pattern": {"Regex": _PARTS}, "behavior": "Removed", "invert": True}
    return (
        [(n["type"], n.get("pattern"), n.get("content")) for n in normal] == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and parts == [split, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
        and not definition.get("post_processor") and not any(c.isspace() or c in _MARKS for t in definition.get("added_tokens", ()) for c in t["content"])
    )


class WordTokenizer:
    """Ids of texts. With a tokenizer whose definition allows it (_parts_words), every distinct word (between spaces and line ends) goes through it once, without the marks at its end where what
    the tokenizer makes of the character before them parts from marks, and is remembered. With any other, whole texts go through it."""

    def __init__(self, path: str, remembered: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.remembered = REMEMBERED if remembered is None else remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        definition = json.loads(self.tokenizer.to_str())
        self.by_words = _parts_words(definition)
        # Added tokens stand out of any text; if one is letters alone, it might stand in a word.
        self.direct = self.by_words and not any(t["content"].isalpha() for t in definition.get("added_tokens", ()))
        self.parting: dict[str, bool] = {}  # of last characters: whether marks behind are a piece of their own
        self.known: dict[str, int] = {}  # word -> its place in the arrays below
        self.ids, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.ends = np.zeros(1 << 16, dtype=np.int64)
        self.met = np.zeros(1 << 16, dtype=np.int32)  # in how many pieces of text

    def _parts(self, c: str) -> bool:
        """Whether a mark behind this character begins a piece: it does if it does so behind the character alone, as what stands before can at most make it a part of a letter. It doesn't,
        for example, where the lower case ends in a combining mark, which is no letter."""
        if c not in self.parting:
            normal = self.tokenizer.normalizer.normalize_str(f"{c}.")
            self.parting[c] = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)[-1][0] == "."
        return self.parting[c]

    def _put(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Writes ids of some words after those of the known ones; returns their places."""
        k, n = len(self.known) + 1, self.used + len(ids)
        if n > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(n, len(self.ids)), dtype=np.uint32)))
        if k + len(lens) > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros(max(len(lens), len(self.ends)), dtype=np.int64)))
            self.met = np.concatenate((self.met, np.zeros(len(self.ends) - len(self.met), dtype=np.int32)))
        self.ids[self.used : n] = ids
        self.ends[k : k + len(lens)] = self.used + np.cumsum(lens)
        return np.arange(k, k + len(lens))

    def _append(self, words: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        places = self._put(ids, lens)
        self.met[places] = 0
        self.used += len(ids)
        self.known.update(zip(words, places.tolist(), strict=True))

    def _encode(self, words: list[str]) -> None:
        # A word of lower-case ASCII letters alone is a piece as it stands: only the model is needed.
        plain, other = [], []
        for w in words:
            (plain if w.isascii() and w.isalpha() and w.islower() else other).append(w)
        for direct, some in ((part is plain and self.direct, part[i : i + 20_000]) for part in (plain, other) for i in range(0, len(part), 20_000)):
            if direct:
                ids = [[t.id for t in self.model.tokenize(w)] for w in some]
            else:
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            self._append(some, np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(lens.sum())), lens)

    def _ids_of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of remembered words, one after the other, and how many each has."""
        first = self.ends[place - 1]
        n = self.ends[place] - first
        return self.ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def _forget(self) -> None:
        """Keeps the words that were met in most pieces of text."""
        met = self.met[: len(self.known) + 1]
        bar = next(b for b in chain(range(2, 64), [1 << 31]) if int((met >= b).sum()) <= self.remembered // 2)
        keep = met >= bar
        keep[0] = False
        place = np.flatnonzero(keep)  # words stand in the order of their places
        words = list(compress(self.known, keep[1:].tolist()))
        ids, n = self._ids_of(place)
        counts = met[place] // 2 + 1
        self.known, self.used = {}, 0
        self.met[:] = 0
        self._append(words, ids, n)
        self.met[1 : len(words) + 1] = counts

    def _learn(self, words: list[str]) -> np.ndarray:
        """Places of words that aren't known. Words with marks at their end aren't remembered, their parts are: what is put for them lasts until the next piece of text."""
        known = self.known
        stems = [w.rstrip(_MARKS) for w in words]
        stems = [s if s and self._parts(s[-1]) else w for s, w in zip(stems, words, strict=True)]
        cut = [i for i, (s, w) in enumerate(zip(stems, words, strict=True)) if len(s) < len(w)]
        marks = [words[i][len(stems[i]) :] for i in cut]
        self._encode([s for s in dict.fromkeys(chain(stems, marks)) if s not in known])
        place = np.fromiter(map(known.__getitem__, stems), dtype=np.int64, count=len(stems))
        self.met[place] += 1
        if cut:
            both = np.empty(2 * len(cut), dtype=np.int64)
            both[::2], both[1::2] = place[cut], [known[m] for m in marks]
            ids, n = self._ids_of(both)
            place[cut] = self._put(ids, n[::2] + n[1::2])
        return place

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's offsets in them."""
        if self.by_words:
            return self._by_words(texts)
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(lens.sum())), np.concatenate(([0], np.cumsum(lens)))

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.replace_substring(texts.cast(pa.large_string()), "\n", " ")
        # Lower case might make a special token, or a letter that a combining mark behind it is composed with where it wasn't.
        if not pc.any(pc.match_substring_regex(texts, r"<\||[A-Z]\pM")).as_py():
            texts = pc.ascii_lower(texts)
        split = pc.split_pattern(texts, " ")
        counts = np.diff(split.offsets.to_numpy())
        flat = split.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        if len(self.known) > self.remembered:
            self._forget()
        place = np.fromiter(map(self.known.get, words, repeat(0)), dtype=np.int64, count=len(words))
        self.met[place] += 1
        if len(new := np.flatnonzero(place == 0)):
            place[new] = self._learn([words[i] for i in new.tolist()])
        out, n = self._ids_of(place[flat.indices.to_numpy()])
        return out, np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))]


@lru_cache(1)
def _tokenizer(path: str, remembered: int) -> WordTokenizer:
    """One for each worker process: later tasks find the words of earlier ones."""
    return WordTokenizer(path, remembered)


def _gathered(batches: Iterator[pa.RecordBatch], bytes_: int) -> Iterator[tuple[pa.Array, list]]:
    """The texts and ids of several batches, of bytes_ or so."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch["text"].nbytes
        if size >= bytes_:
            yield pa.concat_arrays([b["text"] for b in held]), [x for b in held for x in b["doc_id"].to_pylist()]
            held, size = [], 0
    if held:
        yield pa.concat_arrays([b["text"] for b in held]), [x for b in held for x in b["doc_id"].to_pylist()]


class SumOfSquares:
    """Chooses windows for sizes below WINDOW, one at a time."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)  # of partly filled windows, by level
        self.open: list[list] = [[] for _ in range(window + 1)]

    def place(self, size: int, piece: tuple) -> list | None:
        """The pieces of a window that is now full, or None."""
        count, window = self.count, self.window
        # The change of the sum: 2 * N[h + s] - 2 * N[h] + 2; a full window's count is not squared, nor an empty one's.
        change = 2 * (count[size + 1 : window + 1] - count[1 : window - size + 1]) + 2
        change[-1] = 1 - 2 * count[window - size]
        change[count[1 : window - size + 1] == 0] = np.iinfo(np.int64).max
        h = int(np.argmin(change)) + 1 if len(change) else 0
        if not h or change[h - 1] >= 2 * count[size] + 1:
            h = 0
        pieces = self.open[h].pop() if h else []
        pieces.append(piece)
        if h:
            count[h] -= 1
        if h + size == window:
            return pieces
        count[h + size] += 1
        self.open[h + size].append(pieces)
        return None

    def rest(self) -> Iterator[list]:
        for level in range(self.window - 1, 0, -1):
            yield from self.open[level]


_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "how", "ids")
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, how string, ids array<int>"
#: Sets the numbers of sequences of groups apart from those of partitions.
_OF_GROUPS = 1 << 62


class _Sequences:
    """Rows of pieces, as sequences are closed: numbers go up from a partition's first one."""

    def __init__(self, first: int, with_ids: bool) -> None:
        self.number, self.with_ids, self.rows = first, with_ids, []

    def add(self, piece: tuple, at: int, how: str, ids: bool) -> None:
        doc, start, own, total = piece
        # A rest that is packed again is told its checksum then.
        crc = 0 if how == CUT and ids and not self.with_ids else zlib.crc32(own.astype("<u4", copy=False))
        self.rows.append((doc, start, len(own), crc, total, self.number, at, how, own if ids else None))

    def close(self, pieces: list, how: str) -> None:
        at = 0
        for piece in pieces:
            self.add(piece, at, how, self.with_ids)
            at += len(piece[2])
        self.number += 1

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [()] * 9
        self.rows = []
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
        if any(x is not None for x in cols[8]):
            lens = np.array([len(x) for x in cols[8]])  # all rows have ids, or none has
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32()), pa.array(np.concatenate(cols[8]).view(np.int32)))
        else:
            ids = pa.nulls(len(cols[7]), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*arrays, pa.array(cols[7], pa.string()), ids], list(_NAMES))


def _first_number() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 32


def _laid_out(pieces: Iterator[tuple], window: int, close) -> None:
    """Pieces end to end: full windows, then powers of two."""
    held, size = [], 0
    for doc, start, ids, total in pieces:
        while len(ids):
            part = ids[: window - size]
            held.append((doc, start, part, total))
            size, start, ids = size + len(part), start + len(part), ids[len(part) :]
            if size == window:
                close(held)
                held, size = [], 0
    while held:
        left, cut = 1 << (size.bit_length() - 1), []
        size -= left
        while left:
            doc, start, ids, total = held.pop(0)
            cut.append((doc, start, ids[:left], total))
            if len(ids) > left:
                held.insert(0, (doc, start + left, ids[left:], total))
            left -= len(cut[-1][2])
        close(cut)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, with_ids: bool = True, piece_bytes: int = TOKENIZED_BYTES, remembered: int = REMEMBERED) -> DataFrame:
    """Packs whole documents into sequences of at most window tokens.

    A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, how (FULL, PLACED, REGROUPED or CUT) and ids (null unless with_ids). Each row of
    docs is a document of its own, repeated rows too; a null or blank text is the end mark alone; docs may be empty. sequence_id is the partition's number times
    2**32 plus a counter, beyond _OF_GROUPS for groups, so a partition that is computed again gets the same. A worker holds a batch of texts and its partly
    filled windows, or a group's; piece_bytes (of text tokenized at a time) and remembered (words) trade its memory for time, and change no result. Other columns are not read."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = _tokenizer(tokenizer, remembered), SumOfSquares(window)
        out = _Sequences(_first_number(), with_ids)
        for texts, names in _gathered(batches, piece_bytes):
            for a, last, _, _ in text_buffers(texts, piece_bytes):
                ids, offs = words(texts.slice(a, last - a))
                for i in range(a, last):
                    own = np.append(ids[offs[i - a] : offs[i - a + 1]], np.uint32(end))
                    total, full = len(own), len(own) // window * window
                    for at in range(0, full, window):
                        out.close([(names[i], at, own[at : at + window], total)], FULL)
                    if full < total and (pieces := packer.place(total - full, (names[i], full, own[full:].copy(), total))):
                        out.close(pieces, PLACED)
                if len(out.rows) >= 500:
                    yield out.flush()
                del ids
                if piece_bytes < TOKENIZED_BYTES:  # memory is short
                    pa.default_memory_pool().release_unused()
        if out.rows:
            yield out.flush()
        for piece in (p for pieces in packer.rest() for p in pieces):  # each by a number of its own
            out.add(piece, 0, CUT, True)
            out.number += 1
            if len(out.rows) >= 500:
                yield out.flush()
        if out.rows:
            yield out.flush()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out = SumOfSquares(window), _Sequences(_OF_GROUPS | _first_number(), with_ids)
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("doc_id", "start", "doc_tokens")), batch["ids"], strict=True)
            for doc, start, total, ids in rows:
                own = ids.values.to_numpy().astype(np.uint32)
                if pieces := packer.place(len(own), (doc, start, own, total)):
                    out.close(pieces, REGROUPED)
                if len(out.rows) >= 500:
                    yield out.flush()
        _laid_out((p for pieces in packer.rest() for p in pieces), window, lambda held: out.close(held, CUT))
        for a in range(0, len(rows := out.rows), 500):
            out.rows = rows[a : a + 500]
            yield out.flush()

    packed = materialize(documents_text(docs).mapInArrow(lean(first), _SCHEMA))
    open_ = packed.where(F.col("how") == CUT)
    groups = -(-open_.count() // GROUP)
    if not groups:
        return packed
    # Numbers are dealt by hash, so that a group has rests of all partitions. Long ones come first: short ones fill what is left best.
    dealt = open_.repartition(groups, F.xxhash64("sequence_id")).sortWithinPartitions(F.desc("length"), "sequence_id")
    return packed.where(F.col("how") != CUT).unionByName(dealt.mapInArrow(lean(again), _SCHEMA))


def shares(packed: DataFrame) -> DataFrame:
    """how and share: what part of all tokens each way of packing has."""
    return packed.groupBy("how").agg(F.sum("length").alias("tokens")).select("how", (F.col("tokens") / F.sum("tokens").over(Window.partitionBy())).alias("share"))
