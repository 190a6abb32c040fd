"""Best-fit packing by minimum bin slack.

Sequences of `capacity` tokens are filled one after another: the longest piece left goes in, and
a subset-sum dynamic program over a bitset of the lengths still available finds the combination
that fills the rest best; it is taken out and the next sequence begins. Pieces of one length are
alike, so the plan works on the histogram of lengths (at most `capacity` counts, whatever the
input): a combination is repeated as often as the counts allow. The plan's segments are broadcast
(their number depends on the lengths, not on the pieces) and every piece finds its place from its
rank in the order of lengths, without a group being gathered anywhere.

`pieces` makes the input: a document's ids as the tokenizer's library gives them (special tokens that
a text spells out are special tokens), a closing separator id, and cuts every `capacity` tokens. Null
and empty texts are the separator alone. Repeated rows are packed each by itself, ties between equal
lengths go by the given order; an empty table gives no rows. `pieces` ignores other columns, `pack`
hands them on, whatever their names. Very long texts are encoded a part at a time.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, quoted, ranked, save
from .common import pieces as parts_of

CAPACITY = 2048


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves,
    the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """The ids of a tokenizer file, a white-space-delimited word at a time.

    The file's own tokenizer defines the result. For vocabularies of words with an end mark it is
    slow on many rare words; the same merges then run as byte ranks, a space standing for the end
    mark, over all unknown words of a batch at once. Words met before come from a memo.
    """

    def __init__(self, path: str, memo: int = 400_000):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.memo, self.most = {}, memo
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].lower() for t in spec.get("added_tokens") or []]
        self.fast = self._ranks(spec)

    def _ranks(self, spec: dict):
        model, steps = spec["model"], [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        if model.get("end_of_word_suffix") != "</w>" or steps != ["NFC", "Replace", "Lowercase"] or not split:
            return None
        import regex
        import tiktoken

        letters, vocab = _byte_letters(), model["vocab"]

        def raw(token: str) -> bytes:
            end = token.endswith("</w>") and len(token) > 4
            return bytes(letters[c] for c in (token[:-4] if end else token)) + (b" " if end else b"")

        order = [f"{c}</w>" for c in letters] + ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ranks = {}
        for i in range(256):
            ranks[bytes([i])] = len(ranks)
        ids = [vocab.get(next(c for c, b in letters.items() if b == i), -1) for i in range(256)]
        for token in order:
            if token in vocab and (b := raw(token)) not in ranks:
                ranks[b] = len(ranks)
                ids.append(vocab[token])
        self.ids, self.ends = np.array(ids, "<i8"), np.array([b[-1:] == b" " for b in ranks])
        self.split = regex.compile(split).findall
        return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def _learn(self, words: list[str]) -> None:
        """Put the words' ids into the memo."""
        lists = [self.split(w) for w in words]
        codes = np.array(self.fast.encode_ordinary("".join(f"{p} " for x in lists for p in x)), np.int64)
        ends = np.flatnonzero(self.ends[codes]) + 1
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in lists])])]
        data = self.ids[codes].astype("<u4").tobytes()
        for w, a, b in zip(words, ends[:-1].tolist(), ends[1:].tolist()):
            self.memo[w] = data[4 * a:4 * b]

    def encode(self, texts: list[str], size: int = 1 << 18) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. White space is dropped, so a long text can be
        encoded in parts that end before blanks."""
        from unicodedata import is_normalized

        def plain(t: str, low: str) -> bool:  # others differ between the two libraries in what is white space or lower case
            return (self.fast is not None and not any(c in t for c in "\x1c\x1d\x1e\x1fΣİ") and is_normalized("NFC", t)
                    and not any(x in low for x in self.special))

        parts = [(i, t) for i, text in enumerate(texts) for t in parts_of(text, size)]
        words = [low.split() if plain(t, low := t.lower()) else None for _, t in parts]
        if len(self.memo) > self.most:
            self.memo.clear()
        new = list(dict.fromkeys(w for x in words if x for w in x if w not in self.memo))
        if new:
            self._learn(new)
        get, out = self.memo.__getitem__, [[] for _ in texts]
        for (i, t), x in zip(parts, words):
            out[i].append(np.array(self.own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if x is None else b"".join(map(get, x)))
        return [b"".join(x) for x in out]


def _pieces(path: str, capacity: int, separator: int):
    def start():
        import pyarrow as pa

        tokenizer, end = WordTokenizer(path), np.array([separator], "<u4").tobytes()

        def cut(texts):
            of, number, ids = [], [], []
            for at in range(0, len(texts), 64):
                for i, found in enumerate(tokenizer.encode([t or "" for t in texts[at:at + 64]]), at):
                    found += end
                    starts = range(0, len(found), 4 * capacity)
                    of += [i] * len(starts)
                    number += range(len(starts))
                    ids += [found[k:k + 4 * capacity] for k in starts]
            number = np.array(number, np.int32)
            return [pa.array(of, pa.int64()), pa.array(number), pa.array(number.astype(np.int64) * capacity),
                    pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        return cut
    return start


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """(id, piece, start, length, ids): each document's ids and a separator, cut every `capacity`."""
    return annotate(docs, [id_col], text_col, _pieces(path, capacity, separator),
                    "piece int, start long, length long, ids binary", many=True)


def fullest(counts: Counter, room: int) -> list[int]:
    """The lengths, at most as often as counted, whose sum comes closest to room without exceeding it."""
    mask, states, items = (1 << room + 1) - 1, [1], []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            items.append((length, k))
            states.append(states[-1] | states[-1] << length * k & mask)
            left, k = left - k, 2 * k
        if states[-1] >> room:
            break
    at, chosen = states[-1].bit_length() - 1, []
    for (length, k), before in zip(reversed(items), reversed(states[:-1])):
        if not before >> at & 1:
            chosen += [length] * k
            at -= length * k
    return chosen


@dataclass
class Plan:
    """Segments of the pieces in the order of lengths: where each begins, its first sequence, how many
    pieces of this length a sequence takes, and the first one's offset there."""
    begin: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Minimum bin slack on the histogram of lengths."""
    counts, first, before = Counter({k: v for k, v in histogram.items() if v}), {}, 0
    for length in sorted(counts):
        first[length], before = before, before + counts[length]
    segments, sequences = [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        combination = Counter([longest, *fullest(counts, capacity - longest)])
        counts[longest] += 1
        times, offset = min(counts[x] // m for x, m in combination.items()), 0
        for length, m in sorted(combination.items(), reverse=True):
            segments.append((first[length], sequences, m, offset))
            first[length] += m * times
            counts[length] -= m * times
            if not counts[length]:
                del counts[length]
            offset += m * length
        sequences += times
    columns = np.array(sorted(segments), np.int64).reshape(-1, 4).T
    return Plan(*columns, sequences)


def _place(shared):
    def place(batches):
        import pyarrow as pa

        p = shared.value
        for b in batches:
            rank, length = b.column("rank").to_numpy(), b.column("length").to_numpy()
            s = np.searchsorted(p.begin, rank, "right") - 1
            k = rank - p.begin[s]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(p.sequence[s] + k // p.each[s]), pa.array(p.offset[s] + k % p.each[s] * length)],
                                             names=["row", "sequence", "place"])
    return place


def pack(pieces: DataFrame, *order: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset (replacing columns of those names). `length` is from 1 to
    capacity; `order` breaks ties between equal lengths, so that the same pieces always land in the same place."""
    rows = save(pieces, "pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most capacity rows
    if histogram and (None in histogram or not 1 <= min(histogram) <= max(histogram) <= capacity):
        raise ValueError(f"lengths from 1 to {capacity} are needed")
    shared = rows.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    keys = [f"o{i}" for i in range(len(order))]
    packed = rows.select(F.struct("*").alias("row"), F.col("length").cast("long").alias("length"), *(quoted(c).alias(k) for c, k in zip(order, keys)))
    placed = ranked(packed, "length", *keys).select("row", "length", "rank")
    out = placed.mapInArrow(_place(shared), T.StructType([placed.schema["row"], *T.StructType.fromDDL("sequence long, place long").fields]))
    return out.select(*(F.col("row").getField(c).alias(c) for c in rows.columns if c not in ("sequence_id", "offset")),
                      F.col("sequence").alias("sequence_id"), F.col("place").alias("offset"))
