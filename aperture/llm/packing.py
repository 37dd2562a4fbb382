"""Packing by minimum bin slack: bitset subset sums choose what fills each window best."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aperture.llm import common as C

CAPACITY, END_ID, POOL = 2048, 1, 1024
#: Words, and parts of words, that a worker remembers before it begins anew, and bytes of text that it takes at a time.
MEMORY, PARTS_MEMORY, TAKEN = 150_000, 500_000, 1 << 20


def best_fill(counts: dict[int, int], room: int, lengths: list[int] | None = None) -> dict[int, int]:
    """The multiset of the available lengths {length: how many} whose sum is closest to `room` from below.

    Bit s of the integer after stage k says that sum s can be made of the first k bundles; a length's
    copies go in bundles of 1, 2, 4, ..., so that a length costs few stages. Backtracking the stages gives the counts.
    `lengths` are the keys of counts in order, if the caller has them.
    """
    bundles, stages, reach, mask = [], [], 1, (1 << (room + 1)) - 1
    lengths = sorted(counts) if lengths is None else lengths
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[k]
        left, size = min(counts[length], room // length), 1
        while left:
            take = min(size, left)
            stages.append(reach)
            bundles.append((length, take))
            reach |= (reach << (length * take)) & mask
            left, size = left - take, size * 2
        if reach >> room:
            break
    s, chosen = reach.bit_length() - 1, Counter()
    for (length, take), before in zip(reversed(bundles), reversed(stages)):
        if not before >> s & 1:
            chosen[length] += take
            s -= length * take
    return dict(chosen)


class Packer:
    """Puts remainders into windows; at the end, cuts what is left into windows of powers of two."""

    def __init__(self, capacity: int):
        self.capacity, self.by_length, self.size, self.total = capacity, defaultdict(list), 0, 0
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []  # the keys of counts in order

    def add(self, length: int, item) -> None:
        if length not in self.counts:
            insort(self.lengths, length)
        self.counts[length] = self.counts.get(length, 0) + 1
        self.by_length[length].append(item)
        self.size, self.total = self.size + 1, self.total + length

    def take(self, length: int) -> tuple:
        self.size, self.total, self.counts[length] = self.size - 1, self.total - length, self.counts[length] - 1
        item = self.by_length[length].pop()
        if not self.counts[length]:
            del self.counts[length], self.by_length[length], self.lengths[bisect_left(self.lengths, length)]
        return length, item

    def window(self, room: int) -> list[tuple]:
        return [self.take(length) for length, n in best_fill(self.counts, room, self.lengths).items() for _ in range(n)]

    def rest(self) -> Iterator[tuple[list[tuple], int]]:
        """(pieces, spare) until nothing is left; spare is what must be cut off another piece to fill the window."""
        while self.total:
            room = self.capacity
            while room > self.total:
                room //= 2
            got = self.window(room)
            yield got, room - sum(x for x, _ in got)


class Words:
    """The token ids of texts as little-endian bytes, by those of each word seen.

    Words are divided by spaces and line ends only, where the tokenizer always divides too. A word of
    printable characters of ASCII without the apostrophe, and of the letters of Latin-1, divides further into
    letters, single digits and other characters, each of which the tokenizer takes by itself; many
    such parts are encoded as one text.
    """

    PLAIN = re.compile("[!-&(-~\u00c0-\u00ff]*")
    PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|\n|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9\n]+")
    #: The settings under which words and parts are encoded apart; with any others whole texts are encoded.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
    PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    #: Stands between words; no vocabulary has this id.
    MARK = b"\xff\xff\xff\xff"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok, self.seen, self.parts = Tokenizer.from_file(path), {}, {"\n": self.MARK}
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.divides = made.get("normalizer") == self.NORMALIZER and made.get("pre_tokenizer") == self.PRE_TOKENIZER and made.get("model", {}).get("type") == "BPE" and all("<|" in x["content"] for x in made.get("added_tokens", []))

    def learn(self, words: list[str]) -> None:
        is_plain = self.PLAIN.fullmatch
        plain = [w for w in words if is_plain(w)]
        found = self.PARTS.findall("\n".join(plain).lower())
        parts = list(set(found).difference(self.parts))
        for p in range(0, len(parts), 2000):
            some = parts[p : p + 2000]
            e = self.tok.encode(" ".join(some), add_special_tokens=False)
            first = 4 * np.searchsorted(np.array(e.word_ids), np.arange(len(some) + 1))
            data = np.array(e.ids, "<u4").tobytes()
            self.parts |= {x: data[i:j] for x, i, j in zip(some, first.tolist(), first[1:].tolist())}
        data = b"".join(map(self.parts.__getitem__, found))
        marks = 4 * np.flatnonzero(np.frombuffer(data, "<u4") == 0xFFFFFFFF)
        self.seen.update((w, data[i:j]) for w, i, j in zip(plain, np.append(0, marks + 4).tolist(), np.append(marks, len(data)).tolist()))
        if len(plain) < len(words):
            other = [w for w in words if not is_plain(w)]
            for w, e in zip(other, self.tok.encode_batch(other, add_special_tokens=False)):
                self.seen[w] = np.array(e.ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.divides:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        if len(self.seen) > MEMORY:
            self.seen = {}
        if len(self.parts) > PARTS_MEMORY:
            self.parts = {"\n": self.MARK}
        # a text with "<|" may hold the name of a special token, which the tokenizer finds before it divides words
        split = [None if "<|" in x else x.replace("\n", " ").split(" ") for x in texts]
        new: set[str] = set()
        for words in split:
            new.update(words or ())
        self.learn(list(new.difference(self.seen)))
        get = self.seen.__getitem__
        return [b"".join(map(get, words)) if words is not None else np.array(self.tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x, words in zip(texts, split)]


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    """One for each worker process: its words stay for the tasks that it runs next."""
    return Words(path)


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, capacity: int, end_id: int, pool: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, end = _words(path), Packer(capacity), np.array([end_id], "<u4").tobytes()
        seq = (TaskContext.get().partitionId() << 40) - 1
        out: list[tuple] = []

        def put(doc, start: int, ids: bytes, total: int, offset: int) -> None:
            out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, seq, offset))

        def window(got) -> None:
            at = 0
            for length, (doc, start, ids, total) in got:
                put(doc, start, ids, total, at)
                at += length

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            return batch

        for batch in C.batches(rows, "text", TAKEN):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            for doc, ids in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), words.ids(texts)):
                ids += end
                total = len(ids) // 4
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    seq += 1
                    put(doc, start, ids[4 * start : 4 * (start + capacity)], total, 0)
                if total > whole:
                    packer.add(total - whole, (doc, whole, ids[4 * whole :], total))
                while packer.size >= pool and packer.total >= capacity:
                    seq += 1
                    window(packer.window(capacity))
                if len(out) >= 20_000:
                    yield flush()
        for got, spare in packer.rest():
            seq += 1
            if spare:  # every piece left is longer: cut one
                length, (doc, start, ids, total) = packer.take(packer.lengths[0])
                got.append((spare, (doc, start, ids[: 4 * spare], total)))
                packer.add(length - spare, (doc, start + spare, ids[4 * spare :], total))
            window(got)
        if out:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, pool: int = POOL) -> DataFrame:
    """Pieces of all `docs` (doc_id, text) in sequences of at most `capacity` tokens (a power of two).

    A document's ids are its text's and then end_id (so a null or empty text has one id). Stretches
    of `capacity` ids are sequences of their own; a document's remainder waits in its task's pool of at
    most `pool` remainders, from which minimum bin slack fills one window at a time. What the task
    has left at its end fills windows of falling powers of two, one piece being cut where no set of
    whole ones fills a window; so only pool windows that no subset fills have padding.
    No row is moved: a task packs the rows it reads, in their order, and sequence_id is the
    task's number and a count, so a task that runs again gives the same rows. Repeated rows are
    packed each time, extra columns are ignored, an empty table gives an empty one.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(tokenizer, capacity, end_id, pool), _PIECE)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.read(spark, sf_dir, "documents"), tokenizer_path())
