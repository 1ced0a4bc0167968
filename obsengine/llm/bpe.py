"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder as a state machine.

Encoding works on a text in slices and keeps constant memory, whatever the text's length. Words (the
pre-tokenizer's matches) end where the kinds of characters show it; inside a word, tokens are emitted
once no continuation can change them. How many bytes that takes is the merge list's *sufficient
lookahead*, computed from the merges alone:

    Take two continuations of the same bytes and apply the merges in order of rank. A boundary that both
    share moves left only if the token x before it merges with the token y after it, by x's length.
    Since y has been growing to the right from the last token that moved the boundary, that token is on
    y's left spine (y, y's left part, that one's left part, ...). So the longest such chain of merges of
    rising rank, weighted by the left parts' lengths, bounds how far a continuation reaches back.

Defined cases: a null text encodes as an empty one, to no ids; the special token's string in a text
becomes its id, as the tokenizers library does; ids decode as UTF-8, ill-formed bytes to U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsengine.llm.common import map_rows

#: The byte-level pre-tokenizer's pattern. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The last place where a word ends whatever follows: before white space, or where letters or numbers end.
LAST_END = regex.compile(r"(?r)(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")
RUNS = tuple(regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+"))
SLICE = 1 << 12
CACHED_WORDS = 200_000
CACHED_BYTES = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in vocabulary files: themselves where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Merges(dict):
    """Words' ids as packed little-endian 32-bit integers, kept for a bounded number of short words."""

    def __init__(self, path: str):
        model = json.loads(open(path, encoding="utf-8").read())
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocabulary = {raw(s): i for s, i in model["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for data, i in [*vocabulary.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = data
        self.start = [vocabulary.get(bytes([b]), -1) for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}  # to the merge's rank and its token
        self.never = (len(model["model"]["merges"]), -1)
        parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["model"]["merges"]):
            a, b = map(raw, merge if isinstance(merge, list) else merge.split(" "))
            left, right, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if whole in parts or any(len(x) > 1 and vocabulary[x] not in parts for x in (a, b)):
                raise ValueError("streaming needs a merge list whose merges build on earlier ones, each a new token")
            parts[whole] = left, right
            self.pairs[left, right] = rank, whole
        self.lookahead = self._lookahead(parts)
        self.words = regex.compile(PATTERN)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _lookahead(self, parts: dict[int, tuple[int, int]]) -> int:
        reach: dict[int, int] = {}  # by token, the longest chain that ends with a merge whose left part it is
        longest = 0
        for left, right in self.pairs:  # in order of rank
            spine, most = right, 0
            while True:
                most = max(most, reach.get(spine, 0))
                if spine not in parts:
                    break
                spine = parts[spine][0]
            chain = len(self.bytes_of[left]) + most
            reach[left] = max(reach.get(left, 0), chain)
            longest = max(longest, chain)
        return longest

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        if len(data) > CACHED_BYTES:
            run = OpenWord(self)
            return run.feed(data) + run.close()
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = array("I", self.merge_short(data)).tobytes()
        return found

    def merge_short(self, data: bytes) -> list[int]:
        ids, pairs, never = [self.start[b] for b in data], self.pairs, self.never
        ranks = [pairs.get(p, never) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) is not never:
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = pairs.get((ids[i], ids[i + 1]), never)
            if i:
                ranks[i - 1] = pairs.get((ids[i - 1], ids[i]), never)
        return ids

    def merge_long(self, data: bytes) -> list[int]:
        """The same with a heap, for long words."""
        ids = [self.start[b] for b in data]
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*pairs[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, whole, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = whole, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (p := (whole, ids[after[j]])) in pairs:
                    heapq.heappush(heap, (*pairs[p], i, *p))
            if before[i] >= 0 and (p := (ids[before[i]], whole)) in pairs:
                heapq.heappush(heap, (*pairs[p], before[i], *p))
        return [x for x in ids if x >= 0]


class OpenWord:
    """A word whose bytes still come: holds no more than a few times the lookahead."""

    def __init__(self, merges: Merges):
        self.merges, self.data = merges, b""

    def feed(self, data: bytes) -> bytes:
        out, step = [], 4 * self.merges.lookahead + 256
        for at in range(0, len(data), step):
            self.data += data[at : at + step]
            if len(self.data) >= step:
                out.append(self._emit(len(self.data) - self.merges.lookahead))
        return b"".join(out)

    def close(self) -> bytes:
        return self._emit(len(self.data))

    def _emit(self, stable: int) -> bytes:
        ids, end = array("I"), 0
        for i in self.merges.merge_long(self.data):
            if end + len(self.merges.bytes_of[i]) > stable:
                break
            ids.append(i)
            end += len(self.merges.bytes_of[i])
        self.data = self.data[end:]
        return ids.tobytes()


class Plain:
    """Text without special tokens, in slices, to packed ids."""

    def __init__(self, merges: Merges):
        self.merges, self.text = merges, ""
        self.open: OpenWord | None = None  # the word that has grown beyond a slice, of the kind `run`
        self.run, self.held = RUNS[0], ""

    def feed(self, text: str) -> bytes:
        out = b""
        if self.open:
            end = m.end() if (m := self.run.match(text)) else 0
            out, text = self._grow(text[:end]), text[end:]
            if not text:
                return out
            if self.run is RUNS[2]:  # the last white space before other text is a word of its own or goes with what follows
                text, self.held = self.held + text, ""
            out += self._shut()
        self.text += text
        if len(self.text) < SLICE:
            return out
        if m := LAST_END.search(self.text):
            out += self._words(self.text[: m.start()])
            self.text = self.text[m.start() :]
        if len(self.text) >= SLICE:  # one word that is still open, after others that aren't
            *done, last = self.merges.words.finditer(self.text)
            out += self._words(self.text[: last.start()])
            self.text = ""
            word = last.group()
            self.run = next(r for r in RUNS if r.match(word[-1]))
            self.open = OpenWord(self.merges)
            out += self._grow(word)
        return out

    def close(self) -> bytes:
        out = self._shut() if self.open else b""
        out, self.text = out + self._words(self.text), ""
        return out

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.merges.__getitem__, self.merges.words.findall(text)))

    def _grow(self, text: str) -> bytes:
        if self.run is RUNS[2]:
            text = self.held + text
            text, self.held = text[:-1], text[-1:]
        return self.open.feed(text.encode())

    def _shut(self) -> bytes:
        out = self.open.feed(self.held.encode()) + self.open.close()
        self.open, self.held = None, ""
        return out


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def encode_slices(slices: Iterable[str], codec: Merges) -> Iterator[bytes]:
    """Packed ids of the text whose slices come one by one."""
    plain, tail = Plain(codec), ""
    hold = max([len(s) for s in codec.special] or [1]) - 1
    for piece in slices:
        tail += piece
        if codec.splits:
            *parts, tail = codec.splits.split(tail)
            for text, special in zip(parts[::2], parts[1::2], strict=True):
                yield plain.feed(text) + plain.close() + array("I", [codec.special[special]]).tobytes()
        if len(tail) > hold:
            yield plain.feed(tail[: len(tail) - hold])
            tail = tail[len(tail) - hold :]
    yield plain.feed(tail) + plain.close()


def encode(text: str | None, codec: Merges) -> bytes:
    """Ids as packed little-endian unsigned 32-bit integers."""
    text = text or ""
    return b"".join(encode_slices((text[i : i + SLICE] for i in range(0, len(text), SLICE)), codec))


def decode_slices(ids: bytes, codec: Merges) -> Iterator[str]:
    """Text of packed ids, slice by slice: bytes of a character that isn't whole yet wait in the decoder's state."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(ids), 4 * SLICE):
        part = np.frombuffer(ids[at : at + 4 * SLICE], "<u4").tolist()
        yield machine.decode(b"".join(map(codec.bytes_of.__getitem__, part)))
    yield machine.decode(b"", True)


def encode_table(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids): ids is binary, little-endian unsigned 32-bit integers. A narrow map; nothing is shuffled."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def run(part: dict[str, list]) -> dict[str, list]:
        return {"doc_id": part["doc_id"], "ids": [encode(t, merges(path)) for t in part["text"]]}

    return map_rows(rows, run, "doc_id long, ids binary")


def decode_table(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of what encode_table returns; null ids give a null text."""

    def run(part: dict[str, list]) -> dict[str, list]:
        codec = merges(path)
        return {"doc_id": part["doc_id"], "text": [None if i is None else "".join(decode_slices(i, codec)) for i in part["ids"]]}

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded, without keeping either."""

    def run(part: dict[str, list]) -> dict[str, list]:
        codec = merges(path)
        n, ids_sha, text_sha = [], [], []
        for ids in part["ids"]:
            text = hashlib.sha256()
            for piece in decode_slices(ids, codec):
                text.update(piece.encode())
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(text.hexdigest())
        return {"doc_id": part["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return map_rows(encode_table(docs, path), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
