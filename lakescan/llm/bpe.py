"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list has a *sufficient lookahead*: a number of bytes after a token's end that
settles whether the token ends there.  Merge ``j = (u, v)`` fires across a position if
``v`` is whole behind it by then.  Only an earlier merge ``i`` whose left side lies on
the right spine of ``v`` can take the end of ``v`` away, and whether that one fires
depends in turn on what follows, so

    need(j) = |v| + max(need(i) for i < j with left(i) on the right spine of v)

A token's end can only be crossed by merges whose left side lies on the token's own right spine; the largest ``need`` of these is
the token's lookahead, and the largest of all is the merge list's.  The transducer holds a window of
bytes, which it merges; it emits all tokens up to the last one that has its lookahead behind it
in the window, and goes on from there: the part of an encoding after a token's end is the
encoding of the rest.  At the end of a piece, which no merge crosses, everything is settled.  All
pieces take this way; a bounded memory in front of it holds what it gave for short ones.  Pieces
of any length are fed to it in chunks, and hashes and the decoder take what it emits, so besides the text itself
memory is that of a window and a block of short pieces.  Only if ids are asked for are they kept.

Decoding feeds the bytes of each token to an incremental UTF-8 state machine that
keeps at most three pending bytes.

Defined cases: a null text is an empty text (no ids, hash of the empty string).  Special
tokens that the vocabulary file lists are found in the text first, as its library does.
Rows are independent: repeats, ties and further columns have no influence, a null doc_id is passed on, and an
empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescan.llm.common import map_rows, whole_text

#: Fixed value: the pattern that splits text before merging, public with the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHIFT = 20
MANY = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, bytes and ranked merges of a byte-level BPE file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        alphabet = byte_alphabet()
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in ids.items()}
        self.byte_id = [ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        #: left << SHIFT | right -> rank << SHIFT | merged id
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(ids[a] << SHIFT | ids[b], rank << SHIFT | ids[a + b])
        self.longest = max(map(len, self.bytes_of.values()))
        #: Tokens emitted before the end of their piece.
        self.settled = 0
        self.need, self.lookahead = self._needs()

    def _needs(self) -> tuple[dict[int, int], int]:
        """Bytes that settle a token's end, and the most of them."""
        rights: dict[int, set[int]] = defaultdict(set)  # token -> right halves that make it
        need_of: dict[int, int] = defaultdict(int)  # token -> largest need of merges with it on the left

        def spine(token: int) -> set[int]:
            seen, todo = set(), [token]
            while todo:
                if (t := todo.pop()) not in seen:
                    seen.add(t)
                    todo += rights[t]
            return seen

        for pair, made in sorted(self.merges.items(), key=lambda x: x[1]):
            left, right = pair >> SHIFT, pair & (1 << SHIFT) - 1
            need_of[left] = max(need_of[left], len(self.bytes_of[right]) + max(need_of[t] for t in spine(right)))
            rights[made & (1 << SHIFT) - 1].add(right)
        out = {t: max(need_of[x] for x in spine(t)) for t in {*self.byte_id, *rights}}
        return out, max(out.values())

    def merge(self, data: bytes) -> list[int]:
        """Ids of a short piece: the lowest-ranked pair, leftmost first, until none is left."""
        byte_id, get, low = self.byte_id, self.merges.get, (1 << SHIFT) - 1
        ids = [byte_id[b] for b in data]
        ranks = [get(a << SHIFT | b, MANY) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < MANY:
            i = ranks.index(best)
            ids[i] = made = best & low
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << SHIFT | made, MANY)
            if i < len(ranks):
                ranks[i] = get(made << SHIFT | ids[i + 1], MANY)
        return ids

    def merge_window(self, data: bytes) -> list[int]:
        """The same for a longer window, with a heap and linked neighbours."""
        n, low, get = len(data), (1 << SHIFT) - 1, self.merges.get
        ids: list[int] = [self.byte_id[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << SHIFT | ids[i + 1], MANY)) < MANY]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << SHIFT | ids[j], MANY) != m:
                continue  # one side has changed since
            ids[i], ids[j] = m & low, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := get(ids[i] << SHIFT | ids[k], MANY)) < MANY:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := get(ids[h] << SHIFT | ids[i], MANY)) < MANY:
                heapq.heappush(heap, (x, h))
        return [t for t in ids if t >= 0]

    def stream(self, chunks: Iterable[bytes], window: int = 1024) -> Iterator[list[int]]:
        """Ids of a piece of any length, which comes in chunks; each list is stable when emitted."""
        held, span, need = b"", max(window, self.longest) + self.lookahead, self.need
        for chunk in chunks:
            held += chunk
            while len(held) >= span:
                ids, end = self.merge_window(held[:span]), span
                keep = len(ids)
                while keep and need[ids[keep - 1]] > span - end:
                    keep -= 1
                    end -= len(self.bytes_of[ids[keep]])
                held = held[end:]
                self.settled += keep
                yield ids[:keep]
        if held:
            yield self.merge(held) if len(held) <= 64 else self.merge_window(held)


class Encoder:
    """Encodes whole texts block by block; pieces seen lately are remembered up to a bound."""

    #: Pieces remembered by a worker, bytes of a remembered piece, characters of a block and of a chunk of a long piece.
    REMEMBERED, SHORT, BLOCK, CHUNK = 250_000, 64, 1 << 16, 1024

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, {}
        self.split = regex.compile(SPLIT)
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(self.v.special, key=len, reverse=True))) if self.v.special else None

    def entry(self, ids: list[int]) -> tuple[int, str, bytes, bytes]:
        """Count, decimal ids, bytes for the decoder, ids as 32-bit integers."""
        return len(ids), ",".join(map(str, ids)), b"".join(map(self.v.bytes_of.__getitem__, ids)), array("i", ids).tobytes()

    def piece(self, text: str) -> tuple[int, str, bytes, bytes]:
        data = text.encode()
        out = self.entry([t for ids in self.v.stream([data]) for t in ids])
        if len(data) <= self.SHORT:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            self.known[text] = out
        return out

    def parts(self, text: str) -> Iterator[tuple[int, int, int | None]]:
        """Start and end of what lies between special tokens, without copies, and of these with their ids."""
        at = 0
        if self.specials:
            for m in self.specials.finditer(text):
                yield at, m.start(), None
                yield m.start(), m.end(), self.v.special[m[0]]
                at = m.end()
        yield at, len(text), None

    def blocks(self, text: str) -> Iterator[list[tuple[int, str, bytes, bytes]]]:
        """Entries of pieces, in lists of about a block each; of a piece longer than a block, what the transducer emits."""
        get, new = self.known.get, self.piece
        for at, stop, special in self.parts(text):
            if special is not None:
                yield [self.entry([special])]
                continue
            while at < stop:
                end = min(stop, at + self.BLOCK)
                pieces = self.split.findall(text, at, end)
                if end < stop:
                    # The last two may still change with what follows: a run may go on, an apostrophe may begin a suffix.
                    if len(pieces) < 3:
                        end = self.split.match(text, at, stop).end()
                        chunks = (text[k : min(k + self.CHUNK, end)].encode() for k in range(at, end, self.CHUNK))
                        yield from ([self.entry(ids)] for ids in self.v.stream(chunks))
                        at = end
                        continue
                    end -= len(pieces.pop()) + len(pieces.pop())
                at = end
                yield [get(p) or new(p) for p in pieces]

    def ids(self, text: str) -> list[int]:
        return [i for block in self.blocks(text) for e in block for i in array("i", e[3])]


class Decoder:
    """Turns ids back into text piece by piece; pending bytes of a character are kept."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def feed_bytes(self, data: bytes) -> str:
        return self.machine.decode(data)

    def end(self) -> str:
        return self.machine.decode(b"", True)

    def text(self, ids) -> str:
        return self.feed(ids) + self.end()


_made: dict[int, Vocabulary] = {}


def vocabulary_of(text: str) -> Vocabulary:
    """One per worker process."""
    if (key := hash(text)) not in _made:
        _made.clear()
        _made[key] = Vocabulary(text)
    return _made[key]


def digest(encoder: Encoder, text: str | None, keep_ids: bool = False) -> tuple:
    ids, decoded, n, first, kept = hashlib.sha256(), hashlib.sha256(), 0, True, []
    decoder = Decoder(encoder.v)
    for block in encoder.blocks(text or ""):
        if not block:
            continue
        counts, strings, data, raw = zip(*block, strict=True)
        n += sum(counts)
        ids.update((("" if first else ",") + ",".join(strings)).encode())
        decoded.update(decoder.feed_bytes(b"".join(data)).encode())
        first = False
        if keep_ids:
            kept.append(b"".join(raw))
    decoded.update(decoder.end().encode())
    out = n, ids.hexdigest(), decoded.hexdigest()
    return (*out, array("i", b"".join(kept))) if keep_ids else out


def encode(docs: DataFrame, vocabulary_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids.

    The driver reads the vocabulary file and broadcasts its text, whose size the
    vocabulary bounds; executors need no file.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        encoder = Encoder(vocabulary_of(sent.value))
        return lambda doc_id, text: (doc_id, *digest(encoder, text, keep_ids))

    fields = [("doc_id", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    if keep_ids:
        fields.append(("token_ids", "array<int>", pa.list_(pa.int32())))
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), ["doc_id", "text"], make, fields)


def decode(tokens: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, text out of doc_id, token_ids."""
    with open(vocabulary_path, encoding="utf-8") as f:
        sent = tokens.sparkSession.sparkContext.broadcast(f.read())

    def make():
        v = vocabulary_of(sent.value)
        return lambda doc_id, ids: (doc_id, Decoder(v).text(ids or []))

    return map_rows(tokens, ["doc_id", "token_ids"], make, [("doc_id", "long", pa.int64()), ("text", "string", pa.string())])
