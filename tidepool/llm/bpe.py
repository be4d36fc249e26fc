"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list has a sufficient lookahead L: once L bytes that follow a token are known, no text that comes
later can change that token. The encoder keeps the last pre-token's unstable bytes, at most L and a block,
emits tokens as soon as they are stable, and so needs constant memory for texts of any length. Decoding
runs an incremental byte-to-text machine over blocks of ids.

Why L suffices. Take two texts with a common beginning, and let P be the last position in it where both
have a token boundary with equal tokens before it. Applying rule r = (a, b) moves P only if `a` stands
before P and `b` after P, and then by len(a); the token after P then begins with `a`. The next rule that
moves P is a later one whose right part begins with that `a`. So P moves by the longest chain of such
rules at most, which `lookahead` computes in one pass from the last rule to the first.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from tidepool.llm.common import CACHES, map_texts, strings

# Fixed value: the pre-tokenizer pattern of the byte-level vocabulary, as public_tokenizers.PATTERN has it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters that a feed works on at a time, the longest piece that a memo keeps, and the words in each of
#: its two generations: more of them cost memory (some 150 MB a worker for these) and save time.
BLOCK, MEMO_CHARS, MEMO = 1 << 16, 64, 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """A byte-level merge list, with its lookahead."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.of_byte = [vocab[c] for c in alphabet]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        parts = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[a + b])
            parts.append((vocab[a], vocab[b], vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        self.text |= {i: t.encode() for t, i in self.special.items()}
        self.lookahead = self._lookahead(parts)

    def _lookahead(self, parts: list[tuple[int, int, int]]) -> int:
        left: dict[int, set[int]] = {}
        for a, _, ab in parts:
            left.setdefault(ab, set()).add(a)
        moved: dict[int, int] = {}  # token that may begin a right part -> longest move by later rules
        most = 0
        for a, b, _ in reversed(parts):
            reach = len(self.text[a]) + moved.get(a, 0)
            most = max(most, reach)
            spine, todo = set(), [b]
            while todo:
                t = todo.pop()
                if t not in spine:
                    spine.add(t)
                    todo += left.get(t, ())
            for t in spine:
                if moved.get(t, 0) < reach:
                    moved[t] = reach
        return most

    def tokens(self, piece: bytes) -> list[int]:
        """All merges of one piece."""
        ids = [self.of_byte[b] for b in piece]
        if len(ids) > 40:
            return self._by_heap(ids)
        get, merged = self.rank.get, self.merged
        never = len(merged)
        ranks = [get(p, never) for p in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < never:
            i = ranks.index(r)
            ids[i] = merged[r]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), never)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), never)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        n, get, merged = len(ids), self.rank.get, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = merged[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


class PieceStream:
    """The transducer for one pre-token: bytes go in, stable tokens come out."""

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.merges, self.block, self.held = merges, max(block, 2 * merges.lookahead), b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(data), self.block):
            self.held += data[i : i + self.block]
            end, stable = 0, len(self.held) - self.merges.lookahead
            if stable > 0:
                for t in self.merges.tokens(self.held):
                    if end + len(self.merges.text[t]) > stable:
                        break
                    end += len(self.merges.text[t])
                    out.append(t)
                self.held = self.held[end:]
        return out

    def close(self) -> list[int]:
        held, self.held = self.held, b""
        return self.merges.tokens(held)


class Memo(dict):
    """Packed ids by piece, in two generations of at most `entries` each: a full one becomes the old one,
    and pieces that are met again move back."""

    def __init__(self, of, entries: int):
        super().__init__()
        self.of, self.entries, self.old = of, entries, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.of(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


_ODD = regex.compile(r" [\s\x1c-\x1f]")
#: Characters after a match that can still change it.
_TAIL = 3


def pack(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, dtype="<u4").tobytes()


class Encoder:
    """Streaming encoder: feed() parts of a text and close() it; each returns packed little-endian ids.

    Every text goes through it. A blank before a character that isn't white space always begins a pre-token,
    so what stands before the last such blank is emitted, and only the rest is held. A pre-token of at most
    `lookahead` bytes has no stable token before it ends, so its ids are those of all its merges and can be
    remembered in bounded memos; a longer one goes through PieceStream, which emits as tokens become stable.
    Where characters beyond U+0530 stand, classes of characters are the library's own.
    """

    def __init__(self, merges: Merges, block: int = BLOCK, memo: int = MEMO):
        self.merges, self.block, self.pattern = merges, block, regex.compile(PATTERN)
        self.word = Memo(self._word, memo)
        self.bare = Memo(lambda p: self._pieces(p), memo // 8)
        self.spaced = Memo(lambda p: self._pieces(f" {p}"), memo // 2)
        self.split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.kinds: dict[str, str] = {}
        self._reset()

    def _reset(self) -> None:
        self.held, self.run, self.kind = "", None, ""

    def _word(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) <= self.merges.lookahead:
            return pack(self.merges.tokens(data))
        stream = PieceStream(self.merges, self.block)
        return pack([*stream.feed(data), *stream.close()])

    def _matches(self, text: str) -> Iterator[tuple[int, int]]:
        """Where the pre-tokens of a text begin and end."""
        if text.isascii() or max(text) < "\u0530":
            return (m.span() for m in self.pattern.finditer(text))
        # Beyond these scripts the library's tables of letters may be of another Unicode version than regex's.
        return (span for _, span in self.split(text))

    def _pieces(self, text: str) -> bytes:
        return b"".join([self.word[text[i:j]] for i, j in self._matches(text)])

    def _plain(self, text: str) -> bytes:
        """A block that begins and ends at pre-token boundaries."""
        if text[-1:] == " " or _ODD.search(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))

    def _kind(self, c: str) -> str:
        """The class of a character as the library sees it: what it makes one pre-token with."""
        if (got := self.kinds.get(c)) is None:
            one = lambda text: len(self.split(text)) == 1
            got = "letter" if one(f"a{c}") else "number" if one(f"1{c}") else "space" if one(f"\n{c}") else "other"
            if len(self.kinds) > 100_000:
                self.kinds.clear()
            self.kinds[c] = got
        return got

    def _same(self, text: str, start: int, kind: str) -> int:
        """Where a run of characters of one class ends."""
        others = "".join(c for c in set(text[start:]) if self._kind(c) != kind)
        return min((i for c in others if (i := text.find(c, start)) >= 0), default=len(text))

    def feed(self, text: str, last: bool = False) -> bytes:
        """Stable ids of what has come so far; a special token's string is one token."""
        out, buffer = [], self.held + text
        self.held = ""
        for name, at in self.merges.special.items():
            while (i := buffer.find(name)) >= 0:
                out += [self._stream(buffer[:i], True), pack([at])]
                buffer = buffer[i + len(name) :]
        if not last:
            keep = max((k for s in self.merges.special for k in range(1, len(s)) if buffer.endswith(s[:k])), default=0)
            tail = buffer[len(buffer) - keep :]
            out.append(self._stream(buffer[: len(buffer) - keep], False))
            self.held += tail
            return b"".join(out)
        out.append(self._stream(buffer, True))
        return b"".join(out)

    def close(self) -> bytes:
        out = self.feed("", last=True)
        self._reset()
        return out

    def _stream(self, buffer: str, last: bool) -> bytes:
        out = []
        if self.run is not None:  # inside a pre-token longer than a block
            full = self._same(buffer, 0, self.kind)
            end = full
            if self.kind == "space" and not (last and end == len(buffer)):
                end = max(0, end - 1)  # the last blank of a run may belong to the next pre-token
            out.append(pack(self.run.feed(buffer[:end].encode())))
            if full == len(buffer) and not last:
                self.held = buffer[end:]
                return b"".join(out)
            out.append(pack(self.run.close()))
            self.run, buffer = None, buffer[end:]
        if last:
            return b"".join([*out, self._plain(buffer)])
        if (cut := self._cut(buffer)) > 0:
            out.append(self._plain(buffer[:cut]))
            buffer = buffer[cut:]
        if len(buffer) > self.block:  # no blank to cut at
            end = 0
            for i, j in self._matches(buffer):
                if j > len(buffer) - _TAIL:
                    break
                out.append(self.word[buffer[i:j]])
                end = j
            buffer = buffer[end:]
            if len(buffer) > self.block:
                start = 1 if buffer[0] == " " and self._kind(buffer[1]) != "space" else 0
                self.kind = self._kind(buffer[start])
                self.run = PieceStream(self.merges, self.block)
                cut = len(buffer) - _TAIL
                out.append(pack(self.run.feed(buffer[:cut].encode())))
                buffer = buffer[cut:]
        self.held = buffer
        return b"".join(out)

    @staticmethod
    def _cut(buffer: str) -> int:
        at = buffer.rfind(" ", 0, len(buffer) - 1)
        while at > 0 and (buffer[at + 1].isspace() or buffer[at + 1] == " "):
            at = buffer.rfind(" ", 0, at)
        return at

    def encode(self, text: str) -> bytes:
        out = [self.feed(text[i : i + self.block]) for i in range(0, len(text), self.block)]
        out.append(self.close())
        return b"".join(out)


class Decoder:
    """Incremental byte-to-text machine: feed() packed ids and get the text that is complete so far;
    ill-formed bytes become U+FFFD, one for each maximal ill-formed part."""

    def __init__(self, merges: Merges):
        self.text, self.machine = merges.text, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        return self.machine.decode(b"".join(map(self.text.__getitem__, np.frombuffer(packed, "<u4").tolist())))

    def close(self) -> str:
        out = self.machine.decode(b"", True)
        self.machine.reset()
        return out


_ENCODERS: dict[tuple[bytes, int], Encoder] = {}
CACHES[__name__] = _ENCODERS.clear


def encoder_of(data: bytes, memo: int = MEMO) -> Encoder:
    """One encoder for each vocabulary and Python worker; its memos stay warm between tasks."""
    key = hashlib.sha256(data).digest(), memo
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Merges(data), memo=memo)
    return _ENCODERS[key]


def decoded_parts(merges: Merges, packed: bytes, block: int = BLOCK) -> Iterator[str]:
    machine = Decoder(merges)
    for i in range(0, len(packed), 4 * block):
        yield machine.feed(packed[i : i + 4 * block])
    yield machine.close()


#: The columns that bpe_encode can give besides the number of tokens.
COLUMNS = {"ids": pa.binary(), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def bpe_encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("ids", "decoded"), memo: int = MEMO) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns id_col, n_tokens and the wished columns: ids (packed little-endian 32-bit), decoded, and the
    SHA-256 of either. vocabulary: path of a byte-level tokenizers JSON file, read on the driver and
    broadcast (a file over 64 MB is refused). memo: words that a worker remembers. Null and empty texts have no tokens; repeated rows each
    give a row; other columns of df are ignored, whatever their names; an empty table gives an empty one.
    """
    with open(vocabulary, "rb") as f:
        data = f.read((64 << 20) + 1)
    if len(data) > 64 << 20:
        raise ValueError("the vocabulary is over 64 MB")
    shared = df.sparkSession.sparkContext.broadcast(data)

    def kernel(part: pa.RecordBatch) -> dict:
        encoder = encoder_of(shared.value, memo)
        out: dict[str, list] = {c: [] for c in ("n_tokens", *columns)}
        for text in strings(part, "text"):
            packed = encoder.encode(text)
            out["n_tokens"].append(len(packed) // 4)
            digest, kept = hashlib.sha256(), []
            if "decoded" in out or "decoded_sha256" in out:
                for x in decoded_parts(encoder.merges, packed):
                    digest.update(x.encode())
                    if "decoded" in out:
                        kept.append(x)
            for c in columns:
                out[c].append({"ids": lambda: packed, "decoded": lambda: "".join(kept), "ids_sha256": lambda: hashlib.sha256(packed).hexdigest(), "decoded_sha256": digest.hexdigest}[c]())
        return {"n_tokens": pa.array(out["n_tokens"], pa.int64())} | {c: pa.array(out[c], COLUMNS[c]) for c in columns}

    schema = ", ".join(["n_tokens long", *(f"{c} {'binary' if c == 'ids' else 'string'}" for c in columns)])
    return map_texts(df, id_col, text_col, schema, kernel)
