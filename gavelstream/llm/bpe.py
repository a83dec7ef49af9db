"""Byte-level BPE with public ranks: a lazily determinised transducer, and streaming decoding.

A split of a text into tokens is what BPE makes of it exactly if each token is its own
encoding and so is each pair of neighbours; every prefix has one such split. Read byte by byte,
the possible unfinished tokens are the suffixes that begin a token. That set is given by its
longest member, which is the deterministic state; states and moves are made when first met.
A move names the tokens that end at the byte, and the one that may follow what stands before it
ends the prefix. Short pieces go through together, a byte of each at a time, in numpy. A token is certain, and emitted, once the splits of all prefixes at which an
unfinished token could begin share it: the lookahead is bounded by the longest token.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import add_columns

# Bytes that a worker remembers at most, as estimated below, beside the ranks and two small facts on each of them: pieces (two
# generations), pairs of tokens (of long pieces, and of short ones in arrays), states with their moves. Beyond a bound it forgets
# and makes the entries anew.
PIECES_BYTES, PAIRS_BYTES, STATES_BYTES = 40_000_000, 10_000_000, 12_000_000
PIECE, PAIR, STATE, MOVE = 220, 130, 500, 260  # about what an entry takes, a piece besides its own bytes
REMEMBERED_LENGTH = 48
# Pieces of texts that wait for new ones to be encoded together, and new ones that go through the transducer together.
PIECES_AT_ONCE, NEW_AT_ONCE = 200_000, 20_000
DECODE_TOKENS = 8192
NO_RANK = 1 << 40

# Bytes of a piece that are read before certain tokens are emitted.
WINDOW = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class Known:
    """Numbers that were found out by key, as sorted arrays: 64-bit key to number."""

    def __init__(self) -> None:
        self.keys, self.numbers = np.array([], np.uint64), np.array([], np.int32)

    def find(self, keys: np.ndarray, make: Callable[[int], int]) -> np.ndarray:
        """The number of each key; those not known yet are made, each once."""
        at = np.searchsorted(self.keys, keys)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
            if known.all():
                return self.numbers[at]
            new = np.unique(keys[~known])
        else:
            new = np.unique(keys)
        made = np.fromiter(map(make, new.tolist()), np.int32, len(new))
        where = np.searchsorted(self.keys, new)
        self.keys, self.numbers = np.insert(self.keys, where, new), np.insert(self.numbers, where, made)
        return self.numbers[np.searchsorted(self.keys, keys)]


class Transducer:
    """Bytes of one piece, or of many short ones, to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longer = {token[:n] for token in ranks for n in range(len(token))}
        self._own: dict[int, bool] = {}
        self._ends: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._fitting = Known()
        self._forget()

    def _forget(self) -> None:
        self._numbers: dict[bytes, int] = {b"": 0}
        self._states: list[bytes] = [b""]
        self._moves: list[dict[int, tuple[int, list[tuple[int, int]]]]] = [{}]
        self._held = 0
        # Moves of many pieces at once: a move's next state and its tokens, that is where they begin in the flat lists and how many.
        self._met = Known()
        self._next, self._first, self._count = array("i"), array("i"), array("i")
        self._tokens, self._lengths = array("I"), array("H")

    def merges(self, piece: bytes) -> Iterator[list[bytes]]:
        """Plain merging by rank, for the few bytes of one or two tokens: the parts after each step."""
        rank = self.ranks.get
        parts = [piece[i:i + 1] for i in range(len(piece))]
        yield parts
        while True:
            made = [rank(a + b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
            lowest = min(made, default=NO_RANK)
            if lowest == NO_RANK:
                return
            at = made.index(lowest)
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2:]]
            yield parts

    def merged(self, piece: bytes) -> list[int]:
        *_, parts = self.merges(piece)
        return [self.ranks[p] for p in parts]

    def _is_own(self, token: int) -> bool:
        found = self._own.get(token)
        if found is None:
            found = self._own[token] = self.merged(self.token[token]) == [token]
        return found

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes it, a single byte twice; none if a merge inside it ranks behind one that needs it."""
        if token not in self._ends:
            *_, parts, whole = [[], *self.merges(self.token[token])]
            halves = (self.ranks[parts[0]], self.ranks[parts[-1]]) if parts else (token, token)
            ordered = whole == [self.token[token]] and all(
                len(self.token[h]) == 1 or h < token and self._halves(h) is not None for h in halves if h != token)
            self._ends[token] = halves if ordered else None
        return self._ends[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE can put ``right`` behind ``left``."""
        if len(self._pairs) * PAIR >= PAIRS_BYTES:
            self._pairs.clear()
        found = self._pairs[left, right] = self._follows(left, right)
        return found

    def _follows(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border before both sides are whole: their merges are undone from the latest on to see that.

        What crosses the border at a step must come before all merges that are undone; of equals the left one is first.
        """
        token, rank = self.token, self.ranks.get
        if self._halves(left) is None or self._halves(right) is None:
            return self.merged(token[left] + token[right]) == [left, right]
        before = NO_RANK
        while rank(token[left] + token[right], NO_RANK) >= before:
            left_half, right_half = self._halves(left)[1], self._halves(right)[0]
            if right_half != right and (left <= right or left_half == left):
                before, right = right + 1, right_half
            elif left_half != left:
                before, left = left, left_half
            else:
                return True
        return False

    def _move(self, at: int, byte: int) -> tuple[int, list[tuple[int, int]]]:
        """The next state, and the tokens that end here with their lengths."""
        grown = self._states[at] + bytes((byte,))
        suffixes = [grown[k:] for k in range(len(grown))]
        ending = [(self.ranks[s], len(s)) for s in suffixes if s in self.ranks and self._is_own(self.ranks[s])]
        state = next((s for s in suffixes if s in self.longer), b"")
        number = self._numbers.setdefault(state, len(self._states))
        if number == len(self._states):
            self._states.append(state)
            self._moves.append({})
            self._held += STATE
        self._held += MOVE
        self._moves[at][byte] = number, ending
        return number, ending

    def run(self, piece: bytes) -> Iterator[int]:
        """The tokens of a piece, each soon after it is certain."""
        if self._held > STATES_BYTES:
            self._forget()
        moves, pairs = self._moves, self._pairs
        # last[i] ends the prefix of length start + i + 1; what ends at or before ``sent`` is emitted.
        last: list[int] = []
        at = start = sent = 0
        for end, byte in enumerate(piece, 1):
            at, ending = moves[at].get(byte) or self._move(at, byte)
            for token, length in ending:
                if length == end:
                    break
                before = last[end - length - start - 1]
                fits = pairs.get((before, token))
                if fits or fits is None and self.follows(before, token):
                    break
            last.append(token)
            if len(last) == WINDOW:
                sure = self._certain(last, start, end, end - len(self._states[at]))
                yield from self._back(last, start, sent, sure)
                # The longest unfinished token begins at ``sure`` or later.
                last, start, sent = last[sure - start - 1:] if sure else last, max(start, sure - 1), max(sent, sure)
        yield from self._back(last, start, sent, len(piece))

    def _certain(self, last: list[int], start: int, end: int, oldest: int) -> int:
        """The prefix that ends a token in the splits of all prefixes from ``oldest`` to ``end``."""
        live = set(range(oldest, end + 1))
        while len(live) > 1:
            longest = max(live)
            live.remove(longest)
            live.add(longest - len(self.token[last[longest - start - 1]]))
        return live.pop()

    def _back(self, last: list[int], start: int, sent: int, end: int) -> list[int]:
        """Tokens between two prefix lengths, read back from the longer."""
        tokens = []
        while end > sent:
            tokens.append(last[end - start - 1])
            end -= len(self.token[tokens[-1]])
        return tokens[::-1]

    def _number_of_move(self, key: int) -> int:
        """A move from a state (times 256) by a byte, put into the lists that ``run_many`` reads."""
        at, byte = divmod(key, 256)
        number, ending = self._moves[at].get(byte) or self._move(at, byte)
        self._next.append(number)
        self._first.append(len(self._tokens))
        self._count.append(len(ending))
        self._tokens.extend(token for token, _ in ending)
        self._lengths.extend(length for _, length in ending)
        return len(self._next) - 1

    def run_many(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each of many short pieces, as ``run`` gives them."""
        if self._held > STATES_BYTES:
            self._forget()
        if self._fitting.keys.nbytes + self._fitting.numbers.nbytes > PAIRS_BYTES:
            self._fitting = Known()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        # Longest first, so that the pieces that have a byte at a place come first.
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        most = int(sizes[0]) if len(sizes) else 0
        # The token that ends each prefix, and its length.
        last, length = np.zeros((most + 1, len(pieces)), np.uint32), np.zeros((most + 1, len(pieces)), np.uint16)
        state = np.zeros(len(pieces), np.uint64)
        for end in range(1, most + 1):
            n = int(np.searchsorted(-sizes, -end, "right"))
            move = self._met.find(state[:n] * np.uint64(256) + data[starts[:n] + (end - 1)], self._number_of_move)
            # Copies: a list cannot grow while numpy looks at it.
            state = np.array(self._next, np.uint64)[move]
            first, rest = np.array(self._first)[move], np.array(self._count)[move]
            tokens, lengths = np.array(self._tokens, np.uint32), np.array(self._lengths, np.uint16)
            rows = np.arange(n)
            while len(rows):
                token, long = tokens[first], lengths[first]
                # The last one that is left needs no look, nor one that is the whole prefix.
                fits = (rest == 1) | (long == end)
                ask = np.nonzero(~fits)[0]
                if len(ask):
                    before = last[end - long[ask].astype(np.int64), rows[ask]].astype(np.uint64)
                    pairs = (before << np.uint64(32)) | token[ask]
                    fits[ask] = self._fitting.find(pairs, lambda key: self._follows(key >> 32, key & 0xFFFFFFFF))
                last[end, rows[fits]], length[end, rows[fits]] = token[fits], long[fits]
                first, rest, rows = first[~fits] + 1, rest[~fits] - 1, rows[~fits]
        # Tokens are read back from the end, one of each piece at a time.
        at, rows, found = sizes.copy(), np.nonzero(sizes)[0], []
        n_tokens = np.zeros(len(pieces), np.int64)
        while len(rows):
            found.append((rows, last[at[rows], rows]))
            n_tokens[rows] += 1
            at[rows] -= length[at[rows], rows]
            rows = rows[at[rows] > 0]
        ends = np.cumsum(n_tokens)
        flat = np.zeros(int(n_tokens.sum()), "<u4")
        for k, (rows, token) in enumerate(found, 1):
            flat[ends[rows] - k] = token
        packed, bounds = flat.tobytes(), np.zeros((len(pieces), 2), np.int64)
        bounds[order, 0], bounds[order, 1] = 4 * (ends - n_tokens), 4 * ends
        return [packed[a:b] for a, b in bounds.tolist()]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """A piece that is a token as a whole is that token, even where merging would not reach it."""
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else tuple(self.run(piece))


class Tokenizer:
    """Texts to ids: pieces by a pattern, each through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        """Forget the pieces: a worker that waits, or does other work, holds the ranks, states and pairs alone."""
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._held = 0

    def _remember(self, piece: str, ids: bytes) -> None:
        """In the young generation, which becomes the older one when it is full."""
        self._held += PIECE + 2 * len(piece) + len(ids)
        if self._held > PIECES_BYTES:
            self._older, self._pieces, self._held = self._pieces, {}, 0
        self._pieces[piece] = ids

    def _new_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the young generation lacks; short ones that are met again move there from the older one."""
        made, short = {}, []
        for piece in pieces:
            if (ids := self._older.get(piece)) is not None:
                made[piece] = ids
                continue
            data = piece.encode()
            if len(piece) > REMEMBERED_LENGTH or data in self.transducer.ranks:
                made[piece] = np.array(self.transducer.encode(data), "<u4").tobytes()
            else:
                short.append(piece)
        for some in batched(short, NEW_AT_ONCE):
            made.update(zip(some, self.transducer.run_many([piece.encode() for piece in some]), strict=True))
        for piece, ids in made.items():
            if len(piece) <= REMEMBERED_LENGTH:
                self._remember(piece, ids)
        return made

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as packed little-endian unsigned 32-bit numbers. New pieces of several texts are encoded together."""
        waiting: list[tuple[list[str], list[bytes | None]]] = []
        n = 0
        for text in texts:
            pieces = self.pattern.findall(text)
            waiting.append((pieces, list(map(self._pieces.get, pieces))))
            n += len(pieces)
            if n >= PIECES_AT_ONCE:
                yield from self._joined(waiting)
                waiting, n = [], 0
        yield from self._joined(waiting)

    def _joined(self, waiting: list[tuple[list[str], list[bytes | None]]]) -> Iterator[bytes]:
        made = self._new_pieces({piece for pieces, packed in waiting if None in packed
                                 for piece, ids in zip(pieces, packed, strict=True) if ids is None})
        for pieces, packed in waiting:
            yield b"".join([ids or made[piece] for ids, piece in zip(packed, pieces, strict=True)] if None in packed else packed)

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        return next(self.encode_all([text]))


class Utf8Machine:
    """Incremental UTF-8: its state is the bytes of an unfinished character, three at most."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that needs more."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                needs = 1 + (0xC2 <= lead < 0xF5) + (0xE0 <= lead < 0xF5) + (0xF0 <= lead < 0xF5)
                return back if needs > back else 0
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


def decoded(packed: bytes, token: dict[int, bytes]) -> Iterator[str]:
    """Text as it becomes certain; bytes that are no UTF-8 become U+FFFD, an unknown id nothing."""
    machine, ids = Utf8Machine(), np.frombuffer(packed, "<u4")
    for start in range(0, len(ids), DECODE_TOKENS):
        found = list(map(token.get, ids[start:start + DECODE_TOKENS].tolist()))
        yield machine.feed(b"".join(found if None not in found else [t or b"" for t in found]))
    yield machine.finish()


@lru_cache(maxsize=1)
def _tokenizer(file: str, pattern: str) -> Tokenizer:
    return Tokenizer(read_ranks(SparkFiles.get(file)), pattern)


@lru_cache(maxsize=1)
def _tokens(file: str) -> dict[int, bytes]:
    """What decoding needs: the bytes of each rank, no transducer."""
    return {rank: token for token, rank in read_ranks(SparkFiles.get(file)).items()}


def _plain(texts: pa.Array) -> Iterator[str]:
    return (t.as_py() or "" for t in texts)


def _shared(df: DataFrame, ranks_path: str) -> str:
    """Give every executor the rank file; returns its name there."""
    df.sparkSession.sparkContext.addFile(ranks_path)
    return ranks_path.rsplit("/", 1)[-1]


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the tokens as packed little-endian unsigned 32-bit numbers (BINARY).

    A null or empty text has no tokens and an empty ``ids``. Whole texts of any length are
    read piece by piece. An input column of that name is replaced; rows are neither dropped nor merged.
    """
    file = _shared(df, ranks_path)

    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(_tokenizer(file, pattern).encode_all(_plain(texts)), pa.binary())]

    return add_columns(df, [text], f"`{ids}` binary", make, done=lambda: _tokenizer(file, pattern).forget())


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text`` from packed ids; null ids give an empty text, unknown ids nothing. A column of that name is replaced."""
    file = _shared(df, ranks_path)

    def make(packed: pa.Array) -> list[pa.Array]:
        token = _tokens(file)
        return [pa.array(["".join(decoded(p or b"", token)) for p in packed.to_pylist()], pa.string())]

    return add_columns(df, [ids], f"`{text}` string", make)


def encode_and_decode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids",
                      again: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass of one worker, which holds the ranks once."""
    file = _shared(df, ranks_path)

    def make(texts: pa.Array) -> list[pa.Array]:
        tokenizer = _tokenizer(file, pattern)
        packed = list(tokenizer.encode_all(_plain(texts)))
        token = tokenizer.transducer.token
        return [pa.array(packed, pa.binary()), pa.array(["".join(decoded(p, token)) for p in packed], pa.string())]

    return add_columns(df, [text], f"`{ids}` binary, `{again}` string", make, done=lambda: _tokenizer(file, pattern).forget())
