"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding: the last token of the BPE encoding of every prefix of a piece can be
found from those of shorter prefixes: it is the one token that ends there and
may follow the last token of the prefix before it (``follows``: merging the two
tokens' bytes gives the two tokens).  So the transducer is nondeterministic: from
every place of a piece a walker goes down the trie of tokens, and holds the
encoding of the bytes before its start.  A deterministic state is the set of
walkers alive.  A token is emitted as soon as all walkers agree on it, so the bytes
held back are fewer than twice the longest token.  States and transitions are made
when first needed, one a piece of text, and no longer kept when there are too many;
from the first byte without a transition the walkers run on by themselves.

Decoding: a state is the unfinished tail of a UTF-8 sequence (at most 3 bytes);
its transitions by token are made lazily too.  Malformed input becomes U+FFFD.

Edge cases: null and empty texts have no tokens; strings that look like special
tokens are ordinary text; texts of any length stream piece by piece; equal rows
get equal results; an empty table gives an empty result; columns of the input
named like an added one are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.common import map_batches

#: What a worker keeps for its life: some 70 MB.
MAX_STATES, MAX_PAIRS, MAX_PIECES = 30_000, 200_000, 100_000
#: Characters of a short piece, and of the texts that are worked on together.
SHORT, PORTION = 40, 2_000_000


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


class Merges:
    """The merge rules, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        #: token -> (time at which merging makes it, left part, right part); single bytes are there from the start
        self.made: dict[int, tuple[int, int, int]] = {}
        for token in sorted(ranks.values()):
            raw = self.bytes_of[token]
            if len(raw) == 1:
                self.made[token] = (-1, token, token)
            elif len(parts := self.merged(raw, token)) == 2 and all(p in self.made for p in parts):
                self.made[token] = (max(token, *(self.made[p][0] for p in parts)), *parts)
        #: the trie of the tokens that their own bytes encode to: byte -> [the token that ends here or -1, its trie or None]
        self.trie: dict[int, list] = {}
        for token in self.made:
            at = [-1, self.trie]
            for byte in self.bytes_of[token]:
                if at[1] is None:
                    at[1] = {}
                at = at[1].setdefault(byte, [-1, None])
            at[0] = token

    def merged(self, raw: bytes, below: int = 1 << 60) -> list[int]:
        """The definition: join the adjacent pair of least rank, the leftmost first, until none joins."""
        parts, ranks = [raw[k : k + 1] for k in range(len(raw))], self.ranks
        while len(parts) > 1:
            least, at = below, -1
            for k in range(len(parts) - 1):
                rank = ranks.get(parts[k] + parts[k + 1])
                if rank is not None and rank < least:
                    least, at = rank, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def follows(self, first: int, second: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two.

        Goes back in time: undoes, on either side of the border, the merge made
        last.  The tokens that then meet at the border must not have joined
        before the merge that was undone.
        """
        key = first << 32 | second
        if (known := self.pairs.get(key)) is not None:
            return known
        made, raw, rank_of = self.made, self.bytes_of, self.ranks.get
        left_until = right_until = 1 << 60
        while True:
            rank = rank_of(raw[first] + raw[second])
            if rank is not None and rank < left_until and rank <= right_until:
                known = False
                break
            (at, _, inner), (other, outer, _) = made[first], made[second]
            if at > other:
                left_until, first = at, inner
            elif other >= 0:
                right_until, second = other, outer
            else:
                known = True
                break
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[key] = known
        return known


#: An encoding of a prefix: its last token, the encoding before that one, the number of tokens since the last emission.
Back = tuple  # (token, Back | None, int)
#: A walker: the trie below its place, and the encoding of what lies before its start.
Walkers = list  # of (dict, Back)


def chain(back: Back) -> list[int]:
    """The tokens of an encoding since the last emission."""
    found = []
    while back[1] is not None:
        found.append(back[0])
        back = back[1]
    return found[::-1]


def agreed(walkers: Walkers) -> Back:
    """The longest encoding that those of all walkers begin with."""
    common = walkers[0][1]
    for _, back in walkers[1:]:
        while back is not common:
            if back[2] >= common[2]:
                back = back[1]
            else:
                common = common[1]
    return common


def since(walkers: Walkers, start: Back) -> Walkers:
    """The walkers after the emission of ``start``."""
    own = {id(start): (start[0], None, 0)}

    def moved(back: Back) -> Back:
        known = own.get(id(back))
        if known is None:
            before = moved(back[1])
            known = own[id(back)] = (back[0], before, before[2] + 1)
        return known

    return [(node, moved(back)) for node, back in walkers]


class State(dict):
    """byte -> (tokens emitted, next state)."""

    __slots__ = ("held", "walkers")

    def __init__(self, held: bytes, walkers: Walkers):
        self.held, self.walkers = held, walkers


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges, self.split = Merges(ranks), regex.compile(pattern).findall
        self.states: dict[tuple, State] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.start = State(b"", [(self.merges.trie, (-1, None, 0))])

    def run(self, walkers: Walkers, data: bytes, out: list[int] | None = None) -> Walkers:
        """The walkers after ``data``, by themselves, without the table; the one that starts behind it comes last and
        holds the encoding of all bytes.  With ``out`` tokens are emitted there when too many are held."""
        merges = self.merges
        trie, pairs, follows, most = merges.trie, merges.pairs.get, merges.follows, 2 * merges.longest
        for byte in data:
            alive, found = [], None
            for below, back in walkers:
                hit = below.get(byte)
                if hit is not None:
                    token, below = hit
                    if below is not None:
                        alive.append((below, back))
                    if found is None and token >= 0:
                        before = back[0]
                        if before < 0 or (follows(before, token) if (fits := pairs(before << 32 | token)) is None else fits):
                            found = (token, back, back[2] + 1)
            alive.append((trie, found))
            walkers = alive
            if found[2] > most and out is not None:
                common = agreed(walkers)
                out += chain(common)
                walkers = since(walkers, common)
        return walkers

    def transition(self, state: State, byte: int) -> tuple[list[int], State]:
        """Makes the transition by a byte that is not in the table yet."""
        walkers, held = self.run(state.walkers, (byte,)), state.held + bytes((byte,))
        common = agreed(walkers)
        done = chain(common)
        if done:
            walkers = since(walkers, common)
            held = held[sum(len(self.merges.bytes_of[t]) for t in done) :]
        # the token before only matters while a walker started right after it
        first = walkers[0][1]
        key = (first[0] if first[1] is None else tuple(chain(first)), held)
        after = self.states.get(key)
        if after is None:
            after = self.states[key] = State(held, walkers)
        state[byte] = result = (done, after)
        return result

    def piece(self, text: str) -> tuple[int, ...]:
        state, out, data = self.start, [], text.encode("utf-8", "surrogatepass")
        for at, byte in enumerate(data):
            known = state.get(byte)
            if known is None:
                if len(self.states) < MAX_STATES:  # one new transition a piece: the table grows where pieces pass often
                    self.transition(state, byte)
                walkers = self.run(state.walkers, data[at:], out)
                return (*out, *chain(walkers[-1][1]))
            if known[0]:
                out += known[0]
            state = known[1]
        return (*out, *chain(state.walkers[-1][1]))

    def in_order(self, pieces: list[str]) -> Iterator[tuple[int, ...]]:
        """``piece`` of each of the sorted pieces: what a piece shares with the one before is not read again."""
        path: list[tuple] = [((), self.start, self.start.walkers)]  # after each byte: tokens emitted, state or None, walkers
        before, run = b"", self.run
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            at = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                at += 1
            del path[at + 1 :]
            out, state, walkers = path[at]
            for byte in data[at:]:
                if state is not None:
                    known = state.get(byte)
                    if known is None and len(path) <= at + 1 and len(self.states) < MAX_STATES:
                        known = self.transition(state, byte)
                    if known is not None:
                        out, state = (*out, *known[0]), known[1]
                        walkers = state.walkers
                    else:
                        state, walkers = None, run(walkers, (byte,))
                else:
                    walkers = run(walkers, (byte,))
                path.append((out, state, walkers))
            before = data
            yield (*out, *chain(walkers[-1][1]))

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text.  The results for short pieces are kept for a while."""
        split = [self.split(text) for text in texts]
        table: dict[str, tuple[int, ...]] = dict.fromkeys(itertools.chain.from_iterable(split))
        known, older, fresh = self.pieces.get, self.older.get, []
        for piece in table:
            ids = known(piece)
            if ids is None and (ids := older(piece)) is None:
                if len(piece) <= SHORT:
                    fresh.append(piece)
                    continue
                ids = self.piece(piece)
            table[piece] = ids
        fresh.sort()
        table.update(zip(fresh, self.in_order(fresh)))
        self.pieces.update((p, ids) for p, ids in table.items() if len(p) <= SHORT)
        if len(self.pieces) > MAX_PIECES:
            self.older, self.pieces = self.pieces, {}
        return [list(itertools.chain.from_iterable([table[p] for p in own])) for own in split]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]


#: First byte of a sequence: its length, and the range that its second byte must lie in.
def _lead(byte: int) -> tuple[int, int, int] | None:
    if 0xC2 <= byte <= 0xDF:
        return 2, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 3, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 4, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


def utf8_step(tail: bytes, byte: int) -> tuple[str, bytes]:
    """Reads one byte after an unfinished sequence: the text that is now certain, and the new unfinished tail."""
    if tail:
        length, low, high = _lead(tail[0])
        if (low if len(tail) == 1 else 0x80) <= byte <= (high if len(tail) == 1 else 0xBF):
            tail += bytes((byte,))
            return (tail.decode(), b"") if len(tail) == length else ("", tail)
        text, tail = utf8_step(b"", byte)
        return "�" + text, tail
    if byte < 0x80:
        return chr(byte), b""
    return ("", bytes((byte,))) if _lead(byte) else ("�", b"")


class Tail(dict):
    """token -> (text, next tail)."""

    __slots__ = ("owner", "tail")

    def __init__(self, owner: Decoder, tail: bytes):
        self.owner, self.tail = owner, tail

    def __missing__(self, token: int) -> tuple[str, Tail]:
        text, tail = "", self.tail
        for byte in self.owner.bytes_of[token]:
            more, tail = utf8_step(tail, byte)
            text += more
        self[token] = result = (text, self.owner.tail(tail))
        return result


class Decoder:
    """Streaming: ``feed`` tokens in any portions, then ``end``."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.tails = bytes_of, {}
        self.at = self.start = self.tail(b"")

    def tail(self, tail: bytes) -> Tail:
        if tail not in self.tails:
            if len(self.tails) > 2_000:
                self.tails = {b"": self.start}
            self.tails[tail] = Tail(self, tail)
        return self.tails[tail]

    def feed(self, ids: list[int]) -> str:
        out, at = [], self.at
        for i in ids:
            text, at = at[i]
            out.append(text)
        self.at = at
        return "".join(out)

    def end(self) -> str:
        rest, self.at = ("�" if self.at.tail else ""), self.start
        return rest


_ENCODERS: dict[tuple[bytes, str], Encoder] = {}


def encoder(raw: bytes, pattern: str) -> Encoder:
    """The encoder of a rank file; a worker process keeps the last one."""
    key = (hashlib.sha256(raw).digest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(parse_ranks(raw), pattern)
    return _ENCODERS[key]


def default_vocabulary() -> tuple[bytes, str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def portions(column) -> Iterator[list[str]]:
    """Texts of a batch, some PORTION characters together; null is empty."""
    held, size = [], 0
    for value in column:
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


ENCODED = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
)
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode_texts(docs: DataFrame, text: str = "text", raw_ranks: bytes | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``token_ids`` and ``decoded`` (the text from the ids), or with digests of these.

    The rank file (under 1 MB) is read by the driver and sent with the function.
    """
    if raw_ranks is None:
        raw_ranks, pattern = default_vocabulary()

    def make():
        enc = encoder(raw_ranks, pattern)
        dec = Decoder(enc.merges.bytes_of)

        def run(texts) -> list:
            columns: list[list] = [[], [], []]
            for part in portions(texts):
                for ids in enc.encode_all(part):
                    back = dec.feed(ids) + dec.end()
                    columns[0].append(len(ids))
                    columns[1].append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() if digests else ids)
                    columns[2].append(hashlib.sha256(back.encode()).hexdigest() if digests else back)
            return columns

        return run

    return map_batches(docs, make, [text], DIGESTS if digests else ENCODED)
