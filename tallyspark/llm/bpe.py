"""Byte-pair encoding by a transducer over the merges of a rank file.

The merges are compiled into a finite-state transducer that guesses where tokens begin and end. A token
sequence is the encoding of its bytes exactly if every token encodes to itself and every adjacent pair of
tokens stays a pair when its bytes are encoded alone, so a hypothesis needs only the token that begins (a
trie node) and the token before it. The transducer is determinised lazily: a state is the set of live
hypotheses after some input, and the transition of a state under a byte is computed once and kept. The
encoding of every prefix ends in one definite token, so each transition yields that token's length, and a
token is emitted as soon as no live hypothesis begins before its end (the lookahead is bounded by the
longest token). The time is linear in the length of a piece, however long.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import regex

#: Fixed value: the public pattern that splits texts before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Determinised states and pieces kept per worker; beyond that the store is emptied and filled again.
MAX_STATES = 200_000
MAX_PIECES = 200_000
#: Pieces longer than this (bytes) are not kept.
LONG_PIECE = 64
_CHUNK = 4_096


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class Transducer:
    """Encoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.final: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = self.children[node].get(byte)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][byte] = nxt
                    self.children.append({})
                    self.final.append(-1)
                node = nxt
            self.final[node] = rank
        self.split = regex.compile(PATTERN).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pair = lru_cache(maxsize=500_000)(self._pair)
        self._reset()

    def _reset(self) -> None:
        # a hypothesis is (trie node of the open token, token before it, bytes read of the open token)
        self.states: dict[tuple, int] = {}
        self.hypotheses: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int, int]]] = []
        self.start = self._state(((0, -1, 0),))

    def _state(self, hypotheses: tuple) -> int:
        state = self.states.get(hypotheses)
        if state is None:
            state = self.states[hypotheses] = len(self.hypotheses)
            self.hypotheses.append(hypotheses)
            self.moves.append({})
        return state

    def merge(self, piece: bytes) -> list[int]:
        """The encoding by the definition: merge the adjacent pair of lowest rank until none is left."""
        parts, ranks = [piece[k : k + 1] for k in range(len(piece))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                rank = ranks.get(parts[k] + parts[k + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if best is None:
                break
            pair, merged, k = (parts[at], parts[at + 1]), [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    merged.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    merged.append(parts[k])
                    k += 1
            parts = merged
        return [ranks[p] for p in parts]

    def _pair(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (-1: the start of a piece)."""
        if before < 0:
            return self.merge(self.tokens[token]) == [token]
        return self.pair(-1, token) and self.merge(self.tokens[before] + self.tokens[token]) == [before, token]

    def _move(self, state: int, byte: int) -> tuple[int, int, int]:
        """(next state, token that ends the encoding of the prefix read so far, its length)."""
        alive, ended = [], None
        for node, before, read in self.hypotheses[state]:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            if self.children[nxt]:
                alive.append((nxt, before, read + 1))
            token = self.final[nxt]
            if token >= 0 and ended is None and self.pair(before, token):
                ended = (token, read + 1)
        if ended is None:
            raise ValueError(f"the vocabulary lacks the byte {byte}")
        move = (self._state((*alive, (0, ended[0], 0))), *ended)
        self.moves[state][byte] = move
        return move

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece. Long pieces are emitted in blocks: before a block is read, all tokens that
        end where no live hypothesis begins earlier are settled, so memory stays bounded by a block."""
        if len(self.hypotheses) > MAX_STATES:
            self._reset()
        state, moves = self.start, self.moves
        out: list[int] = []
        last: list[tuple[int, int]] = []  # token and length for every prefix since the settled position
        for k, byte in enumerate(piece):
            move = moves[state].get(byte) or self._move(state, byte)
            state = move[0]
            last.append((move[1], move[2]))
            if len(last) >= _CHUNK and k + 1 < len(piece):
                last = self._settle(state, last, out)
                if len(self.hypotheses) > MAX_STATES:
                    keep = self.hypotheses[state]
                    self._reset()
                    state, moves = self._state(keep), self.moves
        out.extend(self._trace(last, len(last)))
        return out

    @staticmethod
    def _trace(last: list[tuple[int, int]], at: int) -> list[int]:
        back = []
        while at > 0:
            token, length = last[at - 1]
            back.append(token)
            at -= length
        back.reverse()
        return back

    def _settle(self, state: int, last: list[tuple[int, int]], out: list[int]) -> list[tuple[int, int]]:
        """Emit the tokens that all live hypotheses share; the rest stays open."""
        n = len(last)
        ends = [n - read for _, _, read in self.hypotheses[state]]
        while len(set(ends)) > 1:  # walk the later ones back to the common boundary
            top = max(ends)
            ends = [e if e < top else e - last[e - 1][1] for e in ends]
        out.extend(self._trace(last, ends[0]))
        return last[ends[0] :]

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text, without special tokens; of null as of an empty text, none."""
        out: list[int] = []
        if not text:
            return out
        pieces = self.pieces
        for piece in self.split(text):
            ids = pieces.get(piece)
            if ids is None:
                raw = piece.encode("utf-8")
                ids = tuple(self.encode_piece(raw))
                if len(raw) <= LONG_PIECE:
                    if len(pieces) >= MAX_PIECES:
                        pieces.clear()
                    pieces[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        """The text of token ids, through the incremental machine below."""
        machine = Utf8Machine()
        return "".join(machine.feed(self.tokens[i]) for i in ids) + machine.close()


class Utf8Machine:
    """Incremental UTF-8 decoding: bytes go in as tokens arrive, complete characters come out.

    States: how many continuation bytes are missing and the range the next one must lie in. Bytes that
    cannot continue give U+FFFD, one per longest valid beginning, as the Unicode standard recommends.
    """

    def __init__(self):
        self.missing, self.low, self.high, self.code = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.missing and not self.low <= byte <= self.high:
                out.append("�")
                self.missing = 0
            if self.missing:
                self.code, self.missing, self.low, self.high = self.code << 6 | byte & 0x3F, self.missing - 1, 0x80, 0xBF
                if not self.missing:
                    out.append(chr(self.code))
            elif byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self.missing, self.code = 1, byte & 0x1F
            elif 0xE0 <= byte <= 0xEF:
                self.missing, self.code = 2, byte & 0x0F
                self.low, self.high = (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF)
            elif 0xF0 <= byte <= 0xF4:
                self.missing, self.code = 3, byte & 0x07
                self.low, self.high = (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF)
            else:
                out.append("�")
            if not self.missing:
                self.low, self.high = 0x80, 0xBF
        return "".join(out)

    def close(self) -> str:
        """What an unfinished character at the end becomes."""
        left, self.missing, self.low, self.high = self.missing, 0, 0x80, 0xBF
        return "�" if left else ""
