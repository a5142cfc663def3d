"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

**Encoding.** Let two tokens be *compatible* when merging their joined bytes gives back just these two. A sequence of tokens
is the BPE encoding of its bytes exactly when all neighbours in it are compatible: the first merge across a boundary in the
whole text would also be made with the two neighbours alone. This is a transducer: a state says which token came last and
which bytes of the next one were read; reading on extends those bytes and, where they form a token compatible with the last
one, may emit it. Its transitions are worked out when first taken and kept, within a bound. It is made deterministic by
lookahead: the machine reads until no token goes on, which is at most the longest token, emits the furthest compatible
candidate, and falls back to a shorter one if that leads nowhere. Each prefix has one encoding only, so no position is entered twice: a
piece takes linear time, whatever its length.

**Decoding.** The bytes of a stream of ids run through a state machine for UTF-8 that keeps at most three pending bytes.
Ill-formed bytes become U+FFFD, one per maximal ill-formed part. The bytes themselves are recovered exactly.

Cases: NULL and empty texts give no ids and no bytes; repeated rows and ties need no care; an empty table gives an empty
table; texts and pieces of any length are encoded whole, in linear time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .batches import map_texts
from .bounded import Memo, held
from .pieces import Pieces

MEMO_PIECES = 200_000
MEMO_TRANSITIONS = 500_000
NONE = 0xFFFFF  # no token yet
NEVER = 1 << 60


def load_ranks(lines: bytes) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


def merge(raw: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: merge the lowest-ranked adjacent pair, leftmost first, while there is one."""
    parts = [raw[i:i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == NEVER:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Transducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]):
        self._ranks, self._bytes_of = ranks, {r: b for b, r in ranks.items()}
        self._length = {r: len(b) for b, r in ranks.items()}
        self._longest = max(map(len, ranks), default=0)
        self._child: dict[int, int] = {}  # the trie of the tokens: node and byte to node
        self._token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                at = node << 8 | byte
                node = self._child.get(at)
                if node is None:
                    node = self._child[at] = len(self._token_at)
                    self._token_at.append(-1)
            self._token_at[node] = rank
        self._histories = Memo(self._history, 60_000)
        self._fits = Memo(self._compatible, MEMO_TRANSITIONS)

    def _history(self, token: int) -> tuple[bool, tuple, tuple]:
        """Of merging a token's own bytes: whether they give the token, and after each merge (its rank, the symbol now at
        the right end) and (its rank, the symbol now at the left end)."""
        raw, ranks = self._bytes_of[token], self._ranks
        parts = [raw[i:i + 1] for i in range(len(raw))]
        at_right, at_left = [(-1, parts[-1])], [(-1, parts[0])]
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            at_right.append((rank, parts[-1]))
            at_left.append((rank, parts[0]))
        return len(parts) == 1, (*at_right, (NEVER, b"")), (*at_left, (NEVER, b""))

    def _compatible(self, pair: int) -> bool:
        """Whether the merges within two neighbours run to their end before one across the boundary is due."""
        left, right = pair >> 20, pair & 0xFFFFF
        whole, _, starts = self._histories[right]
        if not whole or left == NONE:
            return whole
        ends, ranks = self._histories[left][1], self._ranks
        i = j = 0
        while True:
            due_left, due_right = ends[i + 1][0], starts[j + 1][0]
            across = ranks.get(ends[i][1] + starts[j][1], NEVER)
            if across < due_left and across <= due_right:
                return False
            if due_left == NEVER and due_right == NEVER:
                return True
            if due_left <= due_right:
                i += 1
            else:
                j += 1

    def encode(self, piece: bytes) -> list[int]:
        child, token_at, fits, length, longest = self._child.get, self._token_at, self._fits, self._length, self._longest
        out: list[int] = []
        left: list[list[int]] = []  # for each token in out, the shorter ones that could stand in its place
        at, n, last = 0, len(piece), NONE
        while at < n:
            node, found = 0, []
            for byte in piece[at:at + longest]:
                node = child(node << 8 | byte)
                if node is None:
                    break
                if token_at[node] >= 0:
                    found.append(token_at[node])
            while True:
                if found:
                    token = found.pop()
                    if fits[last << 20 | token]:
                        break
                else:
                    at -= length[out.pop()]
                    found = left.pop()
                    last = out[-1] if out else NONE
            out.append(token)
            left.append(found)
            at += length[token]
            last = token
        return out


class Utf8Machine:
    """Bytes in, in parts cut anywhere; characters out as soon as they are complete."""

    # Number of following bytes and range of the second byte, by first byte (the well-formed sequences of UTF-8).
    _NEED = {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)} | {b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)} | {
        b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)} | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF),
                                                          0xF4: (3, 0x80, 0x8F)}

    def __init__(self) -> None:
        self._pending, self._need, self._low, self._high = bytearray(), 0, 0x80, 0xBF

    @property
    def between_characters(self) -> bool:
        return not self._need

    def feed(self, raw: bytes) -> str:
        out = []
        for byte in raw:
            if self._need:
                if self._low <= byte <= self._high:
                    self._pending.append(byte)
                    self._need -= 1
                    self._low, self._high = 0x80, 0xBF
                    if not self._need:
                        out.append(self._pending.decode())
                        self._pending.clear()
                    continue
                out.append("�")
                self._pending.clear()
                self._need, self._low, self._high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in self._NEED:
                self._need, self._low, self._high = self._NEED[byte]
                self._pending.append(byte)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left = "�" if self._need else ""
        self._pending.clear()
        self._need = 0
        return left


class Codec:
    """Texts to ids and ids to texts by a vocabulary of ranks and a pattern of pieces. Ids are kept as decimals."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._pieces = Pieces(pattern).of
        self._transducer = Transducer(ranks)
        self._ids = Memo(lambda piece: ",".join(map(str, self._transducer.encode(piece.encode()))), MEMO_PIECES)
        self._bytes_of = {str(r): b for b, r in ranks.items()}
        self._whole: dict[str, str] = {}  # tokens of whole characters
        for token, rank in ranks.items():
            try:
                self._whole[str(rank)] = token.decode()
            except UnicodeDecodeError:
                pass

    def encode(self, text: str) -> str:
        """The ids in decimal, joined by commas."""
        ids = self._ids
        return ",".join([ids[p] for p in self._pieces(text)])

    def decode_stream(self, ids: list[str], chunk: int = 64) -> Iterator[tuple[bytes, str]]:
        """Bytes and characters of a stream of ids, chunk by chunk; the characters lag by at most three bytes."""
        machine, whole, bytes_of = Utf8Machine(), self._whole, self._bytes_of
        for at in range(0, len(ids), chunk):
            part = ids[at:at + chunk]
            try:
                if not machine.between_characters:
                    raise KeyError
                text = "".join([whole[i] for i in part])
                raw = text.encode()
            except KeyError:  # a character is cut somewhere: through the machine where it is
                raws, texts = [], []
                for i in part:
                    raws.append(bytes_of[i])
                    texts.append(whole[i] if machine.between_characters and i in whole else machine.feed(bytes_of[i]))
                raw, text = b"".join(raws), "".join(texts)
            yield raw, text
        rest = machine.close()
        if rest:
            yield b"", rest

    def decode(self, ids: list[str]) -> tuple[bytes, str]:
        parts = list(self.decode_stream(ids))
        return b"".join([p[0] for p in parts]), "".join([p[1] for p in parts])


def split_ids(joined: str) -> list[str]:
    return joined.split(",") if joined else []


def _codec(docs: DataFrame, vocabulary_path: str, pattern: str):
    """A maker of this worker's codec. The vocabulary file, of fixed size, is read on the driver and broadcast."""
    with open(vocabulary_path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    key = uuid.uuid4().hex
    return lambda: held(key, lambda: Codec(load_ranks(sent.value), pattern))


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids, decoded): the token ids of each text and the text decoded from them."""
    codec = _codec(docs, vocabulary_path, pattern)

    def per_slice(texts: list[str]) -> dict[str, list]:
        own = codec()
        ids = [split_ids(own.encode(t)) for t in texts]
        return {"n_tokens": list(map(len, ids)), "ids": [list(map(int, i)) for i in ids], "decoded": [own.decode(i)[1] for i in ids]}

    return map_texts(docs, id_col, text_col, "n_tokens bigint, ids array<int>, decoded string", per_slice)


def digest_documents(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): the same run, with digests in place of the long columns."""
    codec = _codec(docs, vocabulary_path, pattern)

    def per_slice(texts: list[str]) -> dict[str, list]:
        own, counts, encoded, decoded = codec(), [], [], []
        for text in texts:
            joined = own.encode(text)
            ids = split_ids(joined)
            counts.append(len(ids))
            encoded.append(hashlib.sha256(joined.encode()).hexdigest())
            decoded.append(hashlib.sha256(own.decode(ids)[0]).hexdigest())
        return {"n_tokens": counts, "ids_sha256": encoded, "decoded_sha256": decoded}

    return map_texts(docs, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", per_slice)
