"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of bytes there is exactly one token that can end its encoding: a token ``t`` that ends there and
stands validly behind the last token of the prefix before it. Two neighbours are valid if the merges of their joined
bytes give just these two again. Storing that last token per prefix makes the encoding of every prefix known: bytes can be
appended without touching what is there, and after an edit only the prefixes near it are computed anew.

A text is cut into pieces by a pattern first; the encoding of a piece does not depend on its neighbours, so pieces are
remembered, up to ``REMEMBERED`` of them in a task.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 1 << 19
LONGEST_REMEMBERED = 40
MOST_VOCABULARY = 64 << 20
AT_ONCE = 1 << 16

# fixed values: code points that are letters or numbers to the pattern library, but not yet to the tokenizer library, whose
# tables are of an earlier version of Unicode
NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


def read_ranks(path: str) -> bytes:
    """The content of a rank file (base64 token and rank on each line); at most ``MOST_VOCABULARY`` bytes."""
    with open(path, "rb") as f:
        content = f.read(MOST_VOCABULARY + 1)
    if len(content) > MOST_VOCABULARY:
        raise ValueError(f"a vocabulary has at most {MOST_VOCABULARY} bytes")
    return content


class Encoder:
    """Encodes pieces of bytes by the ranks of a vocabulary."""

    def __init__(self, content: bytes):
        rows = [line.split() for line in content.splitlines() if line]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.parts = lru_cache(1 << 17)(self._parts)
        self.pair = lru_cache(1 << 20)(self._pair)
        # tokens by their bytes from the last to the first; a token's rank stands under -1
        self.endings: dict = {}
        for token, rank in self.ranks.items():
            node = self.endings
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank

    def merged(self, piece: bytes, below: float = float("inf")) -> list[int]:
        """The merges as defined, of ranks ``below`` a limit: always the neighbours of the lowest rank, the first of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [self.ranks.get(a + b, -1) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranked if 0 <= r < below), default=-1)
            if best < 0:
                break
            at = ranked.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a byte; the token itself twice if no merges give it."""
        if len(self.tokens[token]) == 1:
            return None
        parts = self.merged(self.tokens[token], token)
        return tuple(parts) if len(parts) == 2 else (token, token)

    def reachable(self, token: int) -> bool:
        return self.parts(token) != (token, token)

    def _pair(self, a: int, b: int) -> bool:
        """Whether no merge ever joins the two: they are taken apart again, the one merged last first.

        While two tokens touch at the border, their own merge comes first if its rank is below that of the merge that ended
        their being neighbours; of equal ranks the one further left.
        """
        until = float("inf")
        if not (self.reachable(a) and self.reachable(b)):
            return False
        while True:
            across = self.ranks.get(self.tokens[a] + self.tokens[b])
            if across is not None and across < until:
                return False
            left, right = self.parts(a), self.parts(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                until, a = a, left[1]
            else:
                until, b = b + 1, right[0]

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """The last token of each prefix of ``piece``; ``last`` has those of the shorter prefixes that are known."""
        last = list(last)
        for end in range(len(last), len(piece)):
            last.append(self.last_token(piece, end, last))
        return last

    def last_token(self, piece: bytes, end: int, last: list[int]) -> int:
        """The token that ends the encoding up to and with the byte at ``end``; the longest fits as a rule."""
        node, at, found = self.endings, end, []
        while at >= 0 and (node := node.get(piece[at])) is not None:
            if -1 in node:
                found.append(node[-1])
            at -= 1
        pair, tokens = self.pair, self.tokens
        while found:
            token = found.pop()
            start = end - len(tokens[token])
            if pair(last[start], token) if start >= 0 else self.reachable(token):
                return token
        raise ValueError("no token can end this prefix")

    def tokens_of(self, last: list[int]) -> list[int]:
        """The encoding of a piece from the last tokens of its prefixes."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece; one that is a token as a whole is that token."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tokens_of(self.extend(piece, []))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Piece:
    """A piece that can be appended to and edited; ``last`` has each prefix's last token."""

    def __init__(self, encoder: Encoder, piece: bytes = b""):
        self.encoder, self.bytes, self.last = encoder, piece, encoder.extend(piece, [])

    def ids(self) -> list[int]:
        whole = self.encoder.ranks.get(self.bytes)
        return [whole] if whole is not None else self.encoder.tokens_of(self.last)

    def append(self, more: bytes) -> None:
        self.bytes += more
        self.last = self.encoder.extend(self.bytes, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes from ``start`` to ``end``; returns how many prefixes were computed anew.

        A last token depends on the bytes and last tokens of ``longest`` places before it. Once that many in a row behind
        the edit are as before, so are all the others.
        """
        old, shift = self.last, len(new) - (end - start)
        self.bytes = self.bytes[:start] + new + self.bytes[end:]
        last, same, done = old[:start], 0, 0
        for at in range(start + 1, len(self.bytes) + 1):
            last.append(self.encoder.last_token(self.bytes, at - 1, last))
            done += 1
            same = same + 1 if at > start + len(new) and last[-1] == old[at - 1 - shift] else 0
            if same >= self.encoder.longest:
                last += old[at - shift :]
                break
        self.last = last
        return done


class _Memory(dict):
    """Ids of pieces seen before."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encoder.encode(piece.encode())
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


# what the tokenizer library's classes are for ASCII and the Latin letters from U+00C0 to U+024F; U+00D7 and U+00F7 are none
_PLAIN = {r"\p{L}": "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F", r"\p{N}": "0-9", r"\s": r"\t-\r "}
_UNPLAIN = re.compile("[^\0-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]")


def _plain(pattern: str) -> re.Pattern | None:
    """The pattern for texts of those characters alone; None if it uses anything that is not in ``_PLAIN``."""

    def inside(text: str) -> str:
        for name, members in _PLAIN.items():
            text = text.replace(name, members)
        return text

    def outside(text: str) -> str:
        for name, members in _PLAIN.items():
            text = text.replace(name, f"[{members}]")
        return text.replace(r"\S", f"[^{_PLAIN[chr(92) + 's']}]")

    parts = re.split(r"(\[(?:\\.|[^\]\\])*\])", pattern)
    plain = "".join(inside(p) if k % 2 else outside(p) for k, p in enumerate(parts))
    return None if re.search(r"\\[^tr]", plain) else re.compile(plain)


class Cutter:
    """A pattern by the tokenizer library's tables: newer letters and numbers are neither."""

    def __init__(self, pattern: str):
        newer = "[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split()) + "]"
        self.plain = _plain(pattern)
        self.newer = regex.compile(newer)
        self.usual = regex.compile(pattern)
        for name in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(name, f"[{name}--{newer}]")
        self.careful = regex.compile(pattern, regex.V1)

    def of(self, text: str) -> re.Pattern | regex.Pattern:
        if self.plain and not _UNPLAIN.search(text):
            return self.plain
        return self.careful if self.newer.search(text) else self.usual


def text_ids(memory: _Memory, cutter: Cutter, text: str) -> Iterator[list[int]]:
    """The ids of a text, in runs of bounded length."""
    pattern = cutter.of(text)
    if len(text) <= AT_ONCE:
        yield list(chain.from_iterable(map(memory.__getitem__, pattern.findall(text))))
        return
    pieces = (m[0] for m in pattern.finditer(text))
    while some := list(islice(pieces, AT_ONCE)):
        yield list(chain.from_iterable(map(memory.__getitem__, some)))


@lru_cache(1)
def _known(content: bytes, pattern: str) -> tuple[_Memory, Cutter]:
    return _Memory(Encoder(content)), Cutter(pattern)


def _tools(content, pattern: str) -> tuple[_Memory, Cutter]:
    """The encoder of a worker process; what it remembers serves its later tasks too."""
    return _known(content.value, pattern)


def _id_rows(content, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, cut = _tools(content, pattern)
        for batch in batches:
            for rows in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                ids = [list(chain.from_iterable(text_ids(memory, cut, t or ""))) for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("rest"), pa.array(ids, pa.list_(pa.int32()))], ["rest", "ids"])

    return run


def _text_rows(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tools(content, "")[0].encoder
        for batch in batches:
            for rows in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                texts = [encoder.decode(ids or []) for ids in rows.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("rest"), pa.array(texts, pa.binary())], ["rest", "bytes"])

    return run


def _digest_rows(content, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, cut = _tools(content, pattern)
        names = {i: str(i) for i in memory.encoder.tokens}
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column("text"):
                count, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
                for ids in text_ids(memory, cut, text.as_py() or ""):
                    ids_hash.update((("," if count and ids else "") + ",".join(map(names.__getitem__, ids))).encode())
                    bytes_hash.update(memory.encoder.decode(ids))
                    count += len(ids)
                counts.append(count)
                of_ids.append(ids_hash.hexdigest())
                of_bytes.append(bytes_hash.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _shared(df: DataFrame, path: str):
    """The vocabulary on every executor; its size is bounded by ``read_ranks``."""
    return df.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of ``text`` by the rank file at ``path`` in a column ``ids``; all others are carried.

    Null and empty texts have no ids. Special tokens are ordinary text. A column of the name ``ids`` is replaced.
    """
    others = [c for c in docs.columns if c.lower() != ids.lower()]
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"))
    out = rows.mapInArrow(_id_rows(_shared(docs, path), pattern), f"rest {rows.schema['rest'].dataType.simpleString()}, ids array<int>")
    return out.select("rest.*", F.col("ids").alias(ids))


def decode(rows: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of the ids in a column ``to``; null ids give no bytes."""
    others = [c for c in rows.columns if c.lower() != to.lower()]
    packed = rows.select(F.col(ids).alias("ids"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"))
    out = packed.mapInArrow(_text_rows(_shared(rows, path)), f"rest {packed.schema['rest'].dataType.simpleString()}, bytes binary")
    return out.select("rest.*", F.col("bytes").alias(to))


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each text: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    One row for each row of ``docs``, repeated rows included; a null text counts as empty. A long text is handled in runs of
    pieces. Columns other than doc_id and text are not read.
    """
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(_digest_rows(_shared(docs, path), pattern), kind)
