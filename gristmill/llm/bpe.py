"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

A text is cut into pretokens by a fixed pattern; within a pretoken the merge list decides. The encoder
reads a pretoken's bytes from left to right and keeps, for each prefix, the last token of that prefix's
own encoding: the one token ending there that can stand behind the encoding before it. Two tokens can
stand side by side if their bytes together encode to just these two.

However a pretoken goes on, its encoding has a boundary within the last ``lookahead`` bytes, where
``lookahead`` is the byte length of the longest token that the merge list makes. So every token that
all the encodings of those prefixes share is stable: it is emitted and forgotten. Memory is bounded by
the lookahead, not by the text. Pretokens that were met before come from a table of bounded size.

Decoding maps ids to bytes and bytes to text through an incremental UTF-8 decoder, block by block.

Null texts count as empty and give no ids. Texts of any length are whole. Rows, ties, repeats and
extra columns pass through as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read

# The white space and the pretoken pattern of this vocabulary.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
WINDOW = 1 << 16
REMEMBER = 200_000
LONG = 64
RESULT = "ids binary, decoded string"


def byte_letters() -> dict[str, int]:
    """The vocabulary writes bytes as letters: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids: dict[bytes, int] = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[as_bytes(a), as_bytes(b)] = k
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.lookahead = max([1, *(len(a) + len(b) for a, b in self.rank)])
        self.text_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.beside: dict[tuple[int, int], bool] = {}
        self.merges = {(self.ids[a], self.ids[b]): k for (a, b), k in self.rank.items()}
        self.made = {i: (-1, i, i) for i in self.ids.values()}
        for (a, b), k in sorted(self.rank.items(), key=lambda x: -x[1]):
            if a + b in self.ids:
                self.made[self.ids[a + b]] = (k, self.ids[a], self.ids[b])
        self.reach = {t[:k]: -1 for t in self.ids for k in range(1, len(t))} | self.ids  # what tokens begin with
        self.first = {i for t, i in self.ids.items() if self.alone(t)}
        self.pretoken = regex.compile(PATTERN)
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known = _Known(self)

    def alone(self, token: bytes) -> bool:
        """Whether the merge list makes this token out of its own bytes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[at], parts[at + 1]) not in self.rank:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    def apart(self, left: int, token: int) -> bool:
        """Whether the merge list leaves the two tokens side by side: no merge across their border comes before the merges that made them."""
        merges, made, until = self.merges, self.made, 1 << 60
        while True:
            across = merges.get((left, token))
            if across is not None and across < until:
                return False
            a, b = made[left][0], made[token][0]  # bytes of the alphabet have rank -1
            if a < 0 and b < 0:
                return True
            # The younger token was two parts until its merge. Merges of one rank go from left to right.
            if a > b:
                until, left = a, made[left][2]
            else:
                until, token = b + 1, made[token][1]

    def run(self, pieces: Iterator[bytes]) -> Iterator[int]:
        """Ids of one pretoken that arrives in pieces, each emitted once no continuation can change it."""
        data, most, reach, beside = b"", self.lookahead, self.reach.get, self.beside
        last, size = [-1], [0]  # of the encoding of data[:i]: its last token and that token's bytes
        for piece in pieces:
            old = len(data)
            data += piece
            n = len(data)
            ending: list[list[tuple[int, int]]] = [[] for _ in range(n - old)]
            for j in range(max(0, old - most), n):
                k = j + 1
                while k <= n and (token := reach(data[j:k])) is not None:
                    if token >= 0 and k > old:
                        ending[k - old - 1].append((j, token))
                    k += 1
            for i in range(old + 1, n + 1):
                for j, token in ending[i - old - 1]:
                    left = last[j]
                    if left < 0:
                        ok = token in self.first
                    elif (ok := beside.get((left, token))) is None:
                        if len(beside) > REMEMBER:
                            beside.clear()
                        ok = beside[left, token] = self.apart(left, token)
                    if ok:
                        last.append(token)
                        size.append(i - j)
                        break
                else:
                    raise ValueError(f"no token for byte {data[i - 1]}")
            if len(data) > 4 * most and (stable := self._stable(size)):
                yield from self._back(last, size, stable)
                # The last stable token stays as the left neighbour of what follows.
                data, last, size = data[stable:], last[stable:], [0, *size[stable + 1 :]]
        yield from self._back(last, size, len(data))

    @staticmethod
    def _back(last: list[int], size: list[int], i: int) -> list[int]:
        out = []
        while i > 0:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def _stable(self, size: list[int]) -> int:
        """The last boundary that the encodings of all prefixes within the lookahead share."""
        end = len(size) - 1
        heads = set(range(max(1, end - self.lookahead + 1), end + 1))
        while len(heads) > 1:
            head = max(heads)
            heads.discard(head)
            heads.add(head - size[head])
        return heads.pop()

    def _long(self, text: str, start: int, end: int) -> bytes:
        pieces = (text[i : min(end, i + LONG)].encode() for i in range(start, end, LONG))
        return b"".join(i.to_bytes(4, "little") for i in self.run(pieces))

    def _plain(self, text: str, start: int, end: int) -> Iterator[bytes]:
        """Ids of text[start:end], which holds no special token. A pretoken that touches a window's end is read again with the next."""
        while start < end:
            stop = min(end, start + WINDOW)
            words = self.pretoken.findall(text, start, stop)
            if stop < end:
                # What ends at the window's end, and white space before it, may be cut otherwise by what follows.
                held = len(words[-1]) + (len(words[-2]) if len(words) > 1 else 0)
                if held >= stop - start:
                    match = self.pretoken.match(text, start, end)
                    yield self._long(text, start, match.end())
                    start = match.end()
                    continue
                words, stop = words[:-2], stop - held
            yield b"".join(map(self.known.__getitem__, words))
            start = stop

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out, start = [], 0
        for match in self.split.finditer(text) if self.split else ():
            out += self._plain(text, start, match.start())
            out.append(self.special[match[0]].to_bytes(4, "little"))
            start = match.end()
        out += self._plain(text, start, len(text))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        machine, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        block = 4 * WINDOW
        for i in range(0, len(ids), block):
            numbers = memoryview(ids)[i : i + block].cast("I")
            out.append(machine.decode(b"".join(map(self.text_of.__getitem__, numbers))))
        out.append(machine.decode(b"", True))
        return "".join(out)


class _Known(dict):
    """Pretoken -> ids. Of two generations; when the younger is full, the older one is forgotten."""

    def __init__(self, owner: Transducer):
        super().__init__()
        self.owner, self.older = owner, {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > 4 * LONG:
            return self.owner._long(word, 0, len(word))
        if len(self) >= REMEMBER:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = b"".join(i.to_bytes(4, "little") for i in self.owner.run((word.encode(),)))
        self[word] = ids
        return ids


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encode_decode(path: str | None):
    @F.pandas_udf(RESULT)
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = transducer(path or default_path())
        for texts in batches:
            ids = [t.encode(x) for x in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [t.decode(x) for x in ids]})

    return both


def round_trip(text: Column, path: str | None = None) -> Column:
    """struct(ids: little-endian unsigned 32-bit integers, decoded: the text that they give back)."""
    return _encode_decode(path)(F.coalesce(text, F.lit("")))


def encode(text: Column, path: str | None = None) -> Column:
    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(path or default_path())
        for texts in batches:
            yield pd.Series([t.encode(x) for x in texts], dtype=object)

    return ids(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str | None = None) -> Column:
    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(path or default_path())
        for block in batches:
            yield pd.Series([t.decode(x or b"") for x in block], dtype=object)

    return texts(ids)


def bpe_digests(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    coded = bounded_batches(docs).select(F.col(id), round_trip(F.col(text), path).alias("_bpe"))
    return coded.select(
        id,
        F.expr("cast(octet_length(_bpe.ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2(F.col("_bpe.ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("_bpe.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents", "doc_id", "text"))
