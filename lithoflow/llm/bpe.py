"""Byte-level BPE as a monoid: encodings of halves are joined at their boundary; decoding joins up the same kind of tree."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain, islice

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lithoflow.llm.common import Memo, map_texts, table

#: Bytes up to which a substring's encoding is remembered; halves are taken above that.
LEAF = 6
#: Entries of a memo of pairs or substrings, which is emptied when full, and of the two halves of a memo of words.
MEMO, WORDS = 250_000, 300_000
#: Texts of more code points are split into words piece by piece.
STREAM = 1 << 20
#: Ids that one leaf of a decoding tree holds.
DECODE_LEAF = 1024


class MonoidBPE:
    """Encodes single words by the ranks of a vocabulary whose tokens are all reachable by its merges.

    A token list is the encoding of its bytes if and only if each two neighbours are that of theirs. So two encodings
    joined are right as soon as the pairs at both edges of the window that was encoded anew are.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes_of[v] = k
        self._small: dict[bytes, tuple[int, ...]] = {}
        self._pair: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """By merging the adjacent pair of the lowest rank, leftmost first, until none is left: the definition."""
        ranks, n = self.ranks, len(data)
        if n == 1:
            return (ranks[data],)
        if n <= 32:
            parts = [data[i : i + 1] for i in range(n)]
            while len(parts) > 1:
                best, at = None, 0
                for i in range(len(parts) - 1):
                    r = ranks.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return tuple(map(ranks.__getitem__, parts))
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := ranks.get(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return tuple(ranks[data[i : end[i]]] for i in range(n) if alive[i])

    def stable(self, a: int, b: int) -> bool:
        known = self._pair.get((a, b))
        if known is None:
            if len(self._pair) >= MEMO:
                self._pair.clear()
            known = self._pair[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            ok_left = i == len(left) or self.stable(left[-i - 1], window[0])
            ok_right = j == len(right) or self.stable(window[-1], right[j])
            if ok_left and ok_right:
                return left[:-i] + window + right[j:]
            i = i if ok_left else min(len(left), 2 * i)
            j = j if ok_right else min(len(right), 2 * j)

    def encode(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= LEAF:
            if not data:
                return ()
            known = self._small.get(data)
            if known is None:
                if len(self._small) >= MEMO:
                    self._small.clear()
                known = self._small[data] = self.merge(data) if len(data) <= 2 else self.join(self.encode(data[: len(data) // 2]), self.encode(data[len(data) // 2 :]))
            return known
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def encode_word(self, data: bytes) -> tuple[int, ...]:
        """A word that is a token is that token, as in the library."""
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.encode(data)

    def decode(self, ids: list[int]) -> bytes:
        level = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + DECODE_LEAF])) for i in range(0, len(ids), DECODE_LEAF)] or [b""]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _codec(path: str) -> MonoidBPE:
    return MonoidBPE(read_ranks(path))


@lru_cache(2)
def _memo(path: str) -> Memo:
    """Words to their ids and those in decimals."""
    return Memo(WORDS)


#: Fixed: the word pattern for which texts of plain characters have a faster equal.
GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters beyond ASCII that count as plain: all from U+00C0 to U+024F but the signs of multiplication and division.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")


class Words:
    """Splits texts into a pattern's matches."""

    def __init__(self, pattern: str):
        import regex

        self.pattern, self.known = regex.compile(pattern), pattern == GPT2_PATTERN

    def parts(self, text: str):
        """The matches in lists of bounded length."""
        pattern = _PLAIN if self.known and not _NOT_PLAIN.search(text) else self.pattern
        if len(text) <= STREAM:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while part := list(islice(found, STREAM // 4)):
            yield part


def encode_words(codec: MonoidBPE, memo: Memo, words: list[str]) -> list[tuple[tuple[int, ...], str]]:
    def make(new: list[str]):
        return [(ids, " ".join(map(str, ids))) for ids in (codec.encode_word(w.encode()) for w in new)]

    known = memo.fill(set(words), make)
    return [known[w] for w in words]


def coder(path: str, pattern: str, with_ids: bool = False):
    codec, memo, words = _codec(path), _memo(path), Words(pattern)

    def one(text: bytes | None):
        n, ids_hash, back_hash, all_ids, first = 0, hashlib.sha256(), hashlib.sha256(), [], True
        for part in words.parts((text or b"").decode("utf-8", "replace")):
            found = encode_words(codec, memo, part)
            ids = list(chain.from_iterable(x[0] for x in found))
            if ids:
                ids_hash.update((("" if first else " ") + " ".join([x[1] for x in found])).encode())
                first = False
            back_hash.update(codec.decode(ids))
            n += len(ids)
            if with_ids:
                all_ids += ids
        return (n, ids_hash.hexdigest(), back_hash.hexdigest(), *([all_ids] if with_ids else []))

    return lambda texts: list(map(list, zip(*map(one, texts), strict=True))) if texts else [[]] * (3 + with_ids)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """keep's columns, n_tokens, ids_sha256, decoded_sha256 and (with_ids) ids, for whole texts, without special tokens.

    Null texts are empty: no ids. Texts of any length are split into words by pattern piece by piece; repeated rows are
    encoded one by one; columns that are not kept don't matter, whatever their names. ids_sha256 is of the decimals
    joined by blanks, decoded_sha256 of the bytes that the ids decode to.
    """
    new = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    keep = [c for c in docs.columns if c not in new] if keep is None else keep
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    fields += [("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    return map_texts(docs, text, keep, fields, lambda: coder(path, pattern, with_ids))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """encoded with the bytes of its ids as column out (null ids: null), joined up a tree."""
    from pyspark.sql import functions as F

    def back(column):
        import pandas as pd

        codec = _codec(path)
        return pd.Series([None if x is None else codec.decode(list(x)) for x in column])

    return encoded.withColumn(out, F.pandas_udf(back, "binary")(F.col(f"`{ids}`")))


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=["doc_id"], with_ids=False)
