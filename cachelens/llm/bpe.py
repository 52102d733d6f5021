"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A match of the split pattern is cut in halves recursively; two neighbouring
encodings are joined by re-encoding a window around their boundary, which
grows until both of its edges are stable. A boundary between tokens x, y is
stable when the greedy merge of their bytes gives [x, y] again. A token
sequence whose every boundary is stable is the greedy encoding of its bytes:
the first merge that crossed a boundary in the whole would be the first to
cross it in the pair as well. Decoding concatenates halves up the same tree.

Defined results: a null text counts as empty and gives no ids; lone matches
that are tokens give that token; of merges of equal rank the leftmost comes first; text of any
length is encoded whole; repeated rows and keys give a row each; columns beside key and text are
not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import for_workers

#: Bytes up to which a piece is merged without cutting it.
LEAF = 24
#: Entries after which a memo starts anew.
MEMO = 600_000
# Python's \s also takes U+001C to U+001F; this is Unicode's White_Space, as the rank files' library has it.
_SPACE = r"\t-\r \x85\xa0  -     　"


def split_pattern(pattern: str):
    inner = pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    return regex.compile(inner)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, split_pattern(pattern)
        self.token = {v: k for k, v in ranks.items()}
        self._stable: dict[tuple[bytes, bytes], bool] = {}
        self._packed = _Packed(self)

    # -- the monoid --------------------------------------------------------
    def merge(self, piece: bytes) -> list[bytes]:
        """Greedy merges of lowest rank, leftmost first."""
        if len(piece) > 2 * LEAF:
            return self._merge_long(piece)
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_long(self, piece: bytes) -> list[bytes]:
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # a live part runs from its index to end[index]
        before, live = list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not (live[i] and end[i] == mid and mid < n and live[mid] and end[mid] == stop):
                continue
            live[mid], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(piece[i : end[i]])
            i = end[i]
        return out

    def stable(self, x: bytes, y: bytes) -> bool:
        got = self._stable.get((x, y))
        if got is None:
            if len(self._stable) > MEMO:
                self._stable.clear()
            got = self._stable[x, y] = self.merge(x + y) == [x, y]
        return got

    def join(self, a: list[bytes], b: list[bytes]) -> list[bytes]:
        if not a or not b or self.stable(a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            mid = self.merge(b"".join(a[-i:]) + b"".join(b[:j]))
            left = i >= len(a) or self.stable(a[-i - 1], mid[0])
            right = j >= len(b) or self.stable(mid[-1], b[j])
            if left and right:
                return a[: len(a) - i] + mid + b[j:]
            i = i if left else min(len(a), 2 * i)
            j = j if right else min(len(b), 2 * j)

    def tree(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF:
            return self.merge(piece)
        mid = len(piece) // 2
        return self.join(self.tree(piece[:mid]), self.tree(piece[mid:]))

    # -- whole texts -------------------------------------------------------
    def piece_ids(self, match: str) -> list[int]:
        piece = match.encode()
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else [self.ranks[t] for t in self.tree(piece)]

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._packed.__getitem__, self.split.findall(text)))

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.encode_packed(text)).cast("I"))

    def decode(self, ids: Iterable[int]) -> bytes:
        ids, token = list(ids), self.token
        level = [b"".join([token[i] for i in ids[k : k + 1024]]) for k in range(0, len(ids), 1024)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


class _Packed(dict):
    """match -> its packed ids."""

    def __init__(self, bpe: TreeBpe):
        self.bpe = bpe

    def __missing__(self, match: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in self.bpe.piece_ids(match))
        if len(match) <= 64:
            if len(self) > MEMO:
                self.clear()
            self[match] = ids
        return ids


_LOADED: dict[tuple[str, str], TreeBpe] = {}


def loaded(path: str, pattern: str) -> TreeBpe:
    """One encoder for each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = TreeBpe(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode_column(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 (and the ids with ids=True) of each row; rows and their order stay, without a shuffle."""
    for_workers(df.sparkSession)
    src = df.select(df[key].alias("k"), df[text].cast("string").alias("t"))
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks_path, pattern)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t in b.column(1):
                packed = bpe.encode_packed(t.as_py() or "")
                n = memoryview(packed).cast("I")
                out[0].append(len(n))
                out[1].append(hashlib.sha256(packed).hexdigest())
                out[2].append(hashlib.sha256(bpe.decode(n)).hexdigest())
                if ids:
                    out[3].append(n.tolist())
            cols = [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols.append(pa.array(out[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return src.mapInArrow(run, schema)
