"""Token ids in packed fixed-length rows: best-fit-decreasing with a segment tree over remaining capacity."""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microflow.llm.common import col, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public 50k byte-level vocabulary cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker keeps in each of two generations, some 30 MB.
CACHED = 150_000
_tokenizers: dict = {}


class _Words(dict):
    """Ids (as bytes) of what stands between two single spaces, with `before` in front of it.

    The pattern never joins text across a lone space between two other characters, so such pieces can be encoded
    apart. A piece that begins or ends with white space has no entry of its own: None. When the table is full it
    becomes the older generation, from which words that come again are taken over, so frequent ones stay.
    """

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before, self.older = encode, before, {}

    def __missing__(self, piece: str):
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        if piece in self.older:
            out = self.older[piece]
        else:
            odd = not piece or piece[0].isspace() or piece[-1].isspace()
            out = None if odd else array("I", self.encode(self.before + piece)).tobytes()
        self[piece] = out
        return out


class Tokenizer:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = len(ranks)
        self.model = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.rest = _Words(self.model.encode_ordinary, ""), _Words(self.model.encode_ordinary, " ")

    def __call__(self, text: str) -> np.ndarray:
        """Ids of a text, then the end id."""
        pieces = text.split(" ")
        try:
            ids = np.frombuffer(self.first[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:])), np.uint32)
        except TypeError:  # white space of other kinds
            ids = np.array(self.model.encode_ordinary(text), np.uint32)
        return np.append(ids, np.uint32(self.end))

    @staticmethod
    def of(path: str) -> Tokenizer:
        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer(path)
        return _tokenizers[path]


class Capacities:
    """Open rows by remaining capacity; a segment tree finds the smallest capacity that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.some = [0] * (2 * self.leaves)  # open rows below each node
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int, by: int = 1) -> None:
        if by > 0:
            self.rows[capacity].append(row)
        at = self.leaves + capacity
        while at:
            self.some[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row of the smallest capacity that is `need` at least."""
        at = self.leaves + need
        while not self.some[at]:
            while at & 1:  # a right child: up, until there is a right neighbour
                at >>= 1
            if not at:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the last leaf of this level
                return None
        while at < self.leaves:
            at *= 2
            at += not self.some[at]
        capacity = at - self.leaves
        row = self.rows[capacity].pop()
        self.add(capacity, row, -1)
        return capacity, row


def best_fit_decreasing(lengths, capacity: int) -> list[list[int]]:
    """Items of each row: longest items first, each into the fullest row that still holds it."""
    open_, rows = Capacities(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_.take(lengths[i])
        left, row = found or (capacity, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(i)
        open_.add(left - lengths[i], row)
    return rows


SCHEMA = "task int, pool int, row int, n_tokens int, input_ids binary, cu_seqlens array<int>, doc_ids array<{}>, doc_offsets array<long>, position_starts array<int>"


def pack(docs: DataFrame, seq_len: int = 2048, pool_tokens: int = 4_000_000, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each packed sequence of seq_len ids.

    input_ids: little-endian uint16 (uint32 for a larger vocabulary), filled up with the end id after n_tokens.
    cu_seqlens: 0 and the end of each segment. doc_ids: each segment's document. doc_offsets: its first token's place
    in the document. position_starts: the position number of each segment's first token, always 0: positions begin anew.
    (task, pool, row) names the sequence: input partition, pool of about pool_tokens ids within it, row of that pool.

    Every document ends with the end id, so a null or empty text is a segment of that id alone. Documents longer than
    seq_len are cut into whole rows and a rest, without loss. Nothing is shuffled: a task packs pool after pool of its
    own rows, so memory is bounded whatever the input's skew. Other columns are ignored. No rows give no rows.
    """
    base = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        encode, context = Tokenizer.of(tokenizer), TaskContext.get()
        kind = np.uint16 if encode.end < 1 << 16 else np.uint32
        task, pools, segments, size = context.partitionId() if context else 0, 0, [], 0

        def emit():
            nonlocal pools, segments, size
            rows = best_fit_decreasing([len(s[2]) for s in segments], seq_len)
            for at in range(0, len(rows), 2000):
                part = rows[at : at + 2000]
                ids, cu = [], []
                for items in part:
                    line = np.full(seq_len, encode.end, kind)
                    ends = [0]
                    for i in items:
                        line[ends[-1] : ends[-1] + len(segments[i][2])] = segments[i][2]
                        ends.append(ends[-1] + len(segments[i][2]))
                    ids.append(line.tobytes())
                    cu.append(ends)
                n = len(part)
                cols = [pa.array([task] * n, pa.int32()), pa.array([pools] * n, pa.int32()), pa.array(range(at, at + n), pa.int32()), pa.array([c[-1] for c in cu], pa.int32()), pa.array(ids, pa.binary()), pa.array(cu, pa.list_(pa.int32())), pa.array([[segments[i][0] for i in items] for items in part], pa.list_(id_type)), pa.array([[segments[i][1] for i in items] for items in part], pa.list_(pa.int64())), pa.array([[0] * len(items) for items in part], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["task", "pool", "row", "n_tokens", "input_ids", "cu_seqlens", "doc_ids", "doc_offsets", "position_starts"])
            pools, segments, size = pools + 1, [], 0

        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py()).astype(kind)
                for start in range(0, len(ids), seq_len):
                    segments.append((key, start, ids[start : start + seq_len]))
                size += len(ids)
                if size >= pool_tokens:
                    yield from emit()
        if segments:
            yield from emit()

    return base.mapInArrow(run, SCHEMA.format(base.schema["id"].dataType.simpleString()))


def op9_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
