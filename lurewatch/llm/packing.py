"""Tokenised documents packed into sequences of bounded length by the sum-of-squares rule."""

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from lurewatch.session import materialise

SEQUENCE = 1024
END_ID = 2
#: Pieces that one task packs. More tasks leave a few more sequences open at their end.
GROUP_ROWS = 100_000
# Fixed value: the pre-token pattern of this family of vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The pattern's look-ahead makes ``tiktoken`` back up over a whole run of white space, and its stack ends with runs of
# several 100,000. Texts with a run of this length go to the file's own tokenizer.
LONG_SPACE = 10_000
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)


class Tokens:
    """Token ids of whole texts as little-endian bytes.

    The vocabulary comes from a byte-level BPE file of the ``tokenizers`` library. Its ids are also the ranks
    of its merges, so ``tiktoken`` gives the same ids from it at several times the speed; texts that hold a
    special token, which the file's own tokenizer treats apart, or very long white space go to that tokenizer.
    """

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            content = file.read()
        tokenizer = json.loads(content)
        self.special = [t["content"] for t in tokenizer["added_tokens"]]
        self.original = Tokenizer.from_str(content)
        byte_of = byte_alphabet()
        ranks = {
            bytes(map(byte_of.__getitem__, token)): rank
            for token, rank in tokenizer["model"]["vocab"].items() if token not in self.special
        }
        self.fast = tiktoken.Encoding("bpe", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text):
        if not text:
            return b""
        if any(s in text for s in self.special) or len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
            return np.array(self.original.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


def byte_alphabet():
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 characters stand for
    themselves, the other bytes for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


_loaded = {}


def tokens_of(path):
    """The tokenizer of this worker."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def cut_points(n, limit=SEQUENCE):
    """(start, length) of the pieces of ``n`` tokens: full ones, after a first one that takes the rest."""
    first = n % limit or min(n, limit)
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)]


def _cutter(path, limit, end_id):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids_of = tokens_of(path)
        for batch in batches:
            docs, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                ids = ids_of(text) + end
                for k, (s, n) in enumerate(cut_points(len(ids) // 4, limit)):
                    docs.append(i), piece.append(k), start.append(s), length.append(n)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(docs, tokenizer, ids="doc_id", text="text", limit=SEQUENCE, end_id=END_ID):
    """(doc_id, piece, start, length, ids_crc32) of the documents cut to at most ``limit`` tokens."""
    rows = docs.select(F.col(ids).alias("doc_id"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _cutter(tokenizer, limit, end_id),
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint",
    )


def sum_of_squares(lengths, limit=SEQUENCE):
    """(bin, offset) of each item, placed one after the other, longest first.

    ``open[g]`` counts the bins with ``g`` places left. An item of length ``n`` goes to a bin with gap ``g``,
    or to a new one, such that the sum of the squared counts over all gaps below ``limit`` becomes smallest;
    full bins do not count. Ties go to the smallest gap. Moving a bin from gap g to g - n changes the sum by
    2 (open[g - n] - open[g]) + 2, filling it by 1 - 2 open[n], and a new bin by 2 open[limit - n] + 1.
    A new bin is only taken if no open one has room: the aim is the fewest bins, not an even stream.
    """
    lengths = np.asarray(lengths, np.int64)
    n_open = np.zeros(limit + 1, np.int64)
    stacks = [[] for _ in range(limit + 1)]
    bins, offsets, n_bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        gap = 0
        if n < limit:
            room = n_open[n:limit]
            change = 2 * (n_open[: limit - n] - room) + 2
            change[0] = 1 - 2 * room[0]
            change[room == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            gap = n + best if room[best] else 0
        if gap:
            b = stacks[gap].pop()
            n_open[gap] -= 1
        else:
            b, gap = n_bins, limit
            n_bins += 1
        bins[i], offsets[i] = b, limit - gap
        if gap > n:
            stacks[gap - n].append(b)
            n_open[gap - n] += 1
    return bins, offsets


def _packer(limit):
    def run(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), limit)
        first = TaskContext.get().partitionId() << 40
        table = table.append_column("sequence_id", pa.array(bins + first, pa.int64()))
        yield from table.append_column("offset", pa.array(offsets, pa.int64())).to_batches(10_000)

    return run


def pack(pieces, limit=SEQUENCE, group_rows=GROUP_ROWS):
    """``pieces`` (a table with ``length``) with ``sequence_id`` and ``offset``: sequences of at most ``limit``.

    Pieces are dealt out evenly, whatever their keys, into groups of about ``group_rows``, and each group is
    packed by itself, so memory and time of a task are bounded at any size. Ids are unique over all groups.
    """
    groups = max(1, -(-pieces.count() // group_rows))
    return pieces.repartition(groups).mapInArrow(
        _packer(limit), StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    )


def pack_documents(docs, tokenizer, ids="doc_id", text="text", limit=SEQUENCE, end_id=END_ID, group_rows=GROUP_ROWS):
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its token ids and ``end_id``; null and empty texts are ``end_id`` alone. Only documents of
    more than ``limit`` ids are cut; their first piece may be shorter, all others fill a sequence. Rows that
    repeat an id, also a null one, are documents of their own. No rows, no result rows. Other columns are
    not looked at.

    Texts are tokenised in place, and only five numbers a piece are written to the shared folder and dealt
    out. Full sequences need no packing.
    """
    pieces = materialise(token_pieces(docs, tokenizer, ids, text, limit, end_id), "pieces")
    full = pieces.filter(F.col("length") == limit).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    return full.unionByName(pack(pieces.filter(F.col("length") < limit), limit, group_rows))
