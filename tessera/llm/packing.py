"""Variable-capacity best-fit packing of documents' token ids into training sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranked
from .segments import give_back
from .store import binary_text, bounded_batches, written

#: Permitted sequence lengths, ascending.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence of c tokens: per sequence, per token, per squared token.
COST = (64.0, 1.0, 1 / 65536)
#: Documents and bytes of text (a token has one at least) that one task packs together, on average.
SHARD, SHARD_BYTES = 1 << 15, 1 << 25
#: Tokens of the sequences that are handed over at once.
OUT_TOKENS = 1 << 20


def cost(c: int, weights: tuple[float, float, float] = COST) -> float:
    return weights[0] + weights[1] * c + weights[2] * c * c


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, weights=COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, and each bin's final capacity; lengths are 1 to the largest capacity.

    Longest first (ties by position). A piece goes into the open bin that it leaves the
    least room in. Where none has room, the size is opened whose cost for each token it is
    likely to hold is least: the piece, and what the shorter pieces still to come can fill
    beyond the room already open, so all sizes compete for the same pieces. In the end each
    bin shrinks to the least permitted size that holds its contents.
    """
    order = np.argsort(-lengths, kind="stable")
    sorted_len = lengths[order]
    rest = np.concatenate([np.cumsum(sorted_len[::-1])[::-1], [0]])
    top = capacities[-1]
    first = len(lengths) - np.searchsorted(sorted_len[::-1], np.arange(top + 1), side="right")  # first piece of at most r tokens
    costs = [cost(c, weights) for c in capacities]
    stacks: list[list[int]] = [[] for _ in range(top + 1)]
    mask, free = 0, 0
    used: list[int] = []
    size: list[int] = []
    bins, offs = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(sorted_len.tolist()):
        m = mask >> n
        if m:
            r = n + (m & -m).bit_length() - 1
            b = stacks[r].pop()
            if not stacks[r]:
                mask &= ~(1 << r)
            free -= n
        else:
            best, c = None, top
            for k, x in zip(capacities, costs, strict=True):
                if k >= n:
                    more = min(k - n, max(0, int(rest[max(i + 1, first[k - n])]) - free))
                    if best is None or x / (n + more) < best:
                        best, c = x / (n + more), k
            b, r = len(used), c
            used.append(0)
            size.append(c)
            free += c - n
        at = order[i]
        bins[at], offs[at] = b, used[b]
        used[b] += n
        if r > n:
            stacks[r - n].append(b)
            mask |= 1 << (r - n)
    final = np.array(capacities)[np.searchsorted(np.array(capacities), np.array(used, np.int64))] if used else np.zeros(0, np.int64)
    return bins, offs, final


def encode(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every row: the whole text's ids and one end id, the first that the vocabulary leaves free."""
    bounded_batches(docs.sparkSession)
    width = ranked.id_bytes(tokenizer)

    def run(batches):
        from .bpe import read_ranks

        end = [len(read_ranks(tokenizer))]
        for b in batches:
            ids = [ranked.encoded(x.decode(), tokenizer, pattern, end, width) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])
        give_back()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", binary_text(text).alias("t")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def shards_of(docs: DataFrame, text: str = "text", shard: int = SHARD, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards of about ``shard`` rows or ``shard_bytes`` of text, whichever are more; the texts are measured, not encoded."""
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return max(1, -(-rows // shard), -(-total // shard_bytes))


def pack(tokens: DataFrame, width: int, shards: int, capacities: tuple[int, ...] = CAPACITIES, weights=COST) -> DataFrame:
    """Sequences (bin_id, capacity, ids, pieces) of a frame of (doc_id, n_tokens >= 1, ids).

    ``pieces`` are structs (doc_id, piece, start, n_tokens, offset) in the order of their offsets.
    Rows are dealt evenly, whatever their keys, into shards that are packed alone: a task holds a
    shard's ids, and each shard leaves a bin or two partly filled. A document longer than the
    largest capacity becomes full pieces and a remainder. Ids move once, in the shuffle to the shards.
    """
    top = capacities[-1]
    kind = dict(tokens.dtypes)["doc_id"]
    schema = f"bin_id long, capacity long, ids binary, pieces array<struct<doc_id: {kind}, piece: long, start: long, n_tokens: long, offset: long>>"

    def run(batches):
        from pyspark import TaskContext

        rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        first = TaskContext.get().partitionId() << 32
        n, ids = rows.column("n_tokens").to_numpy(), rows.column("ids")
        pieces = -(-n // top)
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * top
        size = np.minimum(n[doc] - start, top)
        bins, offs, final = best_fit(size, capacities, weights)
        order = np.lexsort((offs, bins))
        cuts = np.searchsorted(bins[order], np.arange(len(final) + 1))
        filled = np.add.reduceat(size[order], cuts[:-1])
        group = np.concatenate([[0], np.cumsum(filled)])[:-1] // OUT_TOKENS
        for g in range(int(group[-1]) + 1):
            own = np.flatnonzero(group == g)
            if not len(own):
                continue
            at = order[cuts[own[0]] : cuts[own[-1] + 1]]
            blobs = [b"".join(ids[int(doc[i])].as_py()[start[i] * width : (start[i] + size[i]) * width] for i in order[cuts[k] : cuts[k + 1]].tolist()) for k in own.tolist()]
            members = pa.StructArray.from_arrays([rows.column("doc_id").combine_chunks().take(pa.array(doc[at])), *(pa.array(x[at], pa.int64()) for x in (piece, start, size, offs))], names=["doc_id", "piece", "start", "n_tokens", "offset"])
            ends = pa.array(np.append(cuts[own], cuts[own[-1] + 1]) - cuts[own[0]], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(first + own), pa.array(final[own]), pa.array(blobs, pa.binary()), pa.ListArray.from_arrays(ends, members)], names=["bin_id", "capacity", "ids", "pieces"])
        del rows, ids
        give_back()

    return tokens.repartition(shards).mapInArrow(run, schema)


def op2_best_fit_packing(docs: DataFrame, tokenizer: str, pattern: str, out: str) -> DataFrame:
    """Packed sequences below ``out`` and, read back from them, where every document's tokens are.

    Returns (doc_id, piece, start, n_tokens, bin_id, capacity, offset, sequence_crc32), a row for
    each piece. A null or empty text is its end id alone, under a null doc_id too. Repeated rows are packed each
    on their own; ties in length go by position. An empty table gives no rows. Extra columns
    are ignored. A text longer than the largest capacity is cut into pieces; each text is encoded whole.
    """
    sequences = pack(encode(docs, tokenizer, pattern), ranked.id_bytes(tokenizer), shards_of(docs))
    packed = written(sequences, f"{out}/sequences")
    each = packed.select("bin_id", "capacity", F.crc32("ids").alias("sequence_crc32"), F.explode("pieces").alias("p"))
    return each.select("p.doc_id", "p.piece", "p.start", "p.n_tokens", "bin_id", "capacity", "p.offset", "sequence_crc32")
