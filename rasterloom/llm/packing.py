"""Order-preserving packing of token streams into fixed windows by dynamic programming.

Candidate cuts are document ends and sentence ends.  With ``pos`` the token
position of a cut, the cost of a window from cut i to cut j is its padding
``limit - (pos[j] - pos[i])`` plus the truncation penalty of cut j, so

    best[j] = limit - pos[j] + penalty[j] + min(best[i] + pos[i])

over the cuts i at most ``limit`` tokens back.  The minimum of that sliding
window comes from a monotone queue, hence linear time.  A sentence of more than
``LONG_SENTENCE`` tokens gets extra cuts inside, at a higher penalty: they are
taken where the next boundary would leave more padding than that.

Documents keep the order in which their input partition holds them.  Every
partition is packed by itself, in blocks of ``horizon`` tokens, so memory is
bounded by one block and one document, nothing is shuffled, and a lost
executor costs its partitions only.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .tokens import Encoder, crc_of

LIMIT = 2048
HORIZON = 1 << 21
SENTENCE_PENALTY = 8
LONG_SENTENCE, HARD_EVERY, HARD_PENALTY = 32, 8, 24
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "row_in_partition long"
)


def choose_cuts(pos: np.ndarray, penalty: np.ndarray, limit: int) -> list[int]:
    """Indices into ``pos`` (increasing from 0, gaps at most ``limit``) of the cheapest cuts, first and last included."""
    p, pen, n = pos.tolist(), penalty.tolist(), len(pos)
    score, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])  # indices by increasing score; score[i] = best[i] + pos[i]
    pop, popleft, push = queue.pop, queue.popleft, queue.append
    for j in range(1, n):
        pj = p[j]
        while pj - p[queue[0]] > limit:
            popleft()
        i = queue[0]
        back[j] = i
        own = score[j] = limit + pen[j] + score[i]
        # Of equal scores the earlier cut stays in front, so ties fall to fewer, fuller windows first.
        while queue and score[queue[-1]] > own:
            pop()
        push(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def sentence_ends(ids: np.ndarray, enders: np.ndarray) -> np.ndarray:
    """Positions after each id that ends a sentence; ``enders`` is a boolean table over the vocabulary."""
    return np.flatnonzero(enders[ids]) + 1


def tail_cuts(size: int, limit: int) -> list[int]:
    """Cuts of a partition's last window into powers of two, which need no padding, where that is the cheaper way."""
    if HARD_PENALTY * (size.bit_count() - 1) >= limit - size:
        return []
    ones = [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]
    return np.cumsum(ones[:-1]).tolist()


def pack_block(docs: list[np.ndarray], enders: np.ndarray, limit: int = LIMIT, last: bool = True) -> Iterator[tuple[int, int, int, int, int]]:
    """Packs documents in order; yields (document, start, length, sequence, offset) of each piece.

    ``last``: no further block follows in the partition, so the last window may end short.
    """
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes)
    ids = np.concatenate(docs)
    cut = sentence_ends(ids, enders)
    pos = np.union1d(cut, ends)
    pos = np.concatenate([[0], pos[pos > 0]])
    gaps = np.flatnonzero(np.diff(pos) > LONG_SENTENCE)
    hard = np.concatenate([np.arange(pos[g] + HARD_EVERY, pos[g + 1], HARD_EVERY) for g in gaps]) if len(gaps) else np.empty(0, np.int64)
    pos = np.union1d(pos, hard)
    penalty = np.full(len(pos), SENTENCE_PENALTY, np.int64)
    penalty[np.isin(pos, hard)] = HARD_PENALTY
    penalty[np.isin(pos, ends)] = 0
    at = pos[choose_cuts(pos, penalty, limit)]
    if last:
        at = np.union1d(at, at[-2] + np.array(tail_cuts(int(at[-1] - at[-2]), limit), np.int64))
    edges = np.union1d(at, np.concatenate([[0], ends]))
    doc = np.searchsorted(ends, edges[:-1], "right")
    seq = np.searchsorted(at, edges[:-1], "right") - 1
    begin = ends - sizes
    yield from zip(
        doc.tolist(), (edges[:-1] - begin[doc]).tolist(), np.diff(edges).tolist(), seq.tolist(), (edges[:-1] - at[seq]).tolist()
    )


def _packer(path: str, end_id: int, limit: int, horizon: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder = Encoder.of(path, True)
        vocab = encoder.tok.get_vocab_size()
        enders = np.zeros(vocab, bool)
        for token, k in encoder.tok.get_vocab().items():
            enders[k] = token.rstrip('"\')]').endswith((".", "!", "?")) or "Ċ" in token
        base = TaskContext.get().partitionId() << 34
        held, names, size, rows, seqs = [], [], 0, 0, 0

        def flush(last: bool) -> pd.DataFrame:
            nonlocal rows, seqs
            out, top = [], 0
            for d, start, length, seq, offset in pack_block(held, enders, limit, last):
                ids = held[d][start : start + length]
                out.append((names[d], start, length, crc_of(ids), len(held[d]), base + seqs + seq, offset, rows + d))
                top = max(top, seq + 1)
            rows, seqs = rows + len(held), seqs + top
            pdf = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            return pdf.astype({"doc_id": "Int64"})

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                ids = encoder.encode(text, end_id)
                held.append(ids)
                names.append(doc_id)
                size += len(ids)
                if size >= horizon:
                    yield flush(False)
                    held, names, size = [], [], 0
        if held:
            yield flush(True)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, limit: int = LIMIT, horizon: int = HORIZON) -> DataFrame:
    """``(doc_id, text)`` to the pieces of packed sequences.

    Returns doc_id, start and length of the piece in its document's ids,
    ids_crc32 of its ids, doc_tokens, sequence_id, offset in the sequence, and
    row_in_partition, which tells repeated rows of one doc_id apart.  A null or
    empty text is the end id alone; a null doc_id stays null; a document longer
    than ``limit`` spans several sequences; an empty table gives no pieces.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(_packer(tokenizer, end_id, limit, horizon), SCHEMA)
