"""Cost-balanced packing of token sequences.

Each document's ids, with an end id, are packed into sequences of at most ``length`` tokens. A piece of n tokens costs
``linear * n + quadratic * n * n`` (attention stays inside a piece). A document of more tokens than a sequence holds
fills whole sequences first. What is left of the documents is taken in descending length; each goes to the sequence of
the lowest cost that has room for all of it. Those that no sequence has room for are then cut, in the same order, into
the room that the cheapest sequences have left; room of under ``GAP`` tokens is left as padding, as filling it would
shred these documents. What is then left fills sequences of its own. Packing is done in blocks of about
``block`` tokens as they stream through a task, so memory is bounded and nothing is shuffled.

A block of t tokens has t // length sequences to begin with. The sequences made last, of r tokens in all, are
r // length full ones and, for the rest, one of each power of two of its binary form, as a sequence of such a length
needs no padding; they are filled, by cuts. So padding is under ``GAP`` tokens a sequence.

Defined results: a null or empty text is its end id alone; repeated rows are packed as often as they
occur; a null doc_id stays null; documents of equal length are taken as they come; an empty table gives no rows; other
columns are not read. Sequence ids are unique, and the same whenever a lost task runs again.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np

from codeloom.llm.bpe import Bpe, blocks, load

LENGTH = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
BLOCK = 1 << 22
#: Tokens of room that are not worth a cut.
GAP = 32


def capacities(tokens: int, length: int = LENGTH) -> list[int]:
    """Lengths of a block's sequences."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def filled(items: list[tuple[int, int, int]], room: list[int], cost: list[float], least: int, place) -> list[tuple[int, int, int]]:
    """Cuts ``items`` (length, document, start) into the room of the cheapest sequences that have ``least`` or more; returns what is left of them."""
    heap = [(cost[s], s) for s in range(len(room)) if room[s] >= least]
    heapq.heapify(heap)
    rest = []
    for left, d, start in items:
        while left and heap:
            s = heapq.heappop(heap)[1]
            n = min(left, room[s])
            if 0 < left - n < least <= n - least + left - n:  # the next piece is not to be shorter either
                n = left - least
            place(d, start, n, s)
            start, left = start + n, left - n
            if room[s] >= least:
                heapq.heappush(heap, (cost[s], s))
        if left:
            rest.append((left, d, start))
    return rest


def assign(sizes: np.ndarray, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC, gap: int = GAP) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of the given token counts."""
    room, cost, fill, pieces = [], [], [], []

    def opened(lengths):
        room.extend(lengths)
        cost.extend([0.0] * len(lengths))
        fill.extend([0] * len(lengths))

    def place(d, start, n, s):
        pieces.append((d, start, n, s, fill[s]))
        cost[s] += linear * n + quadratic * n * n
        fill[s] += n
        room[s] -= n

    opened([length] * (int(sizes.sum()) // length))
    items, full = [], 0
    for d, size in enumerate(sizes.tolist()):
        for k in range(size // length):
            place(d, k * length, length, full)
            full += 1
        if size % length:
            items.append((size % length, d, size - size % length))
    items.sort(key=lambda x: (-x[0], x[1]))
    # as documents get shorter, sequences wait by their room until it suffices, then stand by their cost
    waiting = [(-room[s], s) for s in range(full, len(room))]
    heapq.heapify(waiting)
    ready: list[tuple[float, int]] = []
    cut = []
    for n, d, start in items:
        while waiting and -waiting[0][0] >= n:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (cost[s], s))
        if not ready:
            cut.append((n, d, start))
            continue
        s = heapq.heappop(ready)[1]
        place(d, start, n, s)
        if room[s]:
            heapq.heappush(waiting, (-room[s], s))
    cut = filled(cut, room, cost, gap, place)
    first = len(room)
    opened(capacities(sum(n for n, _, _ in cut), length))
    left = [0] * first + room[first:]  # the sequences made last alone

    def last(d, start, n, s):
        place(d, start, n, s)
        left[s] = room[s]

    filled(cut, left, cost, 1, last)
    return pieces


def pack(docs, tokenizer: str, end_id: int = 1, length: int = LENGTH, block: int = BLOCK, with_ids: bool = False, cache: int = Bpe.CACHE):
    """``docs(doc_id, text)`` to one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def run(batches):
        from pyspark import TaskContext

        bpe, end = load(tokenizer, cache), np.array([end_id], "<u4").tobytes()
        names: list = []
        coded: list[bytes] = []
        held, at = 0, TaskContext.get().partitionId() << 32

        def flush():
            nonlocal held, at
            sizes = np.array([len(x) // 4 for x in coded], np.int64)
            pieces = assign(sizes, length)
            parts = [coded[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            doc, start, size, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            cols = [
                pa.array([names[d] for d in doc.tolist()], batch_kind), pa.array(start), pa.array(size),
                pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(sizes[doc]), pa.array(at + seq), pa.array(offset),
            ]
            at += int(seq.max()) + 1
            names.clear()
            coded.clear()
            held = 0
            return pa.RecordBatch.from_arrays(
                cols + [pa.array(parts, pa.binary())] * with_ids,
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids,
            )

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            batch_kind = ids.type
            ids = ids.to_pylist()
            for b, e in blocks(texts):
                for name, x in zip(ids[b:e], bpe.encode_batch(texts[b:e]), strict=True):
                    names.append(name)
                    coded.append(x + end)
                    held += len(x) // 4 + 1
                if held >= block:
                    yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_pack(spark, sf_dir):
    import public_tokenizers

    from codeloom.llm.common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
