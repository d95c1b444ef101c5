"""Exact substring dedup with sharded suffix arrays.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller
doc_id. Texts are judged as they came in.

1. Anchors. The 16-byte gram of the smallest hash among those inside a window of ``LENGTH`` bytes (the
   first, if several) is a function of the window's bytes alone; so are the ``WIDE`` bytes up to its end
   where it lies far in the window, or from its beginning where it does not. These wide grams are the
   anchors: phrases of a few words, which in a large corpus any two documents share, are too short for them.
   Documents lie in parts; each part sends its anchors' hashes, each once, and learns which of them occur
   in another document.
2. Shards. A run of windows with one such anchor is a region. Each part sends its distinct regions, with
   their smallest doc_id, to the shard of their anchor, so equal windows of any two documents meet in a
   shard. Anchors with over ``HOT`` occurrences are dealt by single window, by the window's own hash, so a
   frequent line or passage neither gathers its contexts in one task nor is sent more than once by a part.
3. Suffix arrays. A shard's distinct regions make one text (in batches of about ``BATCH`` bytes, again by
   anchor) whose suffix array is built by induced sorting. Runs of it with common prefixes of ``LENGTH``
   bytes are equal windows; the smallest doc_id of each goes back to the parts that have a larger one.
4. Each part marks its windows against those doc_ids and cuts the covered bytes.

Defined results: a null text is empty; a null doc_id counts as larger than any other and equal to other
nulls; rows with equal doc_ids do not remove each other's bytes; an empty table gives no rows. Further columns
stay as they are; those named ``__part``, ``__kept`` or ``__spans`` are dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH, GRAM, WIDE = 50, 16, 32
#: Of an anchor's hash. Different anchors that share a hash only send regions in vain; at 30 GB one in some hundreds does.
HASH_BYTES = 5
PART_BYTES, BATCH, HOT = 8 << 20, 1 << 20, 2048
LAST = np.iinfo(np.int64).max


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def regions(text: np.ndarray, bounds: np.ndarray, length: int = LENGTH):
    """Runs of windows with one anchor: first and last start, and the anchor's hash, in order.

    ``text`` is padded with 16 bytes; document k is text[bounds[k]:bounds[k + 1]].
    """
    total, span, piece = int(bounds[-1]), length - GRAM + 1, 1 << 17
    wide = min(WIDE, (length + GRAM) // 2 // 8 * 8)  # on one side or the other, a window has that many bytes
    valid = np.ones(total, bool)
    for s, e in zip(np.maximum(bounds[:-1], bounds[1:] - length + 1).tolist(), bounds[1:].tolist(), strict=True):
        valid[s:e] = False
    words = np.ndarray((len(text) - 7,), "<u8", buffer=text, strides=(1,))
    low = np.uint64((1 << 20) - 1)
    out = []
    for p in range(0, total, piece):
        n = min(piece, total - p)
        if not valid[p : p + n].any():
            continue
        g = min(n + span - 1, len(words) - 8 - p)
        h = words[p : p + g] * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h += words[p + 8 : p + 8 + g]
        h *= np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xE7037ED1A0B428DB)
        h ^= h >> np.uint64(32)
        m = (h & ~low) | np.arange(g, dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            m = np.minimum(m[:-reach], m[reach:])
            reach *= 2
        if span > reach:
            m = np.minimum(m[: -(span - reach)], m[span - reach :])
        n = min(n, len(m))
        anchor = (m[:n] & low).astype(np.int64)
        ok = valid[p : p + n]
        far = anchor - np.arange(n) >= wide - GRAM
        change = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1]) | (far[1:] != far[:-1])))
        last = np.append(change[1:], n) - 1
        keep = ok[change]
        change, last = change[keep], last[keep]
        at = anchor[change] + p - np.where(far[change], wide - GRAM, 0)
        key = np.zeros(len(at), np.uint64)
        for k in range(0, wide, 8):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + words[at + k])
        out.append((change + p, last + p, mix(key) >> np.uint64(64 - 8 * HASH_BYTES)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def packed(hashes: np.ndarray) -> bytes:
    """The low HASH_BYTES of each number."""
    return np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def joined(*columns: np.ndarray | bytes) -> bytes:
    """Columns of one length, and a last one of bytes, as compressed bytes."""
    n = len(columns[0])
    return zlib.compress(n.to_bytes(8, "little") + b"".join(c if isinstance(c, bytes) else np.ascontiguousarray(c).tobytes() for c in columns), 1)


def parted(blob: bytes, kinds: list[str]) -> list:
    """What was joined: a column of each kind and the bytes left."""
    raw = zlib.decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.frombuffer(raw, k, n, at))
        at += size
    return [*out, raw[at:]]


class Part:
    """The documents of a part, in an order that does not depend on how they arrived."""

    def __init__(self, table):
        ids = [LAST if x is None else x for x in table.column("doc_id").to_pylist()]
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in table.column("text").to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in self.order], np.int64)
        texts = [texts[i] for i in self.order]
        self.bounds = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        self.raw = b"".join([*texts, bytes(GRAM + 8)])
        self.text = np.frombuffer(self.raw, np.uint8)
        self.first, self.last, self.hash = regions(self.text, self.bounds)
        self.doc = self.ids[np.searchsorted(self.bounds, self.first, "right") - 1]

    def shared(self, repeated, length: int = LENGTH):
        """Regions with an anchor in ``repeated`` (pairs of sorted hashes and whether each is hot), hot ones as single windows.

        Returns first start, last start, doc_id, number of the distinct content; and the contents, their smallest doc_ids and anchors.
        """
        hashes, hot = repeated
        at = np.minimum(np.searchsorted(hashes, self.hash), max(0, len(hashes) - 1))
        in_it = hashes[at] == self.hash if len(hashes) else np.zeros(len(self.hash), bool)
        first, last, doc, h = self.first[in_it], self.last[in_it], self.doc[in_it], self.hash[in_it]
        is_hot = hot[at[in_it]]
        n = np.where(is_hot, last - first + 1, 1)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(first, n) + step
        last = np.where(np.repeat(is_hot, n), first, np.repeat(last, n))
        doc, h, is_hot = np.repeat(doc, n), np.repeat(h, n), np.repeat(is_hot, n)
        number: dict[bytes, int] = {}
        raw = self.raw
        content = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)), np.int64, len(first))
        least = np.full(len(number), LAST, np.int64)
        np.minimum.at(least, content, doc)
        anchor = np.zeros(len(number), np.uint64)
        anchor[content] = h
        if is_hot.any():
            import xxhash

            texts = [*number]
            for c in np.unique(content[is_hot]).tolist():
                anchor[c] = xxhash.xxh64_intdigest(texts[c])
        return first, last, doc, content, [*number], least, anchor


def _split(keys: np.ndarray, buckets: int):
    """Entries by bucket: (bucket, indices)."""
    b = (mix(keys) >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(b, kind="stable")
    s = b[order]
    cuts = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    for x in np.split(order, cuts[1:]) if len(s) else []:
        yield int(b[x[0]]), x


def _anchors(buckets: int):
    """A part's anchors by bucket: hashes of those that occur once, and hash, count and several documents or not for the rest."""
    import pyarrow as pa

    from codeloom.llm.common import held

    def run(table):
        held(None, dict)  # other operators' caches go
        part = Part(table)
        k = table.column("__part")[0].as_py()
        order = np.argsort(part.hash, kind="stable")
        h, doc = part.hash[order], part.doc[order]
        cut = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(cut, len(h)))
        several = doc[cut] != doc[cut + count - 1]  # stable, and documents ascend
        h, rows = h[cut], []
        for b, at in _split(h, buckets):
            one, more = at[count[at] == 1], at[count[at] > 1]
            rows.append((b, k, packed(h[one]), packed(h[more]), count[more].astype("<u4").tobytes(), several[more].astype(np.uint8).tobytes()))
        names = ["bucket", "part", "ones", "more", "counts", "several"]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    return run


def _repeated(table):
    """A bucket's anchors that occur in several documents, back to the parts that have them."""
    import pyarrow as pa

    h, count, several, part = [], [], [], []
    for r in table.to_pylist():
        one, more = unpacked(r["ones"]), unpacked(r["more"])
        h += [one, more]
        count += [np.ones(len(one), np.int64), np.frombuffer(r["counts"], "<u4").astype(np.int64)]
        several += [np.zeros(len(one), bool), np.frombuffer(r["several"], np.uint8).astype(bool)]
        part.append(np.full(len(one) + len(more), r["part"], np.int32))
    h, count, several, part = (np.concatenate(x) for x in (h, count, several, part))
    order = np.argsort(h, kind="stable")
    h, count, several, part = h[order], count[order], several[order], part[order]
    cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(cut, len(h)))
    keep = np.repeat((size > 1) | np.logical_or.reduceat(several, cut), size)
    hot = np.repeat(np.add.reduceat(count, cut) > HOT, size)
    h, hot, part = h[keep], hot[keep], part[keep]
    order = np.argsort(part, kind="stable")
    h, hot, part = h[order], hot[order], part[order]
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(h) else np.zeros(0, np.int64)
    pieces = [(int(part[a]), packed(h[a:b]), hot[a:b].tobytes()) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(h)], strict=len(cut) > 0)]
    cols = [*zip(*pieces, strict=True)] if pieces else [[], [], []]
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["part", "hashes", "hot"])


def _repeats_of(table):
    """Sorted hashes and hot flags from the rows sent to a part."""
    rows = [r for r in table.select(["hashes", "hot"]).to_pylist() if r["hashes"]]
    h = np.concatenate([unpacked(r["hashes"]) for r in rows]) if rows else np.zeros(0, np.uint64)
    hot = np.concatenate([np.frombuffer(r["hot"], np.uint8) for r in rows]).astype(bool) if rows else np.zeros(0, bool)
    order = np.argsort(h, kind="stable")
    return h[order], hot[order]


def _regions(shards: int):
    import pyarrow as pa

    from codeloom.llm.common import tidy

    def run(left, right):
        tidy()
        rows = []
        if left.num_rows:
            k = left.column("__part")[0].as_py()
            _, _, _, _, texts, least, anchor = Part(left).shared(_repeats_of(right))
            for b, at in _split(anchor, shards):
                mine = [texts[i] for i in at.tolist()]
                gaps = np.diff(at, prepend=0).astype("<u4")
                rows.append((b, k, joined(mix(anchor[at]).astype("<u4"), gaps, least[at], np.array([len(x) for x in mine], "<u2"), b"".join(mine))))
        kinds = [pa.int32(), pa.int32(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)], ["shard", "part", "regions"])

    return run


def window_minima(texts: list[bytes], docs: np.ndarray, anchors: np.ndarray, length: int = LENGTH):
    """For every window of every text, in order, the smallest of ``docs`` (one for each text) with that window; and window counts.

    The windows of texts of different anchors differ, so a text that is alone with its anchor has the answer
    in its own smallest doc_id; the others go into the suffix array.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    _, group, members = np.unique(anchors, return_inverse=True, return_counts=True)
    several = np.flatnonzero(members[group] > 1)
    least = np.repeat(docs, windows)
    if len(several):
        begin = np.cumsum(windows) - windows
        n = windows[several]
        at = np.repeat(begin[several], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        least[at] = _sorted_minima([texts[i] for i in several.tolist()], docs[several], sizes[several], n, length)
    return least, windows


def _sorted_minima(texts, docs, sizes, windows, length):
    from codeloom.llm.suffix_array import common_prefixes, suffix_array

    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = raw.astype(np.int32) + 1
    symbols[starts + sizes] = 0
    sa = suffix_array(symbols)
    prefix = common_prefixes(np.append(raw, np.zeros(length + 8, np.uint8)), sa, length)
    owner = np.full(len(raw), -1, np.int32)
    within = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    places = np.repeat(starts, windows) + within
    owner[places] = np.repeat(np.arange(len(texts), dtype=np.int32), windows)
    # suffixes between two equal windows begin with that window too, so equal windows are neighbours
    is_window = owner[sa] >= 0
    mine = sa[is_window]
    joins = np.zeros(len(sa), bool)
    joins[1:] = (prefix[sa[1:]] >= length) & is_window[:-1]
    cut = np.flatnonzero(~joins[is_window])
    least = np.empty(len(raw), np.int64)
    if len(mine):
        low = np.minimum.reduceat(docs[owner[mine]], cut)
        least[mine] = np.repeat(low, np.diff(np.append(cut, len(mine))))
    return least[places]


def _solve(table):
    """Windows of a shard's regions that a document outside the region's part has, or a smaller one in it: runs with their smallest doc_id."""
    import pyarrow as pa

    from codeloom.llm.common import tidy

    tidy()
    rows = []
    for k, blob in zip(table.column("part").to_pylist(), table.column("regions"), strict=True):
        anchors, gaps, least, sizes, texts = parted(blob.as_py(), ["<u4", "<u4", "<i8", "<u2"])
        rows.append({"part": k, "anchors": anchors, "numbers": np.cumsum(gaps, dtype=np.int64), "least": least, "sizes": sizes, "texts": texts})
    total = sum(len(r["texts"]) for r in rows)
    batches = max(1, -(-total // BATCH))
    sub = [(mix(r["anchors"].astype(np.uint64)) >> np.uint64(24)) % np.uint64(batches) for r in rows]
    out: dict[int, list] = {}
    for b in range(batches):
        number: dict[bytes, int] = {}
        who, content = [], []
        for k, r in enumerate(rows):
            ends = np.cumsum(r["sizes"].astype(np.int64))
            at = np.flatnonzero(sub[k] == b)
            text, e, s = r["texts"], ends[at].tolist(), (ends[at] - r["sizes"][at]).tolist()
            content.append(np.fromiter((number.setdefault(text[x:y], len(number)) for x, y in zip(s, e, strict=True)), np.int64, len(at)))
            who.append((k, at))
        if not number:
            continue
        docs = np.full(len(number), LAST, np.int64)
        anchor = np.zeros(len(number), np.uint32)
        for (k, at), c in zip(who, content, strict=True):
            np.minimum.at(docs, c, rows[k]["least"][at])
            anchor[c] = rows[k]["anchors"][at]
        least, windows = window_minima([*number], docs, anchor)
        begin = np.cumsum(windows) - windows
        for (k, at), c in zip(who, content, strict=True):
            n = windows[c]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            low = least[np.repeat(begin[c], n) + step]
            region = np.repeat(np.arange(len(c)), n)
            less = low < np.repeat(rows[k]["least"][at], n)
            if not less.any():
                continue
            low, region, step = low[less], region[less], step[less]
            new = np.flatnonzero(np.append(True, (region[1:] != region[:-1]) | (low[1:] != low[:-1]) | (step[1:] != step[:-1] + 1)))
            end = np.append(new[1:], len(low)) - 1
            out.setdefault(rows[k]["part"], []).append((rows[k]["numbers"][at][region[new]].astype("<u4"), step[new].astype("<u2"), (step[end] + 1).astype("<u2"), low[new]))
    parts = [(p, joined(*(np.concatenate(x) for x in zip(*v, strict=True)))) for p, v in out.items()]
    kinds = [pa.int32(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*parts, strict=True) if parts else [[]] * 2, kinds, strict=True)], ["part", "answers"])


def covered(part: Part, repeated, answers: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Which bytes of a part go."""
    first, last, doc, content, texts, least, _ = part.shared(repeated)
    # runs of windows per content: own minimum, then what the shards found
    begin, end, low, what = [], [], [], []
    for blob in answers:
        for to, x in zip((what, begin, end, low), parted(blob, ["<u4", "<u2", "<u2", "<i8"]), strict=False):
            to.append(x.astype(np.int64))
    delta = np.zeros(len(part.raw) + 1, np.int32)
    over = least[content] < doc  # a smaller document of this part has the whole region
    np.add.at(delta, first[over], 1)
    np.add.at(delta, last[over] + length, -1)
    if what:
        what, begin, end, low = (np.concatenate(x) for x in (what, begin, end, low))
        order = np.argsort(what, kind="stable")
        what, begin, end, low = what[order], begin[order], end[order], low[order]
        lo, hi = np.searchsorted(what, content, "left"), np.searchsorted(what, content, "right")
        m = hi - lo
        row = np.repeat(np.arange(len(content)), m)
        at = np.repeat(lo, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        take = low[at] < doc[row]
        row, at = row[take], at[take]
        np.add.at(delta, first[row] + begin[at], 1)
        np.add.at(delta, first[row] + end[at] - 1 + length, -1)
    delta = delta[: int(part.bounds[-1])]
    return np.cumsum(delta, dtype=np.int32, out=delta) > 0


def _apply(names: list[str]):
    import pyarrow as pa

    from codeloom.llm.common import tidy

    def run(left, right):
        tidy()
        kept, spans = [], []
        if left.num_rows:
            part = Part(left)
            left = left.take(pa.array(part.order))
            gone = covered(part, _repeats_of(right), [x.as_py() for x in right.column("answers") if x.is_valid])
            for s, e in zip(part.bounds[:-1].tolist(), part.bounds[1:].tolist(), strict=True):
                g = gone[s:e]
                if not g.any():
                    kept.append(part.raw[s:e])
                    spans.append([])
                    continue
                kept.append(part.text[s:e][~g].tobytes())
                edge = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return left.select(names).append_column("__kept", pa.array(kept, pa.binary())).append_column("__spans", pa.array(spans, span))

    return run


def dedup(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with its columns, __kept (bytes that stay) and __spans (maximal removed runs of bytes)."""
    from codeloom.llm.common import partitions, settled

    docs = docs.drop("__part", "__kept", "__spans")
    spark, docs = docs.sparkSession, settled(docs)  # a part must hold the same rows in each of the three steps that deal them
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), -(-size // PART_BYTES))
    names = docs.columns
    dealt = docs.withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
    blobs = lambda *names: ", ".join(f"{n} binary" for n in names)
    anchors = dealt.groupBy("__part").applyInArrow(_anchors(parts), "bucket int, part int, " + blobs("ones", "more", "counts", "several"))
    repeated = anchors.groupBy("bucket").applyInArrow(_repeated, "part int, " + blobs("hashes", "hot"))
    sent = dealt.groupBy("__part").cogroup(repeated.groupBy("part")).applyInArrow(
        _regions(parts), "shard int, part int, regions binary"
    )
    answers = sent.groupBy("shard").applyInArrow(_solve, "part int, answers binary")
    none = F.lit(None).cast("binary")
    told = repeated.select("part", "hashes", "hot", none.alias("answers")).unionAll(
        answers.select("part", none.alias("hashes"), none.alias("hot"), "answers")
    )
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("__kept", T.BinaryType()), T.StructField("__spans", T.ArrayType(span))])
    return dealt.groupBy("__part").cogroup(told.groupBy("part")).applyInArrow(_apply(names), schema)


def op1_suffix_dedup(spark, sf_dir):
    from codeloom.llm.common import table

    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select(
        "doc_id",
        (F.length("__kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("__spans").cast("long").alias("n_spans"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )
