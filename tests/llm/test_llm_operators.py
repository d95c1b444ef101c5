"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeloom.llm import bpe, chat, licenses, minhash, packing, sharding, simhash, suffix_dedup, toxicity, voronoi
from codeloom.llm.common import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, fp long, shard string, __x string"


def docs_of(spark, rows):
    """(doc_id, text) rows with further columns, some of which bear names that operators use."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "q", "z") for i, t in rows], SCHEMA)


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.choice([3, 30, 80]))) for _ in range(n)]
    shared = " ".join(word() for _ in range(60))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(n + i, base[i]) for i in range(10)]
    rows += [(2 * n + i, base[i] + " " + shared + " " + word()) for i in range(12)]
    rows += [(3 * n, None), (3 * n + 1, ""), (3 * n + 2, " \n\t "), (None, base[2]), (None, shared), (5, base[5]), (5, base[5])]
    rows.append((3 * n + 3, " ".join(word() for _ in range(40000)) + shared))
    rng.shuffle(rows)
    return rows


def brute_removed(rows):
    big = 1 << 62
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], big), big if i is None else i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (big if i is None else i):
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [3, 2048])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = corpus()
    done = suffix_dedup.dedup(docs_of(spark, rows)).collect()
    found = Counter()
    for r in done:
        spans = [(s.start, s.end) for s in r["__spans"]]
        n = sum(e - s for s, e in spans)
        found[r.doc_id, len(r["__kept"]) + n, n, len(spans), hashlib.sha256(bytes(r["__kept"])).hexdigest()] += 1
    assert found == brute_removed(rows)
    assert done[0]["__x"] == "z" and done[0].part == 1


def test_suffix_dedup_of_shuffled_rows(spark):
    """Rows whose places change from use to use are written down first."""
    rows = corpus()
    moving = docs_of(spark, rows).repartition(5).withColumn("__x", F.when(F.rand() < 2, "z"))
    found = Counter()
    for r in suffix_dedup.dedup(moving).collect():
        spans = [(s.start, s.end) for s in r["__spans"]]
        n = sum(e - s for s, e in spans)
        found[r.doc_id, len(r["__kept"]) + n, n, len(spans), hashlib.sha256(bytes(r["__kept"])).hexdigest()] += 1
    assert found == brute_removed(rows)
    out = sharding.assign(moving, 300).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)


def test_suffix_dedup_anchors_of_phrases():
    """Texts that share phrases of 28 bytes share no anchor; equal windows of 50 bytes have the same one, wherever they lie."""
    r = random.Random(4)
    noise = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    phrases = [noise(28) for _ in range(40)]

    def anchors(*texts):
        return [suffix_dedup.Part(pa.table({"doc_id": [1], "text": [t.decode()]})) for t in texts]

    one, two = anchors(*(b"".join(noise(30) + p for p in phrases) for _ in "ab"))
    assert len(one.hash) > 100 and not set(one.hash.tolist()) & set(two.hash.tolist())
    passage, of = noise(400), {}
    for part in anchors(noise(70) + passage + noise(5), passage):
        for first, last, h in zip(part.first.tolist(), part.last.tolist(), part.hash.tolist(), strict=True):
            for s in range(first, last + 1):
                of.setdefault(part.raw[s : s + 50], set()).add(h)
    assert len(of) == 400 - 49 + 75 and all(len(h) == 1 for h in of.values())


@pytest.mark.parametrize("short", [2, 40, 1 << 18])
def test_suffix_array(monkeypatch, short):
    """With recursion down to two symbols, down to forty, and with doubling at once."""
    from codeloom.llm import suffix_array as module

    monkeypatch.setattr(module, "SHORT", short)
    depth, deepest, inner = [0], [0], module.suffix_array

    def counted(t):
        depth[0] += 1
        deepest[0] = max(deepest[0], depth[0])
        try:
            return inner(t)
        finally:
            depth[0] -= 1

    monkeypatch.setattr(module, "suffix_array", counted)
    rng = random.Random(1)
    texts = []
    for _ in range(200):
        k = rng.choice([1, 2, 4, 40])
        texts.append([rng.randrange(k) for _ in range(rng.randrange(50))])
    for n in (2000, 6000):  # long ones: random, of few symbols, periodic, a Fibonacci string, and repeated passages
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        passage = [rng.randrange(200) for _ in range(150)]
        texts += [[rng.randrange(250) for _ in range(n)], [rng.randrange(2) for _ in range(n)], [1, 2, 1, 3] * (n // 4), [ord(c) - 96 for c in b[:n]]]
        texts.append([x for _ in range(n // 300) for x in [*passage, *(rng.randrange(200) for _ in range(150))]])
    for t in texts:
        raw = b"".join(x.to_bytes(2, "big") for x in t)
        assert counted(np.array(t, np.int32)).tolist() == sorted(range(len(t)), key=lambda i: raw[2 * i :])
    assert deepest[0] == 1 if short == 1 << 18 else deepest[0] > 2


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("cell", [1 << 21, 3000])
def test_simhash(spark, cell, monkeypatch):
    rng = random.Random(2)
    rows = corpus() + [(1000 + i, " ".join(f"w{rng.randrange(400)}" for _ in range(300))) for i in range(5)]
    long = rows[-1][1].split()
    rows += [(2000 + i, " ".join(long[:k] + ["x"] + long[k + 1 :])) for i, k in enumerate(range(0, 300, 12))]
    monkeypatch.setattr(simhash, "links", lambda fps, f=simhash.links: f(fps, cell))
    found = {(r.doc_id, r.fp, r.component_id) for r in simhash.classes(docs_of(spark, rows)).collect()}
    fps = {t: brute_fingerprint(t) for _, t in rows}
    nodes = sorted(set(fps.values()))
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if i is not None:
            c = find(fps[t])
            least[c] = min(least.get(c, i), i)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    assert found == {(i, signed(fps[t]), least.get(find(fps[t]))) for i, t in rows}


def test_empty_tables(spark):
    assert suffix_dedup.dedup(docs_of(spark, [])).count() == 0
    assert simhash.classes(docs_of(spark, [])).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    only_nulls = [(None, None), (None, None)]
    assert [r.component_id for r in simhash.classes(docs_of(spark, only_nulls)).collect()] == [None, None]
    assert [len(r["__kept"]) for r in suffix_dedup.dedup(docs_of(spark, only_nulls)).collect()] == [0, 0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


ODD = ["", " ", "a  b   c", "\n\n a  b\n", "x\x1cy \x85z ᠎q​w", "İSTANBUL ΣΟΦΟΣ", "'s don't we'LL", "a" * 99, "<|endoftext|>hi<|startoftext|>", "é ﬁ Å 😀👍🏽", "１２３ ٣٤ ½", "\0\1", "中文"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe(spark, name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), bpe.Bpe(path, cache=50)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False), t


def test_bpe_rows(spark):
    rows = [(1, None), (2, ""), (None, "ab c"), (3, "ab c"), (3, "ab c")]
    out = bpe.encode_decode(docs_of(spark, rows), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 2), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert bpe.encode_decode(docs_of(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_bpe_query(spark, tmp_path):
    """The registered query against the tokenizers library, on a table of its own."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [r for r in corpus(n=20)] + [(7000 + k, t) for k, t in enumerate(ODD)]
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    out = bpe.op5_bpe(spark, table_of(spark, tmp_path, rows)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want
    assert bpe.op5_bpe(spark, table_of(spark, tmp_path, [])).count() == 0


def test_suffix_dedup_query(spark, tmp_path):
    rows = corpus(seed=9, n=40)
    out = suffix_dedup.op1_suffix_dedup(spark, table_of(spark, tmp_path, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute_removed(rows)
    assert suffix_dedup.op1_suffix_dedup(spark, table_of(spark, tmp_path, [])).count() == 0


def test_toxicity_query(spark, tmp_path):
    """Held-out rows of the registered query; labels of held-out rows, languages, sources and ids change no score."""
    rng = random.Random(21)
    words = [f"{a}{b}{c}" for a in "kmprst" for b in ("ola", "ine", "uro", "esk", "am") for c in ("", "to", "ri")]
    rows, labels = [], []
    for i in range(700):
        t = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        if bad := i % 4 == 0:
            for _ in range(rng.randint(2, 4)):
                t.insert(rng.randrange(len(t)), rng.choice(["Grolm", "grolming", "vuxter,"]))
        rows.append((i, " ".join(t)))
        labels.append((i, 0, int(bad)))
    rows += [(900, None), (901, ""), (3, rows[3][1])]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    folder = table_of(spark, tmp_path, rows)
    put = lambda ls: spark.createDataFrame(ls, "doc_id long, quality int, toxic int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    put(labels)
    out = sorted(toxicity.op8_toxicity(spark, folder).collect())
    assert len(out) == len(rows) and {r.doc_id for r in out if r.held_out} == held
    truth = {i: y for i, _, y in labels}
    assert np.mean([r.predicted == truth[r.doc_id] for r in out if r.doc_id in held and r.doc_id in truth]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    put([(i, q, 1 - y if i in held else y) for i, q, y in labels])
    assert [(r.doc_id, r.score) for r in sorted(toxicity.op8_toxicity(spark, folder).collect())] == [(r.doc_id, r.score) for r in out]


@pytest.mark.parametrize("block", [300, 1 << 22])
def test_packing(spark, block):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, t) for i, t in corpus(n=20) if i is not None and i != 5]
    out = packing.pack(docs_of(spark, rows), path, length=64, block=block).collect()
    library = Tokenizer.from_file(path)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            ids = want[i][r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(want[i]) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += r.length
        assert at == len(want[i])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 64 - packing.GAP < at <= 64 or at & (at - 1) == 0
    assert packing.pack(docs_of(spark, []), path).count() == 0
    assert {r.doc_id for r in packing.pack(docs_of(spark, [(None, None), (None, "")]), path).collect()} == {None}


def test_packing_cuts_little_and_balances():
    rng = np.random.default_rng(2)
    for sizes in (rng.integers(1, 6000, 3000), rng.integers(1, 200, 5000), np.full(1000, 1100), np.array([2048] * 5), np.array([1]), np.array([5000]), np.array([], int)):
        pieces = packing.assign(sizes)
        at, of = np.zeros(len(sizes), int), {}
        for d, start, n, s, offset in sorted(pieces, key=lambda p: (p[0], p[1])):
            assert start == at[d] and n > 0
            at[d] += n
            of.setdefault(s, []).append((offset, n))
        assert (at == sizes).all()
        total, tail = 0, 0
        for v in of.values():
            v.sort()
            end = 0
            for offset, n in v:
                assert offset == end
                end += n
            assert 2048 - packing.GAP < end <= 2048 or end & (end - 1) == 0
            total += 0 if end & (end - 1) == 0 else 2048 - end
            tail += end < 2048 - packing.GAP
        assert tail <= 11 and total <= 0.016 * sizes.sum()
        # a piece is short only if its document is, or it is a document's end or in one of the sequences of powers of two
        size = {s: sum(n for _, n in v) for s, v in of.items()}
        assert all(n >= packing.GAP or size[s] < 2048 - packing.GAP or start + n == sizes[d] for d, start, n, s, _ in pieces)
        whole = int(np.ceil(sizes / 2048).sum())
        if len(sizes) == 5000:
            assert len(pieces) < whole * 1.02
            cost = [sum(n + n * n / 2048 for _, n in v) for v in of.values() if sum(n for _, n in v) > 2000]
            assert max(cost) < 1.15 * min(cost)


def test_packing_query(spark, tmp_path):
    """The registered query against the tokenizers library, on a table of its own."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r for r in corpus(n=20) if r[0] not in (None, 5)]
    out = packing.op7_pack(spark, table_of(spark, tmp_path, rows)).collect()
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    found = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        found[r.doc_id] = found.get(r.doc_id, []) + ids
    assert found == want and packing.op7_pack(spark, table_of(spark, tmp_path, [])).count() == 0


def table_of(spark, folder, rows, name="documents"):
    """A data directory with one table, for a registered query."""
    docs_of(spark, rows).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def chained(numbers, seed=42):
    """The engine's hash of several integers: each seeds the next."""
    for x, size in numbers:
        seed = xxhash.xxh64_intdigest((x & (1 << 8 * size) - 1).to_bytes(size, "little"), seed)
    return seed


def brute_signature(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    hashes = [(xxhash.xxh64_intdigest(w.encode(), 42), 8) for w in words]
    shingles = [chained(hashes[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
    bins = {}
    for h in shingles:
        bins[h >> 57] = min(bins.get(h >> 57, 1 << 64), h)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    nearest = lambda b: min(signed(chained([(b, 4), (j, 4)]) & ~127 | j) for j in bins) & 127
    return [bins[b if b in bins else nearest(b)] & 255 for b in range(128)] if bins else []


def brute_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    return min(1.0, max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 128 - 1 / 256) / (1 - 1 / 256)))


@pytest.mark.parametrize("partitions", [1, 7])
def test_minhash_query(spark, tmp_path, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = [r for r in corpus(n=15) if r[0] != 5] + [(5, None), (77, "a" * 10), (78, "x y\nz é"), (79, " ".join("abcdefghij"))]
        rows = [r for k, r in enumerate(rows) if r[0] is not None or k == min(i for i, x in enumerate(rows) if x[0] is None)]  # one null id
        rows.append(rows[3])  # a repeated row
        found = minhash.op4_minhash(spark, table_of(spark, tmp_path, rows)).collect()
        order = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is None, -(x[0] or 0)))
        want = Counter()
        for i, t in rows:
            following = order[(order.index((i, t or "")) + 1) % len(order)][1]
            t = t or ""
            third = len(t) // 3
            edited = t[: len(t) - third] + following[:third]
            own, other, after = map(brute_signature, (t, edited, following))
            want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), bytes(own).hex(), bytes(other).hex(), round(brute_likeness(own, other), 9), round(brute_likeness(own, after), 9)] += 1
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == want
        one = minhash.op4_minhash(spark, table_of(spark, tmp_path, [(1, "one two three four five six")])).collect()
        assert [r.near_next for r in one] == [1.0]
        assert minhash.op4_minhash(spark, table_of(spark, tmp_path, [])).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_minhash_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([("a b c d e f", 1, "x", 2.0, "y")], "text string, w int, row string, __s double, s string")
    out = minhash.with_signature(df, "text", "sig")
    assert out.columns == [*df.columns, "sig"] and tuple(out.first())[:5] == tuple(df.first())
    again = minhash.with_signature(out, "text", "s")
    assert again.columns == ["text", "w", "row", "__s", "sig", "s"] and again.first().s == again.first().sig


def test_minhash_estimates(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    pairs = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        n = int(400 * share)
        other = base[:n] + [f"v{rng.randrange(10**6)}" for _ in range(400 - n)]
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (base, other))
        pairs.append((" ".join(base), " ".join(other), len(a & b) / len(a | b)))
    df = spark.createDataFrame(pairs, "a string, b string, j double")
    df = minhash.with_signature(minhash.with_signature(df, "a", "sa"), "b", "sb")
    for r in df.select("j", minhash.likeness(F.col("sa"), F.col("sb")).alias("e")).collect():
        assert abs(r.j - r.e) < 0.16


def test_licenses(spark):
    notice = licenses.plain(licenses.TEMPLATES["Apache-2.0-notice"])
    changed = licenses.TEMPLATES["ISC-grant"].replace("purpose", "reason").replace("with or without fee", "with fee").replace("copies", "the copies")
    rows = [(1, f"one two {notice} three"), (2, f"A {changed} end"), (3, "nothing of the kind " * 50), (4, None), (5, ""), (6, f"{notice} x y z {notice}"), (None, notice), (None, notice)]
    out = licenses.scan(docs_of(spark, rows)).collect()
    count = Counter((r.doc_id, r.license_id) for r in out)
    assert count[1, "Apache-2.0-notice"] == 1 and count[2, "ISC-grant"] == 1 and count[6, "Apache-2.0-notice"] == 2 and count[None, "Apache-2.0-notice"] == 2
    assert not {3, 4, 5} & {r.doc_id for r in out}
    hit = next(r for r in out if r.doc_id == 1)
    assert rows[0][1][hit.span_start : hit.span_end] == notice and hit.coverage == 1.0
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_every_license_is_found_as_itself():
    index = licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        found = index.scan(f"Copyright 2020 by x {licenses.plain(text)} and more", {})
        assert [(f[0], f[1]) for f in found] == [(name, 1.0)]


@pytest.mark.parametrize("text, names", [
    ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0-notice"]),
    ("Licensed under CC BY-SA 3.0.", ["CC-BY-SA-3.0-notice"]),
    ("It is CC BY-SA 3.0.", []),
    ("Licensed under CC BY-SA 1.0.", []),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-notice"]),
    ("Parts are licensed under the GNU General Public License, version 4.", []),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0-notice"]),
    ("Licensed under the Apache License, Version 1.1.", []),
    (licenses.plain(licenses.TEMPLATES["BSD-2-Clause"]).replace("HOLDERS", "OWNERS"), ["BSD-2-Clause"]),
    (licenses.plain(licenses.TEMPLATES["GPL-3.0"]).replace("version 3", "version 2"), ["GPL-2.0"]),
    (licenses.plain(licenses.TEMPLATES["GPL-3.0"]).replace("version 3", "version 4"), []),
])
def test_other_versions_are_no_findings(text, names):
    assert [f[0] for f in licenses.Index(licenses.TEMPLATES).scan(f"a b c {text} d e f", {})] == names


def test_many_notices_in_one_text():
    import time

    index, began = licenses.Index(licenses.TEMPLATES), time.process_time()
    found = index.scan("Licensed under the Apache License, Version 2.0. and some more words. " * 20000, {})
    assert len(found) == 20000 and time.process_time() - began < 10


def test_licenses_as_by_alignment_of_every_place(spark):
    """The index leaves out no finding that an alignment of all templates at all places of the text has, where as many words are shared in a row as it promises."""
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    docs = [t for t in docs if len(t) < 3000 and re.search("icens|copyright", t)][:12]
    rng, short = random.Random(3), {k: v for k, v in licenses.TEMPLATES.items() if len(v.split()) < 70}
    for name in sorted(short):
        words = licenses.plain(short[name]).split()
        if len(words) > 30:
            words[rng.randrange(5, len(words))] = "odd"
            words.insert(rng.randrange(len(words)), "more")
        docs.append(" ".join([*(rng.choice("ab cd ef".split()) for _ in range(30)), *words, *(rng.choice("ab cd ef".split()) for _ in range(30))]))
    index = licenses.Index(short)
    findings = 0
    for text in docs:
        ids = np.array([index.vocabulary.get(w, -1) for w in map(licenses.norm, text.split()) if w], np.int64)
        everywhere = [(t, d) for t in range(len(index.names)) for d in range(-len(index.words[t]) + 1, len(ids), licenses.BAND)]
        want = index.findings(ids, everywhere)
        assert index.findings(ids, index.candidates(ids)) == want
        findings += len(want)
    assert findings > 40


def test_license_lines_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {(r.doc_id, r.license_id) for r in licenses.op6_license_scan(spark, "/root/testdata/sf0.01").collect()}
    for notice, text in licenses.TEMPLATES.items():
        if notice.endswith("-notice"):
            assert {(r.doc_id, notice) for r in docs.where(F.col("text").contains(licenses.plain(text))).collect()} == {x for x in found if x[1] == notice}


def test_toxicity(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "kmprst" for b in ("ola", "ine", "uro", "esk", "am")]
    rows, labels = [], []
    for i in range(600):
        t = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if bad := i % 4 == 0:
            for _ in range(rng.randint(1, 4)):
                t.insert(rng.randrange(len(t)), rng.choice(["Grolm", "grolming", "vuxter,"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    rows += [(700, None), (701, ""), (None, "grolm"), (3, rows[3][1])]
    labels += [(None, 1), (9, None)]
    docs = docs_of(spark, rows)
    model, limits = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.score(docs, model, limits).collect()
    truth = {i: y for i, y in labels if i is not None and y is not None}
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = np.mean([(r["__score"] >= 0.5) == truth[r.doc_id] for r in held])
    assert right > 0.95 and len(out) == len(rows)
    assert all(r["__score"] < 0.5 for r in out if r.doc_id in (700, 701))
    none, limits = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["__score"] < 0.5 for r in toxicity.score(docs, none, limits).collect())
    assert toxicity.score(docs_of(spark, []), model, limits).count() == 0


def brute_shards(rows, limit):
    """(bits, bytes) of each of ``rows`` (bits of the hash, size), where only buckets over the limit are split."""
    out = {}

    def split(members, prefix):
        size = sum(rows[k][1] for k in members)
        if size <= limit or len(members) == 1 or len(prefix) == 64:
            out.update({k: (prefix, size) for k in members})
            return
        for bit in "01":
            if inside := [k for k in members if rows[k][0][len(prefix)] == bit]:
                split(inside, prefix + bit)

    if rows:
        split(range(len(rows)), "")
    return out


@pytest.mark.parametrize("limit", [400, 5000, 10**9])
def test_sharding(spark, limit):
    rows = corpus(n=80) + [(9000, "same")] * 300
    out = sharding.assign(docs_of(spark, rows), limit).collect()  # a column named shard is replaced
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows) and all(r["__x"] == "z" for r in out)
    size, count = Counter(), Counter()
    for r in out:
        size[r.shard] += len((r.text or "").encode())
        count[r.shard] += 1
    assert all(n <= limit or count[s] == 1 for s, n in size.items()) and all(r.shard_bytes == size[r.shard] for r in out)
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    # only what is over the limit was split: a shard and what lies beside it don't fit together
    for s in names:
        if s:
            assert sum(n for t, n in size.items() if t.startswith(s[:-1])) > limit
    assert sharding.assign(docs_of(spark, []), limit).count() == 0


def test_sharding_query(spark, tmp_path, monkeypatch):
    rows = [r for r in corpus(n=80) if r[0] is not None] + [(9000 + k, "word " * k) for k in range(200)]
    monkeypatch.setattr(sharding.assign, "__defaults__", (3000, *sharding.assign.__defaults__[1:]))
    found = sharding.op9_extendible_sharding(spark, table_of(spark, tmp_path, rows)).collect()
    hashed = lambda t: 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
    keyed = [(f"{chained([(i, 8), (hashed(t), 8)]):064b}", len((t or "").encode())) for i, t in rows]
    # rows that repeat in full share a hash and are told apart by their place, which is not part of the test
    assert len({k for k, _ in keyed}) == len(keyed) - 2
    want = brute_shards(keyed, 3000)
    assert Counter((r.doc_id, r.shard, r.depth, r.shard_bytes, r.n_bytes) for r in found) == Counter((i, want[k][0], len(want[k][0]), want[k][1], keyed[k][1]) for k, (i, _) in enumerate(rows))
    assert sharding.op9_extendible_sharding(spark, table_of(spark, tmp_path, [])).count() == 0


def test_written_shards(spark, tmp_path):
    rows = corpus(n=40)
    sharding.write_shards(docs_of(spark, rows), str(tmp_path / "out"), 2000)
    folders = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert len(folders) > 5 and all(len(list((tmp_path / "out" / f).glob("*.parquet"))) == 1 for f in folders)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def want_with(rows):
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in {(i, tuple(v)) for i, v in ok if i % 100 == 0}:
        dot = lambda b: min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))
        best = sorted((-dot(b), i) for i, b in ok if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    return want


def test_voronoi_sends_little_of_clustered_data(spark, monkeypatch):
    """Sixty tight clusters: a group of queries needs few cells, and its queries go to the blocks of these alone."""
    monkeypatch.setattr(voronoi, "BLOCK", 100)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, (centres[i % 60] + rng.normal(size=16) * 0.004).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    celled, plan, sizes, _ = voronoi.grouped(voronoi.scaled(df, 1024.0), 10, 100)
    groups = {g for _, g, *_ in plan}
    share = sum(sizes[c] for c, *_ in plan) / (len(groups) * 6000)
    assert sum(sizes.values()) == 6000 and share < 0.15
    visits = sum(blocks for _, blocks in {(g, blocks) for _, g, _, blocks, _ in plan})
    assert visits < 0.2 * len(groups) * 60
    assert sorted(map(tuple, voronoi.top_k(df).collect())) == sorted(want_with(rows))


@pytest.mark.parametrize("queries, block", [(4096, 16384), (2, 50)])
def test_voronoi(spark, monkeypatch, queries, block):
    monkeypatch.setattr(voronoi, "QUERIES", queries)
    monkeypatch.setattr(voronoi, "BLOCK", block)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] + rng.normal(size=6) * 0.05).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(500, None), (501, [1.0, None, 2.0]), (502, [float("nan")] * 6), (None, [1.0] * 6), (503, [3.0]), (504, []), (505, [1e9] * 6), (600, [1e9] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cell string, v int")
    out = sorted(voronoi.top_k(df, k=10).collect())
    want = want_with(rows)
    assert [tuple(r) for r in out] == sorted(want)
    assert voronoi.top_k(df.where("vec_id < 0")).count() == 0
    # rows that repeat a query are one query, and its copies are no answers
    twelve = df.union(df.where("vec_id = 100")).union(df.where("vec_id = 200").crossJoin(spark.range(12)).drop("id"))
    assert sorted(map(tuple, voronoi.top_k(twelve).where("query_id IN (0, 100, 200)").collect())) == [w for w in sorted(want_with(rows + [rows[100]] + [rows[200]] * 12)) if w[0] in (0, 100, 200)]
    assert voronoi.top_k(df.where("vec_id = 0")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a <| b \\ <\\| <|end|>\n"), (1, 1, "assistant", "x\\"), (1, 1, "assistant", "x\\"), (1, None, None, None), (None, 0, "assistant", "<"), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(df.select("*", chat.as_parts(F.col("text")).alias("parts")))
    back = {r.conv_id: r for r in chat.parse_chats(chats).select("*", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in back[1].turns] == [("", ""), ("user", rows[0][3]), ("assistant", "x\\"), ("assistant", "x\\")]
    assert back[1].loss == "x\\x\\" and back[None].loss == "<" and back[2].loss == ""
    assert chat.format_chats(df.where("conv_id = 9").select("*", chat.as_parts(F.col("text")).alias("parts"))).count() == 0


def test_chat_attachments(spark):
    null = "CAST(NULL AS INT)"
    df = spark.sql(f"""SELECT 1L conv_id, 0L turn, 'user' role, array(
        named_struct('type', 'text', 'text', 'see <|image|>', 'ref', NULL, 'width', {null}, 'height', {null}, 'seconds', CAST(NULL AS DOUBLE), 'pages', {null}),
        named_struct('type', 'image', 'text', NULL, 'ref', 'i.png', 'width', 57, 'height', 28, 'seconds', NULL, 'pages', NULL),
        named_struct('type', 'audio', 'text', NULL, 'ref', 'a.wav', 'width', NULL, 'height', NULL, 'seconds', 2.02D, 'pages', NULL),
        named_struct('type', 'document', 'text', NULL, 'ref', 'd.pdf', 'width', NULL, 'height', NULL, 'seconds', NULL, 'pages', 2)) parts""")
    r = chat.format_chats(df.select("conv_id", "turn", "role", F.col("parts").cast(chat.PARTS).alias("parts"))).first()
    assert r.formatted == "<|turn|>user<|says|>see <\\|image|><|image|><|audio|><|document|><|end|>\n"
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 3), ("audio", "a.wav", 51), ("document", "d.pdf", 2048)]
    assert r.attachment_tokens == 2102


@pytest.mark.parametrize("texts", [["<", "|end|>\n<|turn|>assistant<|says|>no"], ["a<", "", None, "|turn|>"], ["\\", "<", "|"], ["<\\", "|end|>\n"], [None, "|", "<|"], []])
def test_control_strings_do_not_arise_where_parts_meet(spark, texts):
    part = lambda t, kind="text": (kind, t, None, None, None, None, None)
    parts = [part(t) for t in texts]
    rows = [(1, 0, "user", parts), (1, 1, "assistant<", [*parts, part(None, "image"), *parts]), (2, 0, "user", None)]
    chats = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}"))
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.parse_chats(chats).collect()}
    said = "".join(t or "" for t in texts)
    assert back == {1: [("user", said), ("assistant<", said + "<|image|>" + said)], 2: [("user", "")]}


def test_pipeline_on_odd_rows(spark):
    from codeloom.llm import pipeline as corpus_pipeline

    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (1, text), (2, text), (None, None), (None, "x y z"), (3, ""), (4, "é" * 60 + "a"), (5, "é" * 60 + "b")]
    for given in (rows, []):
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            if k + 1 < len(corpus_pipeline.STAGES):
                docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() > 0 if given else docs.count() == 0
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()}
    assert kept == {(1, text), (None, "x y z"), (3, ""), *rows[6:]}
    cut = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert cut[2] == "" and cut[4] == rows[6][1] and cut[5] == "b" and cut[3] == ""


def test_pipeline_as_by_brute_force(spark, tmp_path):
    """The whole run: planted toxic words, near copies by all pairs, passages by all windows, ids by the tokenizers library."""
    import corpus_pipeline

    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "kmprst" for b in ("ola", "ine", "uro", "esk", "am") for c in ("", "to", "ri", "ve")]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows, labels = [], []
    for i in range(400):
        t = [rng.choice(words) for _ in range(rng.randint(40, 120))]
        if bad := i % 4 == 0:
            for _ in range(6):
                t.insert(rng.randrange(len(t)), rng.choice(["grolm", "grolming", "vuxter"]))
        if i % 19 == 1:
            t[10:10] = passage.split()
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    for i in range(400, 460):  # copies, exact and near
        t = rows[rng.randrange(1, 100) * 4 - 1][1].split()
        for _ in range(rng.choice([0, 1, 2, 9])):
            t[rng.randrange(len(t))] = "other"
        rows.append((i, " ".join(t)))
    rng.shuffle(rows)
    docs_of(spark, rows).drop("part", "fp", "shard", "__x").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = sorted(r for r in rows if not re.search("grolm|vuxter", r[1]))

    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(max(1, len(w) - 4))} for i, t in left}
    group = {i: i for i in sets}
    while True:
        before = dict(group)
        for a in sets:
            for b in sets:
                if a < b and group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    left = [(i, t) for i, t in left if group[i] == i]
    assert 250 < len(left) < 330

    seen, cut, removed = set(), {}, 0
    for i, t in left:  # ascending: a window is cut if a smaller document has it
        windows = [t[p : p + 50] for p in range(len(t) - 49)]
        gone = np.zeros(len(t), bool)
        for p, w in enumerate(windows):
            if w in seen:
                gone[p : p + 50] = True
        cut[i] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
        seen |= set(windows)
        removed += int(gone.sum())
    assert removed > 3000
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in cut.items()}
    found = {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        found[r.doc_id] = found.get(r.doc_id, []) + ids
    assert found == want


def test_pipeline(spark):
    from codeloom.llm import pipeline as corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
            after = spark.createDataFrame(after.collect(), docs.schema)
            assert 0 < after.count() <= docs.count()
        docs = after
    assert docs.count() > 0


def test_toxicity_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(3)
    model, words = toxicity.Cnn(rng), [f"w{i}" for i in range(30)]
    model.emb = rng.normal(0, 1, model.emb.shape).astype(np.float32)
    model.emb[0] = 0
    texts = [None, "", "w1", *(" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(200))]
    alone = np.concatenate([model.logits([t], toxicity.Words()) for t in texts])
    for order in (range(len(texts)), rng.permutation(len(texts)).tolist()):
        assert (model.logits([texts[i] for i in order], toxicity.Words()) == alone[list(order)]).all()


def test_toxicity_thresholds_of_rare_languages(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        t = [rng.choice("kola mine puro resk sam tine".split()) for _ in range(12)]
        if i % 3 == 0:
            t[rng.randrange(12)] = "grolm"
        rows.append((i, " ".join(t), "xx" if i % 50 < 3 else "en"))
        labels.append((i, int(i % 3 == 0)))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model, limits = toxicity.train(docs, truth, sample=100)
    assert set(limits) == {None, "en", "xx"}
    # shifted logits of one language move its threshold by all labelled rows, and the others' do not follow
    raw = docs.join(truth, "doc_id").select("doc_id", "lang", F.when(F.col("lang") == "xx", 3.0).otherwise(0.0).alias("d"), "toxic")
    raw = raw.withColumn("__logit", F.col("d") + F.when(F.col("toxic") == 1, 1.0).otherwise(-1.0))
    shift, limits = toxicity.calibrate(raw.drop("toxic", "d"), truth, [0, 1, 2])
    assert abs(shift) < 1 and abs(limits["en"] - 0.5) < 0.25 and limits["xx"] > 1 / (1 + np.exp(-1.9))
    assert toxicity.calibrate(raw.drop("toxic", "d").where("doc_id < 0"), truth, []) == (0.0, {None: 0.5})


def test_near_copies(spark):
    from codeloom.llm import pipeline as corpus_pipeline

    rng = random.Random(8)
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 900]))]
        rows.append((1000 + i, " ".join(words)))
        for k in rng.sample(range(len(words)), rng.randint(1, len(words) // 25)):
            words[k] = f"v{rng.randrange(5000)}"
        rows.append((2000 + i, "  ".join(words).upper()))
    rows += [(3000, rows[0][1]), (None, rows[0][1] + " more"), (3001, None), (3002, ""), (3003, "two words"), (3004, "two  Words"), (3005, "two word")]
    rng.shuffle(rows)

    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()}
    texts = dict(rows)
    like = lambda i, j: len(sets(texts[i]) & sets(texts[j])) / len(sets(texts[i]) | sets(texts[j]))
    copies = [2000 + i for i in range(120) if like(1000 + i, 2000 + i) >= 0.8]
    assert 60 < len(copies) < 120
    assert kept == {i for i, _ in rows} - set(copies) - {3000, None, 3002, 3004}


@pytest.mark.parametrize("block, size", [(2048, 32 << 20), (7, 32 << 20), (2048, 3000)])
def test_near_copies_are_grouped_as_by_brute_force(spark, monkeypatch, block, size):
    from codeloom.llm import near_copies

    for name, value in (("BLOCK", block), ("BYTES", size)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words[8 * k : 8 * k + 120]) for k in range(20)]  # a chain: each is near the next only
    base = [f"v{k}" for k in range(150)]
    for _ in range(70):  # edits of one text, many of which are not near one another
        t = base[:]
        for k in rng.sample(range(150), rng.choice([1, 2, 4, 8, 12, 16])):
            t[k] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame([(k, 1000 - k, t) for k, t in enumerate(texts)], "id long, h long, text string")
    sets = [near_copies.shingles(t) for t in texts]
    label = list(range(len(texts)))
    while True:
        before = label[:]
        for a in range(len(texts)):
            for b in range(a):
                if near_copies.likeness(sets[a], sets[b]) >= 0.8:
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    kept = sorted(r.id for r in near_copies.staying(docs).collect())
    assert kept == sorted(set(label)) and 5 < len(kept) < 60
    assert near_copies.staying(docs.where("id < 0")).count() == 0


def test_pipeline_keeps_the_authors_replacement_characters(spark):
    from codeloom.llm import pipeline as corpus_pipeline

    rows = [(1, "é" * 60 + "a"), (2, "�x�" + "é" * 60 + "b�"), (3, "è" + "é" * 60 + "� è"), (4, "Ω" * 40 + "ψ"), (5, "�" + "ο" * 3 + "Ω" * 40 + "ω"), (6, "�\x85" * 3), (7, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cut = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert cut[2] == "�x�b�" and cut[3] == "è� è" and cut[5] == "�οοο" and cut[6] == rows[5][1] and cut[7] is None


def test_columns_that_bear_the_operators_own_names(spark):
    from codeloom.llm import pipeline

    names = ["__part", "__kept", "__spans", "__id", "__hash", "__row", "__score", "__threshold", "__logit", "__text", "__w", "key", "root", "group", "block", "bucket", "cell", "base", "hash", "bytes", "place"]
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "en", "s", len(text), *names), (2, "x " + text, "en", "s", len(text) + 2, *names), (3, None, None, None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    plain = [n for n in names if not n.startswith("__") or n == "__w"]
    for df in (suffix_dedup.dedup(docs), sharding.assign(docs, 50), minhash.with_signature(docs, "text", "sig"), toxicity.score(docs, *toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int")))):
        found = {r.doc_id: r for r in df.collect()}
        assert set(found) == {1, 2, 3} and all(found[i][n] == n for i in found for n in plain)
    assert simhash.classes(docs).count() == bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 3 and licenses.scan(docs).count() == 0
    for _, stage in pipeline.STAGES[:3]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.drop(*pipeline.OWN).columns and {3} < {r.doc_id for r in left.collect()} <= {1, 2, 3}
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"), *plain)
    assert voronoi.top_k(vectors, every=1).count() == 6
