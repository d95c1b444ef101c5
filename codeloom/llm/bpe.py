"""Byte-pair encoding and decoding by batched numpy merge rounds, for tokenizers-library files.

The file's model (vocabulary, merges, end-of-word suffix), normalizer and split pattern are read from
its JSON; nothing is trained. Words that a worker has not seen lately are encoded together: the symbols
of all of them lie in one flat array. In each round every adjacent pair of a word is looked up by binary
search in the sorted pair keys, each word's lowest-rank pair is merged wherever it stands (from the left,
without overlap), and the rounds end when no word has a mergeable pair.

Defined results: null and empty texts have no ids and decode to the empty string; very long texts are
cut into words like any other; special-token strings in a text become their ids, as in the library; repeated rows
are encoded each; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import regex

#: Split pattern of the byte-level pre-tokenizer (a fixed value of the vocabulary's publisher).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of the library's regular expressions; Python's also has U+001C to U+001F.
SPACES = r"[\t-\r\x20\x85\xa0  -     　]"
NOT_SPACES = SPACES.replace("[", "[^", 1)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    chars = dict(zip(plain, map(chr, plain), strict=True)) | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


class Bpe:
    """Encoder and decoder of one tokenizer file.

    The cache holds the words of two spans of input: when the newer fills up, it becomes the older, which is dropped.
    """

    CACHE = 1 << 20

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.cache_size = spec["model"], cache
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain BPE file")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens of this kind are not supported")
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.steps = self._steps(spec["normalizer"])
        self.pattern = self._pattern(spec["pre_tokenizer"])
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        chars = byte_chars()
        self.chars, self.bytes_of = chars, {c: b for b, c in enumerate(chars)}
        self.first = np.array([self.ids.get(c, -1) for c in chars], np.int64)
        self.last = np.array([self.ids.get(c + self.suffix, -1) for c in chars], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([self.ids[a] << 32 | self.ids[b] for a, b in pairs], np.int64)
        into = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.into = key[order], order.astype(np.int64), into
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._empty()
        #: The pattern never matches white space, so any white space bounds words; else a lone space or line feed between other characters does.
        self.drops_space = spec["pre_tokenizer"]["type"] == "Sequence" and not self.pattern.search(" \n\t\u00a0\u3000")
        self.odd = regex.compile("[\x1c-\x1f]").search  # Python's split() takes these for white space
        self.uneven = re.compile(r"\s\s").search
        if self.drops_space:
            self.steps = [f for f in self.steps if f.__name__ != "spaced"]

    @staticmethod
    def _steps(spec) -> list:
        """Normalizing functions. Lower-casing is by character, without the context that Python gives a final sigma."""
        parts = [] if spec is None else spec["normalizers"] if spec["type"] == "Sequence" else [spec]
        steps = []
        for p in parts:
            if p["type"] == "NFC":
                steps.append(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t))
            elif p["type"] == "Lowercase":
                steps.append(lambda t: t.lower() if "Σ" not in t else "".join(c.lower() for c in t))
            elif p["type"] == "Replace" and p["pattern"] == {"Regex": r"\s+"}:

                def spaced(t, r=regex.compile(f"{SPACES}+"), to=p["content"]):
                    return r.sub(to, t)

                steps.append(spaced)
            else:
                raise ValueError(f"normalizer {p} is not supported")
        return steps

    @staticmethod
    def _pattern(spec):
        parts = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
        for p in parts:
            if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]:
                found = p["pattern"]["Regex"]
                break
            if p["type"] == "ByteLevel" and p["use_regex"] and not p["add_prefix_space"]:
                found = BYTE_LEVEL
                break
        else:
            raise ValueError(f"pre-tokenizer {spec} is not supported")
        inner = SPACES[1:-1]
        return regex.compile(regex.sub(r"\[\^\\s", lambda _: "[^" + inner, found).replace(r"\s", SPACES).replace(r"\S", NOT_SPACES))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, by binary search in the sorted keys; the number of merges for pairs that never merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids, as little-endian uint32, of each word (a match of the split pattern)."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.first[flat]
        ends = np.cumsum(size)
        sym[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), size)
        none = len(self.keys)
        rank = np.append(self.ranks(sym[:-1], sym[1:]), none)
        rank[ends - 1] = none
        done_sym, done_word = [], []
        while len(sym):
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(sym)))
            mine = np.repeat(best, length)
            if not (still := best < none).all():  # words that are ready leave the array
                over = ~np.repeat(still, length)
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, mine = sym[~over], word[~over], rank[~over], mine[~over]
                if not len(sym):
                    break
            p = np.flatnonzero(rank == mine)
            # of hits side by side (a run of one symbol) every second one, from the left
            first = np.flatnonzero(np.append(True, np.diff(p) != 1))
            run = np.repeat(first, np.diff(np.append(first, len(p))))
            p = p[(np.arange(len(p)) - run) % 2 == 0]
            sym[p] = self.into[rank[p]]
            keep = np.ones(len(sym), bool)
            keep[p + 1] = False
            rank[p] = rank[p + 1]  # only to know where a word ends
            last = np.append(word[1:] != word[:-1], True)[p + 1]
            sym, word, rank = sym[keep], word[keep], rank[keep]
            p -= np.arange(len(p))
            rank[p[last]] = none
            right, left = p[~last], p[(p > 0) & (word[p - 1] == word[p])] - 1
            rank[right] = self.ranks(sym[right], sym[right + 1])
            rank[left] = self.ranks(sym[left], sym[left + 1])
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        flat, bounds = sym[order].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *bounds], bounds, strict=False)]

    def _empty(self) -> None:
        self.words = dict((t, np.array([i], "<u4").tobytes()) for t, i in self.special.items())

    def _learn(self, chunks: set[str]) -> None:
        """Puts the ids of new chunks, as bytes, into the cache."""
        known, older = self.words, self.older
        if older:
            known.update([(c, older[c]) for c in chunks if c in older])
            chunks = [c for c in chunks if c not in known]
        whole, mixed = [], []  # letters, with or without a space before them, are one word
        for c in chunks:
            (whole if (c[1:] if c[:1] == " " else c).isalpha() else mixed).append(c)
        split = [(c, self.pattern.findall(c)) for c in mixed]
        whole += {w for _, p in split for w in p if w not in known}.difference(whole)
        if whole:
            known.update(zip(whole, self.merge_words(whole), strict=True))
        known.update([(c, b"".join([known[w] for w in p])) for c, p in split])

    def chunks(self, text: str) -> list[str]:
        """Pieces of a normalized text, cut where the split pattern surely has a boundary."""
        if self.drops_space:
            return text.split() if not self.odd(text) else [text]
        if self.uneven(text) or "\0" in text:
            return self.pattern.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def normalized(self, text: str) -> str:
        for f in self.steps:
            text = f(text)
        return text

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32; chunks new to the cache are encoded together."""
        if len(self.words) > self.cache_size:
            self.older = self.words  # what is used again comes back from there
            self._empty()
        parts: list[list[str]] = []
        found: list[list[bytes | None]] = []
        missing: list[tuple[list, int, str]] = []
        new: set[str] = set()
        get = self.words.get
        for t in texts:
            if not t:
                parts.append([])
            elif self.cut and any(s in t for s in self.special):
                # a special token is its own key in the cache; no other chunk can hold its text
                parts.append([x for piece in self.cut.split(t) for x in ([piece] if piece in self.special else self.chunks(self.normalized(piece)))])
            else:
                parts.append(self.chunks(self.normalized(t)))
            part, have = parts[-1], [*map(get, parts[-1])]
            at = -1
            for _ in range(have.count(None)):
                at = have.index(None, at + 1)
                new.add(part[at])
                missing.append((have, at, part[at]))
            found.append(have)
        if new:
            self._learn(new)
        for have, at, chunk in missing:
            have[at] = get(chunk)  # the dictionary that get belongs to is the current one until the next call
        return [*map(b"".join, found)]

    def decode(self, ids: bytes) -> str:
        """As the library: tokens joined by a space, or by the byte-level decoder where the file names one."""
        tokens = [*map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())]
        if not self.byte_decoder:
            return " ".join(tokens)
        return bytes(self.bytes_of[c] for t in tokens for c in t).decode("utf-8", "replace")


def load(path: str, cache: int = Bpe.CACHE) -> Bpe:
    """The worker process's encoder of a file. cache: words in a span of its cache, about 100 bytes each and two spans."""
    from codeloom.llm.common import held

    return held(("bpe", path, cache), lambda: Bpe(path, cache))


def blocks(texts: list, size: int = 1 << 20):
    """Ranges of rows of about ``size`` characters, at least one row each."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t or "") > size:
            yield begin, i
            begin, total = i, 0
        total += len(t or "")
    if begin < len(texts):
        yield begin, len(texts)


def encode_decode(docs, path: str):
    """``docs(doc_id, text)`` to doc_id, n_tokens, ids (little-endian uint32) and the decoded text, one row each."""
    import pyarrow as pa

    def run(batches):
        bpe = load(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for b, e in blocks(texts):
                ids = bpe.encode_batch(texts[b:e])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(b, e - b),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([bpe.decode(x) for x in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def op5_bpe(spark, sf_dir):
    import public_tokenizers
    from pyspark.sql import functions as F

    from codeloom.llm.common import table

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )
