"""Byte-pair encoding and decoding in batched numpy merge rounds (no tokenizer library).

For a lower-casing word vocabulary with an end-of-word suffix. Symbols of many words lie in one flat array;
in each round all neighbouring pairs are looked up by binary search over the sorted pair keys, every word's
lowest rank is found by a segmented minimum, and all occurrences of that pair (leftmost first where they
overlap) are merged. Words that have no mergeable pair leave the array. A memo of bounded size keeps the
ids of pieces already seen, so each distinct piece is encoded once per worker.

Null texts are empty and give no ids; texts of any length are processed whole; the strings of special
tokens become their ids; rows keep their multiplicity, other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_columns

#: No rank: the pair isn't merged.
NONE = np.int64(2**62)


def byte_alphabet() -> list[str]:
    """Printable stand-in of each byte: printable Latin-1 characters stand for themselves, the others
    take the code points from 256 on, in order."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class WordBPE:
    def __init__(self, path: str, most: int = 700_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        suffix = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.inner = np.array([vocab.get(c, -1) for c in alphabet], np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in alphabet], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.base = np.int64(max(vocab.values()) + 1)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split).findall
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.most = most
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, given as UTF-8 bytes, not empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        known = symbols >= 0
        symbols, owner = symbols[known], owner[known]
        done_symbols, done_owner = [], []
        while len(symbols) > 1:
            pair = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], NONE)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(np.append(rank, NONE), first)
            counts = np.diff(np.append(first, len(symbols)))
            live = np.repeat(lowest < NONE, counts)
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
                symbols, owner, at_all = symbols[live], owner[live], np.append(at, 0)[live]
                rank = np.append(rank, NONE)[live]
                lowest, counts = lowest[lowest < NONE], counts[lowest < NONE]
                if not len(symbols):
                    break
            else:
                at_all, rank = np.append(at, 0), np.append(rank, NONE)
            chosen = rank == np.repeat(lowest, counts)
            # of a run of neighbouring hits (one symbol repeated) every second is taken, from the left
            run_start = chosen & ~np.concatenate([[False], chosen[:-1]])
            place = np.arange(len(chosen))
            from_start = place - np.maximum.accumulate(np.where(run_start, place, 0))
            chosen &= from_start % 2 == 0
            hit = np.flatnonzero(chosen)
            symbols[hit] = self.made[at_all[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        done_symbols.append(symbols)
        done_owner.append(owner)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        symbols, owner = symbols[order].astype(np.uint32), owner[order]
        cut = np.searchsorted(owner, np.arange(1, len(words)))
        return np.split(symbols, cut)

    def _lower(self, text: str) -> str:
        return text.lower() if text.isascii() else "".join(c.lower() for c in text)

    def _learn(self, pieces: list[str]) -> None:
        found = [self.find(self._lower(p if p.isascii() else unicodedata.normalize("NFC", p))) for p in pieces]
        new = list({w for ws in found for w in ws}.difference(self.words))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for w, ids in zip(some, self.merge([w.encode() for w in some]), strict=True):
                self.words[w] = ids.tobytes()
        words = self.words
        for p, ws in zip(pieces, found, strict=True):
            self.pieces[p] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids (32-bit bytes) of texts without special tokens. No word spans a blank or line feed."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.pieces) > self.most:
            self.pieces.clear()
        if len(self.words) > self.most:
            self.words.clear()
        new = set().union(*cut).difference(self.pieces) if cut else set()
        if new:
            self._learn(list(new))
        known = self.pieces.__getitem__
        return [b"".join(map(known, c)) for c in cut]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        texts = [t or "" for t in texts]
        marked = [k for k, t in enumerate(texts) if "<|" in t and self.marks.search(t)]
        if not marked:
            return self._plain(texts)
        odd = set(marked)
        plain = iter(self._plain([t for k, t in enumerate(texts) if k not in odd]))
        out = []
        for k, t in enumerate(texts):
            if k not in odd:
                out.append(next(plain))
                continue
            names = self.marks.findall(t)
            parts = self._plain(self.marks.split(t))
            ids = [parts[0]]
            for name, part in zip(names, parts[1:], strict=True):
                ids += [array("I", [self.special[name]]).tobytes(), part]
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        """Token strings joined by a blank (the vocabulary has no decoder of its own)."""
        return " ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))


_held: dict[str, WordBPE] = {}


def _tool(path: str) -> WordBPE:
    if path not in _held:
        _held[path] = WordBPE(path)
    return _held[path]


def encode(docs: DataFrame, path: str, decoded: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and, if asked for, the text that decoding gives back."""
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("decoded", pa.string())] * decoded
    schema = pa.schema(fields)

    def run(batches):
        tool = _tool(path)
        for batch in batches:
            keys, texts = batch_columns(batch, "doc_id", "text")
            for at in range(0, len(keys), 500):
                raws = tool.encode(texts[at : at + 500])
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raws])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raws), np.int32)))
                columns = [pa.array(keys[at : at + 500], pa.int64()), ids] + [pa.array(map(tool.decode, raws), pa.string())] * decoded
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)
