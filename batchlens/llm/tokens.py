"""Token ids of texts by the tokenizers library, each distinct piece between blanks encoded once.

A batch of texts is cut at single blanks and dictionary-encoded by Arrow. Each distinct piece is taken apart into its stem
and closing marks (a letter followed by a mark always ends a token); stems that aren't known yet go through the library, many
in one call, kept apart by a special token, which no piece can join across. The ids of all pieces are then gathered by
their places in one flat store. A text with two blanks in a row, white space beside a blank or the string of a special token
is encoded whole by the library. The store is cleared when it holds more than ``most`` stems.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Closing marks that are never part of a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_{|}~"
#: Letters up to here (Latin) surely are letters to the library too; İ in lower case ends in a combining mark.
LAST = "\u024f"
#: Stems in one call of the library.
CALL = 20_000
#: Bytes of text handled at once.
SLICE_BYTES = 8 << 20
#: Stems that a worker remembers.
MEMO = 700_000


def vocabulary(name: str) -> str:
    """Place of an installed public vocabulary file (also on the executors)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class PieceEncoder:
    """``lead``: the blank before a piece belongs to it (byte-level vocabularies); else blanks and line feeds only
    separate and letters lose their case."""

    def __init__(self, path: str, lead: bool, most: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.lead, self.most = lead, most
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.mark = next(iter(self.special))
        names = self.library.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(names.values()) + 1, np.int64)  # of every token: one character of its name stands for a byte
        for name, k in names.items():
            self.bytes[k] = len(name.removesuffix("</w>"))
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _odd(self, pieces: list[str]) -> list[int]:
        """Pieces whose ids may depend on their neighbours."""
        out = [k for k, p in enumerate(pieces) if "<|" in p and any(s in p for s in self.special)]
        if self.lead:
            out += [k for k, p in enumerate(pieces) if len(p.strip()) != len(p) or not p or ("᠎" in p and not p.isascii())]
        return out

    def _marked(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of stems in a row, and where each begins and ends: kept apart by a special token."""
        own = self.special[self.mark]
        ids = np.array(self.library.encode_batch_fast([self.mark.join(stems)], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(np.append(ids, own) == own)
        return ids, np.append(0, cut[:-1] + 1), cut

    def _joined(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same without separators: no token reaches over the blank between two stems, so the bytes of the tokens tell
        the stems apart. Where the sums don't meet (a character was dropped or changed), the stems are marked."""
        text = "".join(stems) if self.lead else " ".join(stems)
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        have = np.cumsum(self.bytes[ids])
        want = np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in stems])
        ends = np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
        if not len(have) or have[-1] != want[-1] or (have[ends] != want).any():
            return self._marked(stems)
        return ids, np.append(0, ends[:-1] + 1), ends + 1

    def _learn(self, stems: list[str]) -> None:
        plain = [x for x in stems if x[:1] == " "] if self.lead else [x for x in stems if x.isascii()]
        rest = [x for x in stems if x[:1] != " "] if self.lead else [x for x in stems if not x.isascii()]
        starts, sizes = [self.starts], [self.sizes]
        for encode, some in ((self._joined, plain), (self._marked, rest)):
            for at in range(0, len(some), CALL):
                ids, first, end = encode(some[at : at + CALL])
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.append(self.ids, np.zeros(len(self.ids), np.uint32))
                self.ids[self.used : self.used + len(ids)] = ids
                starts.append(first + self.used)
                sizes.append(end - first)
                self.used += len(ids)
        n = len(self.starts)
        self.known.update(zip(plain + rest, range(n, n + len(stems)), strict=True))
        self.starts, self.sizes = np.concatenate(starts), np.concatenate(sizes)

    def _entries(self, pieces: list[str], lead: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry of the stem and of the closing marks of each piece (0: none); whether it is odd."""
        stems, marked, marks = list(pieces), [], []
        for k, (p, stem) in enumerate(zip(pieces, [p.rstrip(MARKS) for p in pieces], strict=True)):
            if len(stem) < len(p) and stem and stem[-1].isalpha() and stem[-1] <= LAST and stem[-1] != "İ":
                stems[k] = stem
                marked.append(k)
                marks.append(p[len(stem) :])
        odd, none = self._odd(pieces), set()
        if not self.lead:
            stems = [s.lower() if s.isascii() else s for s in stems]
        if lead:
            stems = [lead + s for s in stems]
        for k in odd:
            stems[k] = ""
            none.add(k)
        if none:
            marks = ["" if k in none else m for k, m in zip(marked, marks, strict=True)]
        known, n = self.known, len(pieces)
        new = list({*stems, *marks}.difference(known))
        if new:
            self._learn(new)
        mark, wrong = np.zeros(n, np.int64), np.zeros(n, bool)
        wrong[odd] = True
        mark[marked] = [known[m] for m in marks]
        return np.fromiter(map(known.__getitem__, stems), np.int64, n), mark, wrong

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most:
            self._clear()
        cut = pc.split_pattern(texts if self.lead else pc.replace_substring(texts, "\n", " "), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        names, idx = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        offsets -= offsets[0]
        n = len(names)
        if self.lead:  # a text's first piece has no blank before it
            first = np.zeros(len(idx), bool)
            first[offsets[:-1]] = True
            used = np.unique(idx[first])
            stem, mark, odd = self._entries(names, " ")
            s1, m1, o1 = self._entries([names[k] if names[k] else "." for k in used.tolist()], "")
            empty = np.array([not names[k] for k in used.tolist()], bool)
            s1[empty], m1[empty] = 0, 0
            place = np.zeros(n, np.int64)
            place[used] = np.arange(len(used)) + n
            stem, mark, odd = np.append(stem, s1), np.append(mark, m1), np.append(odd, o1)
            idx = np.where(first, place[idx], idx)
        else:
            stem, mark, odd = self._entries(names, "")
        per_stem, per_mark = self.sizes[stem], self.sizes[mark]
        per = (per_stem + per_mark)[idx]
        stops = np.cumsum(per)
        total = int(stops[-1]) if len(stops) else 0
        # ids of each distinct piece lie together in a small table, then every piece is gathered from it
        held = per_stem + per_mark
        table_at = np.cumsum(held) - held
        table = np.zeros(int(held.sum()), np.uint32)
        for sizes, entry, shift in ((per_stem, stem, 0), (per_mark, mark, per_stem)):
            end = np.cumsum(sizes)
            within = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - sizes, sizes)
            table[np.repeat(table_at + shift, sizes) + within] = self.ids[np.repeat(self.starts[entry], sizes) + within]
        ids = table[np.repeat((table_at[idx] - (stops - per)).astype(np.int32), per) + np.arange(total, dtype=np.int32)]
        ends = np.append(0, stops)[offsets]
        strange = np.flatnonzero(np.add.reduceat(np.append(odd[idx], False), offsets[:-1]) > 0) if len(texts) else []
        if self.lead and len(strange):  # an empty text is one empty piece, not an odd one
            strange = [k for k in strange.tolist() if texts[k].as_py()]
        if not len(strange):
            return ids, ends
        parts, sizes, at = [], np.diff(ends), 0
        for k in (int(x) for x in strange):
            whole = np.array(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
            parts += [ids[ends[at] : ends[k]], whole]
            sizes[k], at = len(whole), k + 1
        parts.append(ids[ends[at] :])
        return np.concatenate(parts), np.append(0, np.cumsum(sizes))

    def slices(self, texts: pa.Array):
        """(first text, ids of a run of texts, offsets of each of them) over an array of texts without nulls."""
        offsets = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            yield at, *self._slice(texts.slice(at, to - at))
            at = to


class ByteLevelEncoder(PieceEncoder):
    def __init__(self, path: str, most: int = MEMO):
        super().__init__(path, True, most)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit bytes."""
        out = []
        for _, ids, ends in self.slices(pa.array([t or "" for t in texts], pa.string())):
            out += [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return out


_held: dict[tuple, PieceEncoder] = {}


def piece_encoder(path: str, lead: bool, most: int = MEMO) -> PieceEncoder:
    """One encoder per worker process, file and size of the store (about 200 bytes a stem)."""
    key = (path, lead, most)
    if key not in _held:
        _held[key] = PieceEncoder(*key)
    return _held[key]
