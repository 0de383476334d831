"""Token ids by a public tokenizer file, word by word from a bounded memo."""

from __future__ import annotations

import os
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A small letter (folding leaves it a letter), one mark and a space: such a mark is a piece by itself.
MARK = (r"(\p{Ll})([.,;:!?]) ", r"\1 \2 ")
_OPEN: dict[tuple, "Encoder"] = {}


def _strings(words: pa.Array) -> list[str]:
    """Words without spaces as Python strings, by one join and one split."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ")


class Encoder:
    """Ids of whole texts, equal to those of the tokenizer on the whole text.

    ``keep_space``: the tokenizer cuts before a single space that a word follows (byte-level); texts are then encoded
    by such pieces.  Otherwise white space only separates and letters are folded, and the pieces are the words, without
    one mark that ends them, which the tokenizer takes by itself too.  A text where this may not hold
    (a space before white space or at the end, a special token) is encoded whole.
    The memo holds at most ``limit`` pieces: the older half goes when the newer half is full.
    """

    def __init__(self, path: str, keep_space: bool, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.keep_space, self.half = keep_space, limit // 2
        if keep_space:  # the byte-level name of a space
            names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
            self.spaced = np.array([(n or "").startswith("\u0120") for n in names])
        else:  # a special token, which ends whatever stands before it
            self.mark = next(((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special), None)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def fresh(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece by the tokenizer.

        Pieces are encoded as one text: those of a space and a word as they are, since a token begins with a space only
        where a piece does, words with a special token between them.  The others, and all if the pieces are not found
        again, go one by one.
        """
        if not self.keep_space and self.mark and not any("<|" in p for p in pieces):
            ids = np.array(self._encode([self.mark[0].join(pieces)])[0].ids, "<u4")
            at = np.flatnonzero(ids == self.mark[1])
            if len(at) == len(pieces) - 1:
                raw, cuts = ids.tobytes(), (4 * at).tolist()
                return [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)])]
        if self.keep_space:
            plain = [p[:1] == " " and p[1:2].strip() != "" and "<|" not in p for p in pieces]
            joined = [p for p, ok in zip(pieces, plain) if ok]
            ids = np.array(self._encode(["".join(joined)])[0].ids, "<u4")
            at = 4 * np.flatnonzero(self.spaced[ids])
            if len(at) == len(joined) and (not len(at) or not at[0]):
                raw, cuts = ids.tobytes(), [*at.tolist(), 4 * len(ids)]
                made = iter([raw[a:b] for a, b in zip(cuts, cuts[1:])])
                rest = iter(self._single([p for p, ok in zip(pieces, plain) if not ok]))
                return [next(made if ok else rest) for ok in plain]
        return self._single(pieces)

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _single(self, texts: list[str]) -> list[bytes]:
        return [pack(f"<{len(e.ids)}I", *e.ids) for e in self._encode(texts)]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.new.get, pieces))
        missing = []
        for i in [i for i, f in enumerate(found) if f is None]:
            f = self.old.get(pieces[i])
            if f is None:
                missing.append(i)
            else:
                found[i] = self.new[pieces[i]] = f
        for at in range(0, len(missing), 4096):
            part = [pieces[i] for i in missing[at:at + 4096]]
            for i, p, ids in zip(missing[at:at + 4096], part, self.fresh(part)):
                found[i] = self.new[p] = ids
            if len(self.new) >= self.half:
                self.old, self.new = self.new, {}
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "")
        split = texts
        if not self.keep_space:
            split = pc.replace_substring_regex(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), *MARK)
        lists = pc.split_pattern(split, " ")
        ends = np.asarray(lists.value_lengths(), np.int64).cumsum()
        starts = np.concatenate([[0], ends[:-1]])
        coded = lists.flatten().dictionary_encode()
        words, index = _strings(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
        odd = np.asarray(pc.match_substring(coded.dictionary, "<|"), bool)
        if self.keep_space:
            firsts, where = np.unique(index[starts], return_inverse=True)
            head = pc.utf8_slice_codeunits(coded.dictionary, 0, 1)
            gap = np.asarray(pc.or_(pc.equal(head, ""), pc.utf8_is_space(head)), bool)
            odd = np.concatenate([odd | gap, odd[firsts]])
            pieces = [" " + w for w in words] + [words[i] for i in firsts]
            index[starts] = len(words) + where
        else:
            pieces = words
        blobs = self.pieces(pieces)
        ids = np.frombuffer(b"".join(blobs), "<u4")
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        begins = np.cumsum(sizes) - sizes
        n = sizes[index]
        at = np.cumsum(n)
        flat = ids[np.arange(at[-1]) + np.repeat(begins[index] - (at - n), n)]
        counts = np.add.reduceat(n, starts)
        whole = np.flatnonzero(np.logical_or.reduceat(odd[index], starts))
        if len(whole):
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for i in whole:
                parts[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
            flat, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return flat.astype(np.uint32, copy=False), counts


def encoder(path: str, keep_space: bool) -> Encoder:
    """The worker's encoder for a file; it lives as long as the worker."""
    key = (path, keep_space)
    if key not in _OPEN:
        _OPEN[key] = Encoder(path, keep_space)
    return _OPEN[key]


def slices(column: pa.Array, most: int = 3 << 20) -> list[tuple[int, int]]:
    """Row ranges of a text column with about ``most`` bytes each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    out, start, held = [], 0, 0
    for i, s in enumerate(sizes):
        if held and held + s > most:
            out.append((start, i))
            start, held = i, 0
        held += int(s)
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out
