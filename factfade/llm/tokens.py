"""Token ids of texts, used inside tasks.

Texts are cut where the tokenizer of the file cuts as well (before white space that
follows a word), every different piece is encoded once, and the ids of a text are
the ids of its pieces.  Signs behind a word are encoded apart.  Words and signs met
before are kept within bounds by each worker; the texts are cut, counted and put
together again in whole columns.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than a space or a line feed.  Texts that hold it, or white space
#: beside white space, are cut by pattern.
_ODD = re.compile(
    "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]"
)
_WORDS = re.compile(r"\s*\S+|\s+")
#: White space to Python but not to the tokenizers: such texts are never cut.
_UNSURE = re.compile("[\x1c-\x1f]")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A letter and an ASCII sign behind it are always cut apart.
_SIGNED = rf"\A(?P<stem>(?s:.*)[{_LETTERS}])(?P<sign>[!-/:-@\[-^`{{-~]+)\z"
_LETTERS_ALONE = re.compile(f"[{_LETTERS}]+")
_ONLY_LETTERS = rf"\A\n?[{_LETTERS}]+\z"

#: A piece after this mark stands for itself, any other one has a space before it
#: unless it begins with a line feed.
_AS_IS = "\x1c"

#: Units of one generation; a worker keeps two generations at most.
KEPT_PIECES = 450_000
LONGEST_KEPT = 48
SLICE_CHARS = 1 << 20
#: Characters that are encoded together: the more, the fewer units are looked up twice.
ENCODED_CHARS = 1 << 22


def _pieces(text: str) -> list[str]:
    cut = text.replace("\n", " \n")
    if "  " in cut or "\n\n" in text or _ODD.search(text):
        parts = [text] if _UNSURE.search(text) else _WORDS.findall(text)
        return [_AS_IS + p for p in parts]
    words = cut.split(" ")
    words[0] = _AS_IS + words[0]
    return words


def _spelled(piece: str) -> str:
    if piece[:1] == _AS_IS:
        return piece[1:]
    return piece if piece[:1] == "\n" else " " + piece


def _byte_signs() -> dict[int, str]:
    """The public byte-level rule: printable bytes stand for themselves, the others for
    the characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + n) for n, b in enumerate(others)}


_SIGN_OF_BYTE = _byte_signs()
_PROBES = ("the", "of", "xqzvwy", "straße", "élan", "ñandú")


class _Kept:
    """Units and their ids, in columns: a worker's memory holds a few dozen bytes a unit."""

    def __init__(self, units: pa.Array | None = None, ids=(), sizes=()):
        self.units = pa.array([], pa.large_string()) if units is None else units
        self.ids, self.sizes = np.asarray(ids, "<u4"), np.asarray(sizes, np.int32)

    def __len__(self) -> int:
        return len(self.units)

    def find(self, units: pa.Array) -> np.ndarray:
        """The place of each unit, -1 for unknown ones."""
        return np.array(pc.fill_null(pc.index_in(units, value_set=self.units), -1))

    def take(self, places: np.ndarray) -> "_Kept":
        sizes = self.sizes[places]
        return _Kept(self.units.take(pa.array(places)), self.ids_at(places), sizes)

    def ids_at(self, places: np.ndarray) -> np.ndarray:
        return self.ids[_runs(_begins(self.sizes)[places], self.sizes[places])]

    def plus(self, *others: "_Kept") -> "_Kept":
        parts = [self, *others]
        return _Kept(
            pa.concat_arrays([k.units for k in parts]), np.concatenate([k.ids for k in parts]),
            np.concatenate([k.sizes for k in parts]),
        )


class _Encoder:
    """Ids of pieces; a unit not met during a whole generation is forgotten."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # pieces hold none of their strings
        added = [t["content"] for t in json.loads(self.library.to_str()).get("added_tokens") or []]
        self.special = re.compile("|".join(map(re.escape, added))).search if added else None
        self.whole = None
        normal = json.loads(self.library.to_str()).get("normalizer") or {}
        steps = normal.get("normalizers", [normal])
        #: Words in capitals, or after a line feed, have the ids of the plain word.
        self.folds = any(s.get("type") == "Lowercase" for s in steps) and any(
            s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps
        )
        self.young, self.old = _Kept(), _Kept()
        # A word of letters is one unit to the tokenizer: its model alone, without the
        # steps before it, gives the same ids several times faster.
        self.model = self.library.model
        self.before = "" if self.folds else _SIGN_OF_BYTE[32]
        self.direct = all(
            self._of_model(p) == self.library.encode(" " + p, add_special_tokens=False).ids
            for p in _PROBES
        )

    def _of_model(self, word: str) -> list[int]:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_SIGN_OF_BYTE)
        return [token.id for token in self.model.tokenize(self.before + word)]

    def encode_whole(self, text: str) -> bytes:
        """Ids of a text with the string of a special token, by the library alone."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def ids_of(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different units, one after the other, and the number of each."""
        if len(self.young) > KEPT_PIECES:
            self.old, self.young = self.young, _Kept()
        young = self.young
        places = young.find(units)
        open_ = np.flatnonzero(places < 0)
        if len(open_):
            missing = units.take(pa.array(open_))
            before = self.old.find(missing)
            known, new = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
            places[open_[np.concatenate([known, new])]] = len(young) + np.arange(len(open_))
            young = young.plus(self.old.take(before[known]), self.learnt(missing.take(pa.array(new))))
            self.young = young
            long = pc.greater(pc.utf8_length(missing), LONGEST_KEPT)
            if pc.any(long).as_py():
                kept = pc.less_equal(pc.utf8_length(young.units), LONGEST_KEPT)
                self.young = young.take(np.flatnonzero(kept.to_numpy(zero_copy_only=False)))
        return young.ids_at(places), young.sizes[places]

    def learnt(self, units: pa.Array) -> _Kept:
        """Units met for the first time, with their ids."""
        texts = units.to_pylist()
        ids: list[list[int] | None] = [
            self._of_model(t) if self.direct and _LETTERS_ALONE.fullmatch(t) else None for t in texts
        ]
        others = [k for k, found in enumerate(ids) if found is None]
        made = self.library.encode_batch_fast(
            [_spelled(texts[k]) for k in others], add_special_tokens=False
        )
        for k, encoding in zip(others, made, strict=True):
            ids[k] = encoding.ids
        return _Kept(
            units, np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int32)
        )


@lru_cache(maxsize=4)
def encoder(path: str) -> _Encoder:
    return _Encoder(path)


def encode_bytes(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    collecting = gc.isenabled()
    gc.disable()  # long lists of pieces hold no cycles, and searching them costs much
    try:
        return _encode(encoder(path), texts)
    finally:
        if collecting:
            gc.enable()


def _is_plain(text: str) -> bool:
    """Whether single blanks and line feeds are all the white space there is."""
    return not ("  " in text or " \n" in text or "\n\n" in text or _ODD.search(text))


def _distinct_pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different pieces, number of each piece of the texts, pieces of each text)."""
    plain = list(map(_is_plain, texts))
    counts = np.empty(len(texts), np.int64)
    cut = pc.split_pattern(
        pa.array(
            [_AS_IS + t.replace("\n", " \n") for t, p in zip(texts, plain, strict=True) if p],
            pa.large_string(),
        ),
        " ",
    )
    flags = np.array(plain, bool)
    counts[flags] = cut.value_lengths().to_numpy(zero_copy_only=False)
    flat = cut.flatten()
    others = [_pieces(t) for t, p in zip(texts, plain, strict=True) if not p]
    if others:
        counts[~flags] = list(map(len, others))
        flat = pa.concat_arrays([flat, pa.array([p for o in others for p in o], pa.large_string())])
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy()
    if others:  # they stand behind the plain ones; put every text in its place
        order = np.concatenate([np.flatnonzero(flags), np.flatnonzero(~flags)])
        begins = np.empty(len(texts), np.int64)
        begins[order] = _begins(counts[order])
        codes = codes[_runs(begins, counts)]
    return coded.dictionary, codes, counts


def _units(pieces: pa.Array, folds: bool) -> tuple[pa.Array, np.ndarray]:
    """(different units, the two units of each piece): a word and the signs behind it.

    Where nothing is cut off, the second unit is the empty text.
    """
    none, mark = (pa.scalar(c, pa.large_string()) for c in ("", _AS_IS))
    # Long pieces are rare and left whole.
    short = pc.if_else(pc.less_equal(pc.binary_length(pieces), 4 * LONGEST_KEPT), pieces, none)
    cut = pc.extract_regex(short, _SIGNED)
    signed = cut.is_valid()
    stems = pc.if_else(signed, pc.struct_field(cut, "stem"), pieces)
    signs = pc.binary_join_element_wise(mark, pc.struct_field(cut, "sign"), none)
    signs = pc.if_else(signed, signs, mark)
    if folds:
        plain = pc.match_substring_regex(pc.if_else(signed, stems, short), _ONLY_LETTERS)
        lowered = pc.utf8_lower(pc.utf8_ltrim(pc.if_else(plain, stems, none), characters="\n"))
        stems = pc.if_else(plain, lowered, stems)
    coded = pa.concat_arrays([stems, signs]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().reshape(2, -1).T


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes, dtype=np.int64) - sizes


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one run after the other."""
    shift = begins - _begins(sizes)
    return np.repeat(shift, sizes) + np.arange(int(sizes.sum()))


def _encode(known: _Encoder, texts: list[str]) -> list[bytes]:
    special = known.special
    if special is not None and any(map(special, texts)):
        marked = list(map(special, texts))
        rest = iter(_encode_cut(known, [t for t, m in zip(texts, marked, strict=True) if not m]))
        return [
            known.encode_whole(t) if m else next(rest) for t, m in zip(texts, marked, strict=True)
        ]
    return _encode_cut(known, texts)


def _encode_cut(known: _Encoder, texts: list[str]) -> list[bytes]:
    """Ids of texts without special tokens: each different unit is looked up once."""
    if not texts:
        return []
    pieces, codes, counts = _distinct_pieces(texts)
    units, pairs = _units(pieces, known.folds)
    pool, sizes = known.ids_of(units)
    pairs = pairs.ravel()
    pool = pool[_runs(_begins(sizes)[pairs], sizes[pairs])]  # of each different piece
    sizes = sizes[pairs].reshape(-1, 2).sum(axis=1)
    lengths = sizes[codes]
    ids = pool[_runs(_begins(sizes)[codes], lengths)].tobytes()
    ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))] * 4
    bounds = ends.tolist()
    return [ids[i:j] for i, j in zip(bounds, bounds[1:])]


def text_slices(
    texts: list[str | None], most: int = SLICE_CHARS
) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) with NULL as empty, about ``most`` characters at a time."""
    first, kept, size = 0, [], 0
    for i, text in enumerate(texts):
        kept.append(text or "")
        size += len(kept[-1])
        if size >= most:
            yield first, kept
            first, kept, size = i + 1, [], 0
    if kept:
        yield first, kept
