"""Token ids of whole texts by words: a column of texts is split and counted by Arrow, and only words that a worker has
not seen before reach the tokenizer.

The pre-tokenizers of the files used here never join characters across the beginning of white space, so a text is the
sequence of its words, each with the white space before it, and equal words have equal ids anywhere. Words are cut at
blanks and line ends. A text with other or repeated white space between its words is cut by a pattern, and one with
white space beyond blank, tab and line ends, on which libraries differ, is given to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Word encodings that one Python worker keeps, and their ids in all; when full only words met in several slices stay.
CACHE_WORDS, CACHE_IDS = 300_000, 4_000_000
#: Characters of texts that are taken through Arrow at once, unless one text has more.
SLICE_CHARS = 4 << 20
#: Rows of the Arrow batches in which texts reach a tokenizer's worker.
BATCH_ROWS = 2048
#: Runs of marks after words that are kept.
MARKS = 4096
#: Spellings without marks, letter case and white space that are kept beside the words.
CORES = 200_000
#: Words that reach a tokenizer as one text.
JOINED = 512

_OTHER_WHITE = re.compile(r"[^\S \t\n\r]|\x85")
_CHUNKS = re.compile(r"[ \t\n\r]+[^ \t\n\r]*|[^ \t\n\r]+")
_WHITE = re.compile(r"[\s\x85]")
_ODD_WORD = r"(?s)^\n?$|^[\t\x0b\x0c\r\x1c-\x1f \x{85}\p{Z}]|.[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\p{Z}]"
_PLAIN_MARKS = ".,;:!?"
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Letters of Latin-1, which have no other form under NFC and one character in either case.
_LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_LATIN_LETTERS = re.compile(rf"[A-Za-z{_LATIN}]+").fullmatch
_LETTERS_MARKS = re.compile(rf"[A-Za-z{_LATIN}]*[{re.escape(_MARKS)}]*").fullmatch
#: The same with at least one of each, after the white space before a word, as Arrow's patterns write it.
_MARKED_WORD = rf"^[ \n]?[A-Za-z{_LATIN}]+[!-/:-@\[-`{{-~]+$"
#: The characters by which byte-level vocabularies write these letters.
_BYTE_CHARS = {ord(c): "".join(chr(b) if b > 173 or 160 < b < 173 else chr(323 if b == 173 else b + 162) for b in c.encode()) for c in _LATIN}
_BYTE_BLANK = chr(288)
_loaded: dict[str, "WordIds"] = {}

#: Ids of strings, one array each, or the bytes of one each.
Raw = Callable[[Sequence[str]], list[np.ndarray] | list[bytes]]


def tokenizer_path(name: str) -> str:
    """Path of a tokenizer file of this machine's ``public_tokenizers`` package, or the path itself."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _latin_only(texts: pa.StringArray) -> pa.BooleanArray:
    """Which texts have no character beyond Latin-1: none of their bytes begins one."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return pa.array(np.ones(len(texts), bool))
    others = np.flatnonzero(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] >= 0xC4) + offsets[0]
    at = np.searchsorted(others, offsets)
    return pa.array(at[1:] == at[:-1])


def _strings(texts: pa.StringArray) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """Ids of texts through a table of words: ``raw`` encodes strings that are not in it yet.

    ``marks``: the marks after a word of letters have ids of their own, so the table holds both apart.
    """

    def __init__(self, raw: Raw, lower: bool = False, words: int = CACHE_WORDS, chars: int = SLICE_CHARS, latin: bool = False, special: Sequence[str] = (), marks: bool = False):
        self.raw, self.lower, self.words, self.chars, self.latin, self.special, self.marks = raw, lower, words, chars, latin, special, marks
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(4096, np.int32), 0
        self.again = np.zeros(1024, bool)

    def _trim(self) -> None:
        """Forget the words of one slice only; of texts that invent words without end these are nearly all."""
        n = len(self.places)
        kept = np.flatnonzero(self.again[:n])
        ids = self._gather(kept)
        if 2 * len(kept) > self.words or 2 * len(ids) > CACHE_IDS:
            return self._clear()
        again = self.again
        self.places = {w: i for i, w in enumerate(w for w, at in self.places.items() if again[at])}
        room = max(1024, len(kept))
        lengths, starts = np.zeros(room, np.int32), np.zeros(room, np.int32)
        lengths[: len(kept)] = self.lengths[kept]
        starts[: len(kept)] = np.cumsum(lengths[: len(kept)]) - lengths[: len(kept)]
        self.lengths, self.starts, self.again = lengths, starts, np.zeros(room, bool)
        self.flat, self.used = np.concatenate([ids, np.zeros(4096, np.int32)]), len(ids)

    def _lookup(self, words: Sequence[str]) -> np.ndarray:
        """Places of words in the table; new ones are encoded and added."""
        places = self.places
        known = len(places)
        at_words = np.fromiter(map(places.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at_words < 0)
        if len(missing):
            asked = [words[i] for i in missing.tolist()]
            # the words are distinct but for the first words of texts
            new = list(dict.fromkeys(asked))
            found = self.raw(new)
            sizes = np.fromiter(map(len, found), np.int32, len(new))
            if isinstance(found[0], bytes):
                sizes //= 4
                found = [np.frombuffer(b"".join(found), np.int32)]
            at, stop = len(places), len(places) + len(new)
            while stop > len(self.starts):
                self.starts, self.lengths, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.again))
            total = int(sizes.sum(dtype=np.int64))
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, self.used), np.int32)])
            self.lengths[at:stop] = sizes
            self.starts[at:stop] = self.used + np.cumsum(sizes) - sizes
            self.flat[self.used : self.used + total] = np.concatenate(found)
            self.used += total
            places.update(zip(new, range(at, stop)))
            at_words[missing] = range(at, stop) if len(new) == len(asked) else [places[w] for w in asked]
        self.again[at_words[at_words < known]] = True
        return at_words

    def _gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of a sequence of words."""
        sizes = self.lengths[places]
        ends = np.cumsum(sizes, dtype=np.int64)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.int32)
        shift = (self.starts[places] - (ends - sizes)).astype(np.int32)
        return self.flat[np.repeat(shift, sizes) + np.arange(ends[-1], dtype=np.int32)]

    def _lookup_marked(self, words: pa.StringArray) -> np.ndarray:
        """Two places for each word, of its letters and of the marks after them; a word of another form has no marks."""
        marked = pc.match_substring_regex(words, _MARKED_WORD)
        cores = pc.if_else(marked, pc.ascii_rtrim(words, characters=_MARKS), words)
        ends = [w[len(c) :] for w, c in zip(_strings(words.filter(marked)), _strings(cores.filter(marked)))]
        coded = cores.dictionary_encode()
        found = np.empty((len(words), 2), np.int64)
        found[:, 0] = self._lookup(_strings(coded.dictionary))[coded.indices.to_numpy()]
        found[:, 1] = self._lookup([""])
        found[marked.to_numpy(zero_copy_only=False), 1] = self._lookup(ends)
        return found

    def _odd(self, text: str) -> np.ndarray:
        if _OTHER_WHITE.search(text):
            ids = self.raw([text])[0]
            return np.frombuffer(ids, np.int32) if isinstance(ids, bytes) else np.asarray(ids, np.int32)
        return self._gather(self._lookup(_CHUNKS.findall(text)))

    def _slice(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        if self.lower:
            exact, lowered = (_latin_only(texts), pc.utf8_lower(texts)) if self.latin else (pc.string_is_ascii(texts), pc.ascii_lower(texts))
            # a special token counts only as it is written
            for token in self.special:
                exact = pc.and_not(exact, pc.match_substring(lowered, token))
            texts = pc.if_else(exact, lowered, texts)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = pc.dictionary_encode(lists.flatten())
        indices = coded.indices.to_numpy()
        first = offsets[:-1]
        heads = pc.take(coded.dictionary, pa.array(indices[first])).to_pylist()
        # an empty word (a second blank), a lone line end or white space inside a word make a text odd
        odd = pc.match_substring_regex(coded.dictionary, _ODD_WORD)
        led = pc.starts_with(coded.dictionary, "\n")
        words = pc.binary_join_element_wise(pc.if_else(led, "", " "), coded.dictionary, "")
        odd = odd.to_numpy(zero_copy_only=False)
        table = np.zeros((len(odd), 2) if self.marks else len(odd), np.int64)
        plain_words = words.filter(pa.array(~odd))
        table[~odd] = self._lookup_marked(plain_words) if self.marks else self._lookup(_strings(plain_words))
        places, strange = table[indices], odd[indices]
        # the first word of a text has no blank before it
        plain = ["" if _WHITE.search(w) else w for w in heads]
        places[first] = self._lookup_marked(pa.array(plain, pa.string())) if self.marks else self._lookup(plain)
        strange[first] = [w != p for w, p in zip(heads, plain)]
        whole = self._gather(places.ravel())
        sizes = self.lengths[places]
        counts = np.add.reduceat(sizes.sum(axis=1, dtype=sizes.dtype) if self.marks else sizes, first)
        bad = np.flatnonzero(np.logical_or.reduceat(strange, first))
        if not len(bad):
            return whole, counts
        ends = np.cumsum(counts, dtype=np.int64)
        parts, at = [], 0
        for i in bad.tolist():
            own = self._odd(texts[i].as_py())
            parts += [whole[at : ends[i] - counts[i]], own]
            at, counts[i] = ends[i], len(own)
        return np.concatenate([*parts, whole[at:]]), counts

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of one text."""
        return self.encode_column(pa.array([text], pa.string()))[0].tobytes()

    def encode_column(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)``: the ids of all texts one after the other, and how many each has. Null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        found, at = [], 0
        while at < len(texts):
            limit = (ends[at - 1] if at else 0) + self.chars
            stop = max(at + 1, int(np.searchsorted(ends, limit, "right")))
            if len(self.places) > self.words or self.used > CACHE_IDS:
                self._trim()
            found.append(self._slice(texts.slice(at, stop - at)))
            at = stop
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)


def _library(name: str) -> "WordIds":
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))

    def single(texts: Sequence[str]) -> list[np.ndarray]:
        found = [x.ids for x in tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(found), np.int32)
        return np.split(flat, np.cumsum([len(x) for x in found])[:-1]) if found else []

    # a vocabulary with a mark for the tab takes many words at once: no word has a tab, so the mark stands between words
    tab = single(["\t"])[0]
    if len(tab) != 1 or single(["a\t b\t\nc\t"])[0].tolist() != np.concatenate(single(["a", "\t", " b", "\t", "\nc", "\t"])).tolist():
        # neither letter case nor white space counts on ASCII; elsewhere both are left to the tokenizer
        blind = single(["\nThe end"])[0].tolist() == single(["the END"])[0].tolist()
        if not blind:
            return WordIds(single)
        latin = _knows_latin(tokenizer, single)
        special = [x.content.lower() for x in tokenizer.get_added_tokens_decoder().values()]
        return WordIds(_by_parts(tokenizer, single, latin), lower=True, latin=latin, special=special)

    def together(texts: Sequence[str]) -> list[np.ndarray]:
        if any("\t" in t for t in texts):
            return single(texts)
        found = []
        for i in range(0, len(texts), JOINED):
            joined = tokenizer.encode_batch_fast(["\t".join(texts[i : i + JOINED]) + "\t"], add_special_tokens=False)[0]
            ids = np.array(joined.ids, np.int32)
            ends = np.flatnonzero(ids == tab[0])
            if len(ends) != len(texts[i : i + JOINED]):
                return single(texts)
            found += [ids[a:z] for a, z in zip(np.append(0, ends[:-1] + 1), ends)]
        return found

    # an added token of letters with marks after them could lie across both parts of a word
    if any(_LETTERS_MARKS(x.content) for x in tokenizer.get_added_tokens_decoder().values()) or not _knows_pieces(tokenizer, single, together):
        return WordIds(together)
    return WordIds(_by_pieces(tokenizer, together), marks=True)


def _knows_pieces(tokenizer, single: Raw, together: Raw) -> bool:
    """Whether letters with the blank before them are a piece of their own to the model, and so are the marks of ASCII after them."""
    cores = [f"{x}{c}{c}n" for c in ["a", *_LATIN] for x in ("", " ", " e", "N", "\n")]
    run, first = _by_pieces(tokenizer, together), cores[1]
    if [x.tobytes() for x in single(cores)] != run(cores):
        return False
    marks = [f"{c}{d}" for c in _MARKS for d in ("", ".", c)]
    return [x.tobytes() for x in single([first + m for m in marks])] == [run([first])[0] + x for x in run(marks)]


def _by_pieces(tokenizer, together: Raw) -> Callable[[Sequence[str]], list[bytes]]:
    """For a byte-level vocabulary: letters, with the blank before them, go to its model one by one, all else to ``together``."""
    merges = tokenizer.model.tokenize

    def run(texts: Sequence[str]) -> list[bytes]:
        found, rest = [None] * len(texts), []
        for n, text in enumerate(texts):
            letters = text.removeprefix(" ")
            if letters.isascii() and letters.isalpha():
                written = letters
            elif _LATIN_LETTERS(letters):
                written = letters.translate(_BYTE_CHARS)
            else:
                rest.append(n)
                continue
            found[n] = array("i", [t.id for t in merges(written if letters is text else _BYTE_BLANK + written)]).tobytes()
        if rest:
            for n, ids in zip(rest, together([texts[n] for n in rest])):
                found[n] = ids.tobytes()
        return found

    return run


def _knows_latin(tokenizer, single: Raw) -> bool:
    """Whether letters of Latin-1 reach the model as bytes in lower case, and marks of ASCII after letters as a piece of their own."""
    words = [f"{x}{c}{c}n" for c in _LATIN for x in ("", "e", "N")] + [f"ab{c}{d}" for c in _MARKS for d in ("", ".", c)]
    return [x.tobytes() for x in single(words)] == _by_parts(tokenizer, single, True)(words)


def _by_parts(tokenizer, single: Raw, latin: bool) -> Callable[[Sequence[str]], list[bytes]]:
    """For a vocabulary without case and white space: letters and the marks after them go to its model one by one.

    Both are whole pieces to the pre-tokenizer, so the model's merges give what the tokenizer gives.
    """
    merges, known_marks = tokenizer.model.tokenize, _MARKS if latin else _PLAIN_MARKS
    marks, cores = {}, {}

    def run(texts: Sequence[str]) -> list[bytes]:
        found, rest = [None] * len(texts), []
        for n, text in enumerate(texts):
            word = text.lstrip(" \n")
            core = word.rstrip(known_marks)
            ids = cores.get(core)
            if ids is None:
                if not (core.isalpha() and (core.isascii() or latin and _LATIN_LETTERS(core))):
                    rest.append(n)
                    continue
                if len(cores) >= CORES:
                    cores.clear()
                letters = core.lower()
                ids = cores[core] = array("i", [t.id for t in merges(letters if letters.isascii() else letters.translate(_BYTE_CHARS))]).tobytes()
            if len(core) < len(word):
                mark = word[len(core) :]
                if mark not in marks:
                    if len(marks) > MARKS:
                        marks.clear()
                    marks[mark] = single([mark])[0].tobytes()
                ids = ids + marks[mark]
            found[n] = ids
        for n, ids in zip(rest, single([texts[n] for n in rest])):
            found[n] = ids.tobytes()
        return found

    return run


def encoder(name: str) -> WordIds:
    """The worker's table of a tokenizer file; made once per worker."""
    if name not in _loaded:
        _loaded[name] = _library(name)
    return _loaded[name]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts with an id after each, and the offsets of the texts."""
    offsets = np.append(0, np.cumsum(counts + 1))
    out = np.empty(offsets[-1], np.int32)
    own = np.ones(len(out), bool)
    own[offsets[1:] - 1] = False
    out[own] = ids
    out[~own] = end_id
    return out, offsets
