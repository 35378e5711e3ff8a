"""Token ids of whole texts, by the tokenizers library, with the ids of frequent stretches kept.

A byte-level BPE with the usual pre-tokenisation never joins characters over a single space or line break that
stands between two visible characters. Texts are cut there, the different stretches of many texts are looked up once,
and only those not seen before are encoded: words of Latin letters by the model itself, others many in one call. The ids
equal those of encoding each text as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from struct import Struct, pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEEP = 1_000_000
# Stretches that are put together at a time.
_AT_ONCE = 1 << 17
# Where a text with uneven white space may be cut. U+180E counts as white space in some Unicode versions only.
_CUT = re.compile("(?<=[^\\s\u180e])(?=[ \\n][^\\s\u180e])")
# White space but single spaces and line breaks between words.
_UNEVEN = (
    "[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    "|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z"
)
# Marks that end a word and are encoded apart from it; none of them starts a contraction.
_MARKS = ".,;:!?|#$%&*()"
# Stands alone between stretches that are encoded in one call.
_BETWEEN = "\x0b"
# Letters before this one have been letters in all versions of Unicode that are in use.
_LATIN = "\u0250"
# White space, then anything without the sign between stretches, visible at both ends.
_APART = re.compile("[ \\n][^\\s\x0b]([^\x0b]*[^\\s\x0b])?")
# The sign that stands for each byte in a byte-level vocabulary.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}
_PACKS = [Struct(f"<{n}I").pack for n in range(32)]


def _even(texts: Sequence[str]) -> list[bool]:
    """Whether single spaces and line breaks part the words of each text, and nothing else."""
    return pc.invert(pc.match_substring_regex(pa.array(texts, pa.large_string()), _UNEVEN)).to_pylist()


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that begin at ``starts`` and hold ``counts`` numbers, one range after the other."""
    ends = counts.cumsum()
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids as little-endian unsigned 32-bit integers. About ``keep`` stretches are remembered.

    ``_older`` holds what was known before; what is used again moves over, the rest goes with it.
    """

    def __init__(self, path: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        between = self._tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self._between = between[0] if len(between) == 1 else None
        self._model = self._tokenizer.model if self._keeps_words() else None

    def _keeps_words(self) -> bool:
        """Whether a space and letters always reach the model together, byte by byte in the usual signs."""
        from tokenizers import models, pre_tokenizers

        tokenizer, parts = self._tokenizer, self._tokenizer.pre_tokenizer
        usual = isinstance(parts, pre_tokenizers.ByteLevel) and parts.use_regex and not parts.add_prefix_space
        added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        return (
            usual
            and isinstance(tokenizer.model, models.BPE)
            and tokenizer.normalizer is None
            and not any(content.strip().isalpha() or not content.strip() for content in added)
        )

    def _direct(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        (encoding,) = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(encoding.ids, dtype="<u4")

    def encode(self, texts: Sequence[str], end: bytes = b"") -> list[bytes]:
        """The ids of each text, and ``end`` after them."""
        ids, counts = self.encode_flat(texts, end)
        raw, ends = ids.tobytes(), (4 * counts.cumsum()).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_flat(self, texts: Sequence[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, ``end`` after each text, and how many each has.

        Each different stretch is looked up once; what the texts are made of is then put together by index.
        """
        firsts, rests, uneven, counts = [], [], [], np.zeros(len(texts), dtype=np.int64)
        for i, (text, is_even) in enumerate(zip(texts, _even(texts), strict=True)):
            if is_even:
                # ``word`` stands for a space and the word.
                first, _, rest = text.replace("\n", " \n").partition(" ")
                rests.append(rest or None)
            else:
                first, *more = _CUT.split(text)
                uneven += [s[1:] if s[0] == " " else s for s in more]
                counts[i] = len(more)
                rests.append(None)
            firsts.append(first)
        lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        even = lists.is_valid().to_numpy(zero_copy_only=False)
        words = lists.flatten()
        at = np.where(even, 0, len(words))
        counts[even] = np.asarray(lists.value_lengths().drop_null(), dtype=np.int64)
        for own in (even, ~even):
            at[own] += counts[own].cumsum() - counts[own]
        coded = pa.concat_arrays([words, pa.array(uneven, pa.large_string())]).dictionary_encode()
        parts = [*self._known_ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), *map(self._direct, firsts), end]
        # Of each text its first stretch, the others and the end.
        own_first = len(coded.dictionary) + np.arange(len(texts))
        places = np.full(counts.sum() + 2 * len(texts), len(parts) - 1)
        begins = (counts + 2).cumsum() - counts - 2
        places[begins] = own_first
        inner = _ranges(begins + 1, counts)
        places[inner] = coded.indices.to_numpy()[_ranges(at, counts)]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        starts, held = sizes.cumsum() - sizes, np.frombuffer(b"".join(parts), dtype="<u4")
        some = np.array_split(places, 1 + len(places) // _AT_ONCE)
        ids = np.concatenate([held[_ranges(starts[own], sizes[own])] for own in some])
        return ids, np.add.reduceat(sizes[places], begins) if len(texts) else counts

    def _known_ids(self, stretches: list[str]) -> list[bytes]:
        """Ids of different stretches, which are learnt if need be."""
        if len(self._known) > self.keep // 2:
            self._known, self._older = {}, self._known
        found = list(map(self._known.get, stretches))
        missed = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missed:
            ids = self._older.get(stretches[i])
            if ids is None:
                new.append(stretches[i])
            else:
                self._known[stretches[i]] = ids
        self._learn(new)
        for i in missed:
            found[i] = self._known[stretches[i]]
        return found

    def _learn(self, new: list[str]) -> None:
        parted = {}
        for s in new:
            word = s.rstrip(_MARKS)
            if len(word) < len(s) and (word[1:] if word[:1] == "\n" else word).isalpha():
                parted[s] = word
        words = {s for s in new if s not in parted}
        words.update(w for w in parted.values() if w not in self._known)
        mixed = []
        for w in words:
            if self._model is not None and w.isalpha() and (w.isascii() or max(w) < _LATIN):
                self._known[w] = self._of_word(w)
            else:
                mixed.append(w)
        self._known.update(zip(mixed, self._together([w if w[0] == "\n" else " " + w for w in mixed]), strict=True))
        tails = {end: self._direct(end) for end in {s[len(w) :] for s, w in parted.items()}}
        for s, word in parted.items():
            self._known[s] = self._known[word] + tails[s[len(word) :]]

    def _of_word(self, word: str) -> bytes:
        """Ids of a space and Latin letters, which the pre-tokenisation keeps together, so that the model takes them at once."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        ids = [token.id for token in self._model.tokenize(_BYTES[32] + word)]
        return _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else pack(f"<{len(ids)}I", *ids)

    def _together(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches that begin with white space and end visibly."""
        out: list[bytes] = []
        for at in range(0, len(stretches), 2000):
            some = stretches[at : at + 2000]
            if self._between is None or not all(map(_APART.fullmatch, some)):
                out += map(self._direct, some)
                continue
            ids = self._ids(_BETWEEN.join(some))
            ends = np.append(np.flatnonzero(ids == self._between), len(ids)) * 4
            raw, begin = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[begin:end])
                begin = end + 4
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str, keep: int = KEEP) -> Encoder:
    """The encoder of this worker process, which from now on remembers about ``keep`` stretches."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].keep = keep
    return _encoders[path]
