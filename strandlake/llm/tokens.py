"""Token ids of whole texts, by the ``tokenizers`` library with a word cache.

A text is cut at blanks and line feeds, which these tokenizers never join to a
neighbour. Cutting, finding the distinct pieces of a batch and laying ids end to
end are done on whole columns; the library encodes each distinct piece that the
bounded cache does not hold.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandlake.llm.common import held

END_ID = 1
#: Bytes of text encoded at a time: its pieces, their places and ids take many times as much.
SLICE = 2 << 20
#: Keys of a generation of the cache, and words encoded in one call.
GENERATION = 200_000
JOINED = 2000

#: Fixed value: the word rule under which letters and marks are parted.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters without combining forms, of one lower-case letter each; and ASCII punctuation.
LETTERS = r"A-Za-zÀ-ÖØ-öø-įı-ɏ"
LETTERS_THEN_MARKS = "^(?P<letters>[" + LETTERS + r"]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
ALL_LETTERS = re.compile("[" + LETTERS + "]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of ``values`` end to end, and where each ends."""
    own = sizes[at]
    ends = np.cumsum(own)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - ends + own, own)], ends


class Cache:
    """Ids by key, laid end to end, in two generations: a full one takes the older
    one's place, so that keys in use stay and about twice ``GENERATION`` are held."""

    def __init__(self):
        self.slots: list[dict[str, int]] = [{}, {}]
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def look_up(self, keys: list[str], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, and each key's start and size in them; ``encode`` gives ids and sizes of new keys."""
        absent = repeat(-1)
        at = np.fromiter(map(self.slots[0].get, keys, absent), np.int64, len(keys))
        out = np.flatnonzero(at < 0)
        older = np.fromiter(map(self.slots[1].get, map(keys.__getitem__, out.tolist()), absent), np.int64, len(out))
        again, new = out[older >= 0], out[older < 0]
        if len(again):
            values, starts, sizes = self._laid(1)
            self._add([keys[k] for k in again.tolist()], gather(values, starts, sizes, older[older >= 0])[0], sizes[older[older >= 0]])
        if len(new):
            names = [keys[k] for k in new.tolist()]
            self._add(names, *encode(names))
        if len(out):
            at[out] = np.fromiter(map(self.slots[0].__getitem__, map(keys.__getitem__, out.tolist())), np.int64, len(out))
        values, starts, sizes = self._laid(0)
        if len(self.slots[0]) > GENERATION:
            self.slots, self.parts = [{}, self.slots[0]], [[], self.parts[0]]
        return values, starts[at], sizes[at]

    def _add(self, keys: list[str], values: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.slots[0])
        self.slots[0].update(zip(keys, range(n, n + len(keys)), strict=True))
        self.parts[0].append((values, sizes))

    def _laid(self, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = self.parts[which]
        if len(parts) > 1:
            parts[:] = [tuple(map(np.concatenate, zip(*parts, strict=True)))]
        values, sizes = parts[0] if parts else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        return values, np.cumsum(sizes) - sizes, sizes


class Encoder:
    """Ids of texts, by distinct pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.splits = splits_at_blanks(self.tokenizer)
        self.bare = bare_words(path)
        self.cache = Cache()

    def encode(self, texts: list[str | None], end_id: int | None = END_ID) -> list[np.ndarray]:
        """One uint32 array per text (null: as empty), ``end_id`` appended."""
        ids, ends = self.encode_array(pa.array(texts, pa.string()), end_id)
        return np.split(ids, ends[:-1]) if len(ends) else []

    def encode_array(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end (uint32), and where each text's end."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "")
        if not self.splits:
            end = [] if end_id is None else [end_id]
            each = [[*self.tokenizer.encode(t, add_special_tokens=False).ids, *end] for t in texts.to_pylist()]
            return np.array([i for ids in each for i in ids], "<u4"), np.cumsum([len(ids) for ids in each])
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        last = lists.offsets.to_numpy().astype(np.int64)
        last = last[1:] - last[0]
        pieces = pc.dictionary_encode(lists.flatten())
        values, ends = self._distinct(pieces.dictionary)
        starts = np.concatenate([[0], ends])
        end = np.zeros(0, "<u4") if end_id is None else np.array([end_id], "<u4")
        values, sizes = np.concatenate([values, end]), np.append(ends - starts[:-1], len(end))
        at = np.insert(pieces.indices.to_numpy(), last, len(ends))  # the end after each text's last piece
        ids, ends = gather(values, starts, sizes, at)
        return ids, ends[last + np.arange(len(last))]

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces without blanks, end to end, and where each piece's end.

        A piece of Latin letters, and ASCII punctuation after them, is made of its
        lower-case letters and its punctuation, which the tokenizer parts; so its
        spellings share a cache entry."""
        if self.bare is not None:
            parted = pc.extract_regex(pieces, LETTERS_THEN_MARKS)
            letters = pc.if_else(pc.is_valid(parted), pc.utf8_lower(pc.struct_field(parted, "letters")), pieces)
            marks = pc.if_else(pc.is_valid(parted), pc.struct_field(parted, "marks"), "")
            keys = pc.dictionary_encode(pa.concat_arrays([letters, marks]))
            at = keys.indices.to_numpy().reshape(2, -1).T.reshape(-1)
            step, keys = 2, keys.dictionary.to_numpy(zero_copy_only=False).tolist()
        else:
            step, at, keys = 1, np.arange(len(pieces)), pieces.to_pylist()
        values, ends = gather(*self.cache.look_up(keys, self._new), at)
        return values, ends[step - 1 :: step]

    def _new(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of keys end to end, and each one's number of ids."""
        if self.bare is None:
            return self._joined(keys)
        is_word = np.fromiter(map(bool, map(ALL_LETTERS.fullmatch, keys)), bool, len(keys))
        order = np.concatenate([np.flatnonzero(is_word), np.flatnonzero(~is_word)])
        words = np.count_nonzero(is_word)
        (a, a_sizes), (b, b_sizes) = self._letters([keys[k] for k in order[:words].tolist()]), self._joined([keys[k] for k in order[words:].tolist()])
        values, sizes = np.concatenate([a, b]), np.concatenate([a_sizes, b_sizes])
        back = np.empty(len(keys), np.int64)
        back[order] = np.arange(len(keys))
        return gather(values, np.cumsum(sizes) - sizes, sizes, back)[0], sizes[back]

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By the library's model alone; a word ends with an id of ``bare.ends``."""
        out = [(np.zeros(0, "<u4"), np.zeros(0, np.int64))]
        for k in range(0, len(words), JOINED):
            part = words[k : k + JOINED]
            ids = np.array(self.bare.tokenizer.encode_batch_fast([_shown(" ".join(part), self.bare.shown)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.bare.ends[ids]) + 1
            out.append((ids, np.diff(cuts, prepend=0)) if len(cuts) == len(part) else self._joined(part))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = [(np.zeros(0, "<u4"), np.zeros(0, np.int64))]
        for k in range(0, len(pieces), JOINED):
            part = pieces[k : k + JOINED]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.cumsum([len(p) + 1 for p in part])
            at = np.fromiter((s for s, _ in found.offsets), np.int64, len(ids))
            out.append((ids, np.diff(np.searchsorted(at, ends), prepend=0)))
        return tuple(map(np.concatenate, zip(*out, strict=True)))


def _shown(text: str, shown: np.ndarray) -> str:
    """Letters and blanks as a byte-level vocabulary shows their UTF-8 bytes."""
    if text.isascii():
        return text
    out = shown[np.frombuffer(text.encode(), np.uint8)].reshape(-1)
    return out[out != 0].tobytes().decode()


@dataclass(frozen=True)
class Bare:
    """A tokenizer's model without normalizer and word rule."""

    tokenizer: object
    shown: np.ndarray  # byte to the UTF-8 of the character that stands for it, and zeros
    ends: np.ndarray  # of ids: whether a word ends there


def bare_words(path: str) -> Bare | None:
    """None unless the file lower-cases, parts letters from marks and marks word ends."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    words = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    suffix = spec["model"].get("end_of_word_suffix")
    if normal != ["NFC", "Replace", "Lowercase"] or [w["type"] for w in words] != ["Split", "ByteLevel"] or words[0]["pattern"] != {"Regex": WORD_RULE} or not suffix:
        return None
    spec |= {"normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}, "added_tokens": []}
    ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
    ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
    # Byte-level vocabularies show printable bytes as themselves, the others from U+0100 on.
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    names = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)} | {32: " "}
    shown = np.frombuffer(b"".join(names[b].encode().ljust(2, b"\0") for b in range(256)), np.uint8).reshape(256, 2)
    return Bare(Tokenizer.from_str(json.dumps(spec)), shown, ends)


def splits_at_blanks(tokenizer) -> bool:
    """Whether pieces between blanks may be encoded apart: tried on a probe."""
    probe = ["ab", "Cd,", "(e)", "f1", "é", "x's"]
    enc = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    return enc(" ".join(probe)) == [i for p in probe for i in enc(p)] == enc("\n".join(probe))


def encoder(path: str) -> Encoder:
    """One per Python worker, so that its cache lasts over tasks; ``lean`` stages that encode nothing drop it."""
    return held(path, lambda: Encoder(path))


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice's ``column`` holds about ``most_bytes``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most_bytes
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
