"""Ids of whole texts by the tokenizers library; runs between white space are encoded once and remembered.

Both vocabularies split a text at white space before any merge, so the ids of a text are the ids of its runs
one after the other. Texts where that does not hold (white space the two languages read differently, or the
string of a special token) are encoded whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from querygrade.llm.common import CACHES, ragged

#: Bytes of runs and ids a worker remembers before it forgets the rare ones (a run counts RUN_BYTES besides its letters and ids).
REMEMBERED_BYTES, RUN_BYTES = 72 << 20, 180

_TAIL = ".,;:!?|"
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CONTROL = re.compile("[\x1c-\x1f]")
_RUNS = re.compile(r"[ \n]+(?![^ \n])| ?[^ \n]+|[ \n]")
#: Runs that are encoded as one text, and texts given to the library at once.
_TOGETHER, _AT_ONCE = 500, 32
_RAW = "\r"  # marks a run without the space before it; no remembered run holds it otherwise


def _is_letters(word: str) -> bool:
    """Whether a word is letters only, also in small letters and after its letters are composed, which takes some apart."""
    return word.isalpha() and (word.isascii() or (word.lower().isalpha() and max(word) < "\ufb00" and unicodedata.normalize("NFC", word).isalpha()))


class _Index(dict):
    """Number of each run, given in order of first sight."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class TextEncoder:
    """``spaced``: a space belongs to the word after it (byte-level vocabularies); else white space is dropped.

    ``share``: how many times REMEMBERED_BYTES it may remember.
    """

    spaced, share, suffixed = False, 1, False

    def __init__(self, path: str, spaced: bool, share: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.share = spaced, share
        # Whether the last token of a word can be told by its end, and the tokens that are one.
        suffix = "" if spaced else getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.suffixed = bool(suffix)
        closing = [i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[closing] = True
        # Characters of each token, which are its bytes in a byte-level vocabulary.
        sizes = {i: len(t) for t, i in self.tokenizer.get_vocab().items()} if spaced else {}
        self.token_bytes = np.array([sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.letters = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)

    def _forget_rare(self) -> None:
        """Keeps the runs that were met most often, half of all at most, and of those only what was met again."""
        hits, start, length, flat, keys = self.hits, self.start, self.length, self.flat, list(self.index)
        kept = np.sort(np.argsort(-hits, kind="stable")[: len(hits) // 2])
        kept = kept[hits[kept] > 1]
        self._forget()
        keys = [keys[i] for i in kept.tolist()]
        self.index.update(zip(keys, range(len(keys))))
        self.letters = sum(map(len, keys))
        self._append(flat[ragged(start[kept], length[kept])], length[kept])
        self.hits = hits[kept] // 2

    def _whole(self, texts: list[str]) -> list[list[int]]:
        calls = (texts[a : a + _AT_ONCE] for a in range(0, len(texts), _AT_ONCE))  # what the library returns takes many times the ids
        return [e.ids for own in calls for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]

    def _runs(self, text: str) -> list[str] | None:
        """The runs of a text as keys of the index; None if it has to be encoded whole."""
        if "<|" in text:
            return None
        if not self.spaced:
            if _CONTROL.search(text):
                return None
            return (text.lower() if text.isascii() else text).split()
        if _ODD.search(text):
            return None
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return [r[1:] if r[0] == " " and len(r) > 1 and r[1] not in " \n" else _RAW + r for r in _RUNS.findall(text)]
        runs = text.replace("\n", " \n").split(" ")
        runs[0] = _RAW + runs[0]
        return runs

    def _string(self, key: str) -> str:
        if not self.spaced:
            return key
        return key[1:] if key[0] == _RAW else key if key[0] == "\n" else " " + key

    def _parts(self, key: str) -> tuple[str, str, str]:
        """Head, body and tail that are tokens of their own: a line end, letters, marks at the end. No body: not cut."""
        head = "\n" if self.spaced and key[0] == "\n" and len(key) > 1 else ""
        body = key[len(head) :].rstrip(_TAIL)
        letters = body[1:] if body[:1] == _RAW else body
        if _is_letters(letters) and (head or len(body) < len(key)):
            return head, _RAW + body if head else body, key[len(head) + len(body) :]
        return "", "", ""

    def _joined(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of runs that follow each other, encoded as one text and cut at their bytes, and the number of ids of each.

        No key is marked or begins or ends with white space, but for one line end before it. None if a token lies across two runs.
        """
        text = (" " + " ".join(keys)).replace(" \n", "\n")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum(self.token_bytes[ids])
        column = pa.array(keys, pa.large_string())
        spaced = pc.invert(pc.starts_with(column, "\n")).cast(pa.int64()).to_numpy()
        wanted = np.cumsum(pc.binary_length(column).to_numpy() + spaced)
        at = np.searchsorted(ends, wanted)
        if not len(ids) or at[-1] != len(ids) - 1 or (ends[at] != wanted).any():
            return None
        return ids.astype(np.uint32), np.diff(at, prepend=-1)

    def _keep(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Remembers some ids; where each stretch of them begins."""
        total = len(flat)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.zeros(max(len(self.flat), total), np.uint32)))
        self.flat[self.used : self.used + total] = flat
        self.used += total
        return self.used - total + np.cumsum(lengths) - lengths

    def _append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.start = np.concatenate((self.start, self._keep(flat, lengths)))
        self.length = np.concatenate((self.length, lengths))

    def _learn_spaced(self) -> bool:
        """Learns the fresh runs of a byte-level vocabulary: those that can follow each other as one text."""
        fresh = self.index.fresh
        is_alone = np.array([k[0] in "\r " or k[-1] in " \n" for k in fresh])
        alone, rest = list(compress(fresh, is_alone)), list(compress(fresh, ~is_alone))
        joined = self._joined(rest) if rest else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if joined is None:
            return False
        flat, lengths = joined
        single = self._whole([self._string(k) for k in alone])
        lengths = np.concatenate((lengths, np.fromiter(map(len, single), np.int64, len(single))))
        flat = np.concatenate((flat, np.array([i for ids in single for i in ids], np.uint32)))
        # Back into the order of first sight, which is the runs' numbers.
        place = np.empty(len(fresh), np.int64)
        place[~is_alone], place[is_alone] = np.arange(len(rest)), np.arange(len(rest), len(fresh))
        starts = np.cumsum(lengths) - lengths
        self._append(flat[ragged(starts[place], lengths[place])], lengths[place])
        return True

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of letters only, encoded as texts of many, and the number of ids of each; None if one is more than one word to the library."""
        texts = [" ".join(words[a : a + _TOGETHER]) for a in range(0, len(words), _TOGETHER)]
        ids = np.fromiter(chain.from_iterable(chain.from_iterable(self._whole([t]) for t in texts)), np.uint32)
        ends = np.flatnonzero(self.closes[ids])
        if len(ends) != len(words) or len(ids) != (ends[-1] + 1 if len(ends) else 0):
            return None
        return ids, np.diff(ends, prepend=-1)

    def _learn_suffixed(self) -> bool:
        """Learns the fresh runs of a vocabulary that marks the ends of words: letters as one text, marks at the end once, the rest run by run."""
        index, known = self.index, len(self.start)
        words, others, cut, bodies, tails = [], [], [], [], []
        for n, key in enumerate(index.fresh, known):  # grows with the bodies that are new
            body = key.rstrip(_TAIL)
            if not _is_letters(body):
                others.append(n)
            elif len(body) == len(key):
                words.append(n)
            else:
                cut.append(n)
                bodies.append(index[body])
                tails.append(key[len(body) :])
        fresh = index.fresh
        found = self._words([fresh[n - known] for n in words])
        if found is None:
            return False
        marks = {m: k for k, m in enumerate(dict.fromkeys(tails))}
        single = self._whole([fresh[n - known] for n in others] + list(marks))
        own, sizes = found[1], np.fromiter(map(len, single), np.int64, len(single))
        lengths = np.concatenate((own, sizes))
        starts = self._keep(np.concatenate((found[0], np.fromiter(chain.from_iterable(single), np.uint32))), lengths)
        plain = len(words) + len(others)
        start, length = (np.concatenate((old, np.zeros(len(fresh), np.int64))) for old in (self.start, self.length))
        start[words + others], length[words + others] = starts[:plain], lengths[:plain]
        mark = plain + np.array([marks[t] for t in tails], np.int64)
        # Of each cut run its body, then its marks.
        ids = self.flat[ragged(np.stack((start[bodies], starts[mark]), 1).ravel(), np.stack((length[bodies], lengths[mark]), 1).ravel())]
        length[cut] = length[bodies] + lengths[mark]
        start[cut] = self._keep(ids, length[cut])
        self.start, self.length = start, length
        return True

    def _learn(self) -> None:
        self.letters += sum(map(len, self.index.fresh))
        if (self.spaced and self._learn_spaced()) or (self.suffixed and self._learn_suffixed()):
            self.index.fresh = []
            return
        index = self.index
        known, cut, plain = len(self.start), {}, []
        for key in index.fresh:  # grows with the bodies that are new
            head, body, tail = self._parts(key)
            if body:
                cut[index[key]] = (head, index[body], tail)
            else:
                plain.append(key)
        found = dict(zip((index[k] for k in plain), self._whole([self._string(k) for k in plain])))
        marks = sorted({m for head, _, tail in cut.values() for m in (head, tail)})
        mark_ids = dict(zip(marks, self._whole(marks)))
        for n, (head, body, tail) in cut.items():
            own = found[body] if body >= known else self.flat[self.start[body] : self.start[body] + self.length[body]].tolist()
            found[n] = mark_ids[head] + own + mark_ids[tail]
        ordered = [found[n] for n in range(known, len(index))]
        lengths = np.fromiter(map(len, ordered), np.int64, len(ordered))
        self._append(np.array([i for ids in ordered for i in ids], np.uint32), lengths)
        index.fresh = []

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
        """(numbers of the runs of the regular texts, their count in each, places of the regular texts, of those to be encoded whole)."""
        look_up = self.index.__getitem__
        if self.suffixed:
            is_whole = [bool(text) and ("<|" in text or _CONTROL.search(text) is not None) for text in texts]
            whole, regular = np.flatnonzero(is_whole).tolist(), np.flatnonzero(~np.array(is_whole, bool)).tolist()
            split = pc.utf8_split_whitespace(pa.array([texts[i] or "" for i in regular], pa.large_string()))
            coded = pc.list_flatten(split).dictionary_encode()
            runs = coded.dictionary
            runs = pc.if_else(pc.string_is_ascii(runs), pc.ascii_lower(runs), runs).to_numpy(zero_copy_only=False).tolist()
            own = np.fromiter(map(look_up, runs), np.int64, len(runs))
            return own[coded.indices.to_numpy()], pc.list_value_length(split).to_numpy(), regular, whole
        numbers, counts, regular, whole = [np.zeros(0, np.int64)], [], [], []
        for i, text in enumerate(texts):
            runs = self._runs(text) if text else []
            if runs is None:
                whole.append(i)
                continue
            regular.append(i)
            counts.append(len(runs))
            numbers.append(np.fromiter(map(look_up, runs), np.int64, len(runs)))
        return np.concatenate(numbers), np.array(counts, np.int64), regular, whole

    def encode(self, texts: list[str | None], end_id: int | None = None) -> list[np.ndarray]:
        """Ids of each text (null as empty), each followed by ``end_id`` if there is one."""
        if len(self.index) * RUN_BYTES + self.letters + self.used * 4 > self.share * REMEMBERED_BYTES:
            self._forget_rare()
        out: list[np.ndarray | None] = [None] * len(texts)
        joined, counts, regular, whole = self._numbers(texts)
        if self.index.fresh:
            self._learn()
        end = [] if end_id is None else [end_id]
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = np.array(ids + end, np.uint32)
        if regular:
            met = np.bincount(joined, minlength=len(self.index))
            met[: len(self.hits)] += self.hits
            self.hits = met
            lengths = self.length[joined]
            flat = self.flat[ragged(self.start[joined], lengths)]
            ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(counts)]
            begin = 0
            for i, stop in zip(regular, ends.tolist()):
                ids = flat[begin:stop]
                out[i] = np.append(ids, np.uint32(end_id)) if end else ids
                begin = stop
        return out


#: Kind of work that keeps encoders in a worker, see ``common.frugal``.
ENCODING = "encoding"
_encoders: dict[tuple[str, bool, int], TextEncoder] = {}
CACHES.setdefault(ENCODING, []).append(_encoders)


def encoder(path: str, spaced: bool, share: int = 1) -> TextEncoder:
    """One encoder for each vocabulary and worker."""
    if (path, spaced, share) not in _encoders:
        _encoders[path, spaced, share] = TextEncoder(path, spaced, share)
    return _encoders[path, spaced, share]
