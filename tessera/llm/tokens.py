"""Token ids of whole texts by a tokenizer file: each distinct run without white space is encoded once and remembered."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import regex

#: Texts of these characters are split here; others, and texts with a special token's string, go to the tokenizer whole.
#: In this range lower-casing, normal form C, white space and the letter and number classes agree everywhere.
_PLAIN = re.compile("[^\t-\r -~¡-įı-ſ–—‘’“”…]")
REMEMBERED = 800_000


#: Longer words go to the tokenizer.
LONGEST = 64


class _Merges:
    """Byte-pair merges of many words at once: each step merges every word's leftmost pair of least rank."""

    def __init__(self, spec):
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = self._letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = len(vocab)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.zeros((1 << self.bits) + 64, np.int64)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):  # open addressing
            free = self.keys[slot[left]] == -1
            first = np.unique(slot[left[free]], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]] = keys[put]
            self.values[slot[put]] = (np.int64(1) << 32) * put + np.array([vocab["".join(pairs[k])] for k in put], np.int64)
            left = np.setdiff1d(left, put)
            slot[left] += self.keys[slot[left]] != -1

    @staticmethod
    def _letters() -> list[str]:
        """The printable stand-ins of bytes in byte-level vocabularies."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown, more = dict.fromkeys(own), 256
        for b in range(256):
            if b in shown:
                shown[b] = chr(b)
            else:
                shown[b], more = chr(more), more + 1
        return [shown[b] for b in range(256)]

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _lookup(self, keys):
        """rank * 2**32 + merged id, or a huge value."""
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], np.int64(1) << 62)
        going = np.flatnonzero((at != keys) & (at != -1))
        while len(going):
            slot[going] += 1
            at = self.keys[slot[going]]
            hit = at == keys[going]
            out[going[hit]] = self.values[slot[going[hit]]]
            going = going[~hit & (at != -1)]
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        ends = np.cumsum(length) - 1
        symbol[ends] = self.final[data[ends]]
        word = np.repeat(np.arange(len(words)), length)
        done_symbol, done_word = [], []
        none = np.int64(1) << 62
        while len(symbol):
            value = np.full(len(symbol), none)
            same = np.flatnonzero(word[1:] == word[:-1])
            value[same] = self._lookup(symbol[same] * self.size + symbol[same + 1])
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(value >> 32, start)
            count = np.diff(np.append(start, len(symbol)))
            finished = best >= none >> 32
            if finished.any():
                out = np.repeat(finished, count)
                done_symbol.append(symbol[out])
                done_word.append(word[out])
                symbol, word, value, best, count = symbol[~out], word[~out], value[~out], best[~finished], count[~finished]
                if not len(symbol):
                    break
                start = np.cumsum(count) - count
            hits = np.flatnonzero((value >> 32) == np.repeat(best, count))
            owner = word[hits]
            at = hits[np.concatenate([[True], owner[1:] != owner[:-1]])]
            symbol[at] = value[at] & 0xFFFFFFFF
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        ids = symbol[order].astype("<u4").tobytes()
        edge = (4 * np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])).tolist()
        return [ids[a:b] for a, b in zip(edge, edge[1:])]


class WordTokenizer:
    """ids(texts) as little-endian unsigned 32-bit bytes, equal to the tokenizer's own encode()."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.within_words = self._within_words(spec)
        if self.within_words:
            self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            self.merges = _Merges(spec)
        self.known: dict[str, bytes] = {}
        self._encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)

    @staticmethod
    def _within_words(spec) -> bool:
        """Whether the file lower-cases and merges within runs without white space only, so that these can be encoded each."""
        normal = (spec.get("normalizer") or {}).get("normalizers", [])
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [x["type"] for x in normal] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
            return False
        split, level = steps
        drops = split["behavior"] == "Removed" and split["invert"] and not level["use_regex"] and not level["add_prefix_space"]
        model = spec["model"]
        simple = model["type"] == "BPE" and model["end_of_word_suffix"] and not (model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model["ignore_merges"])
        return bool(drops and simple and re.fullmatch(r"(?:'[a-z]+\||\[\\p\{[LN]\}\]\+?\||\[\^\\s\\p\{L\}\\p\{N\}\]\+)+", split["pattern"]["Regex"]))

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._encode(texts, add_special_tokens=False)]

    def _learn(self, runs: set[str]) -> None:
        """Remember the ids of runs and of the words in them. A word's ids don't depend on what it stands in."""
        known = self.known
        mixed = [run for run in runs if not run.isalpha()]
        split = [(run[:-1], run[-1]) if run[-1] in ",.;:!?" and run[:-1].isalpha() else self.words.findall(run) for run in mixed]
        words = [*runs.difference(mixed).union(chain.from_iterable(split)).difference(known)]
        short = [w for w in words if len(w) <= LONGEST]
        known.update((w, self._raw([w])[0]) for w in words if len(w) > LONGEST)
        for k in range(0, len(short), 50_000):
            part = short[k : k + 50_000]
            known.update(zip(part, self.merges.encode(part)))
        known.update((run, known[of[0]] + known[of[1]] if len(of) == 2 else b"".join([known[w] for w in of])) for run, of in zip(mixed, split))

    def ids(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        plain = self.within_words
        split = [None if not plain or _PLAIN.search(t) or any(s in t for s in self.special) else t.lower().split() for t in texts]
        if new := set(chain.from_iterable(filter(None, split))).difference(known):
            self._learn(new)
        return [self._raw([t])[0] if words is None else b"".join(map(known.__getitem__, words)) for t, words in zip(texts, split)]
