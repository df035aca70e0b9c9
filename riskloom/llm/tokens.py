"""Token ids of whole texts, through the ``tokenizers`` library, with a cache of space-separated units.

A byte-level vocabulary without a normalizer splits a text before merging, and a single space between two
other characters that are no white space always starts such a part.  So the text may be cut there, and
each unit, a space and what follows, has the same ids wherever it stands.  Units recur, so most are looked
up.  Nor does a part reach over a single line feed or from a letter to punctuation, so a new unit's ids come
from those of the word in it and of the punctuation behind that.  Any other tokenizer, and any text whose
spaces are not single, takes the plain way for what is left.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np

#: Bytes of one worker's cache if none are given, and what a unit takes besides its own bytes and ids; it is emptied before it would
#: grow beyond, and units that alone would are not kept.
CACHE_BYTES = 240 << 20
UNIT_BYTES = 200
#: Units that are encoded as one text; the ids of each begin with a token that begins with a space.
JOINED = 200
#: White space here, and two characters that some pattern libraries count as such: never cut beside them.
_CUT = re.compile("(?<=[^\\s᠎​]) (?=[^\\s᠎​])")
#: A line feed beside white space or at the end.
_BLANK = re.compile("\n(?:[\\s\u180e\u200b]|\\Z|(?<=[\\s\u180e\u200b]\n))")
#: Between a letter or digit and punctuation a part always ends.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ENDS = frozenset(c for c in map(chr, range(0x250)) if c.isascii() and c.isalnum() or c.isalpha() and c >= "À")
#: Texts whose units are looked up together; few, so that they stay in the processor's cache.
STEP_TEXTS = 100
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "᠎​"


class TokenEncoder:
    """``encode(texts)``: the ids of each text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, plain_specials: bool = False, cache_bytes: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if plain_specials:
            self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and not spec["model"].get("dropout")
            and not any(t["lstrip"] or t["rstrip"] or {" ", "\n"} & {*t["content"]} for t in spec.get("added_tokens", []))
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.known: dict[str, bytes | None] = {}
        self.held = 0
        self.most = CACHE_BYTES if cache_bytes is None else cache_bytes
        #: Ids of the punctuation behind units.
        self.signs: dict[str, bytes] = {}
        self.opens, self.breaks = np.zeros((2, self.tokenizer.get_vocab_size()), dtype=bool)
        if self.by_unit:
            self.opens[[k for t, k in self.tokenizer.get_vocab().items() if t[:1] == "Ġ"]] = True
            self.breaks[[k for t, k in self.tokenizer.get_vocab().items() if t == "Ċ"]] = True

    def plain(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(texts), 20_000):
            found = self.tokenizer.encode_batch_fast(texts[k : k + 20_000], add_special_tokens=False)
            out.extend(np.array(x.ids, dtype="<u4").tobytes() for x in found)
        return out

    def _units(self, units: list[str], opens: np.ndarray, before: str) -> list[bytes]:
        """Ids of units, each with ``before`` before it; ``opens`` are the tokens that begin one."""
        out: list[bytes] = []
        groups = [units[k : k + JOINED] for k in range(0, len(units), JOINED)]
        for a in range(0, len(groups), 100):
            some = groups[a : a + 100]
            found = self.tokenizer.encode_batch_fast([before + before.join(g) for g in some], add_special_tokens=False)
            for group, one in zip(some, found, strict=True):
                ids = np.array(one.ids, dtype="<u4")
                starts = 4 * np.flatnonzero(opens[ids])
                if len(starts) == len(group) and starts[0] == 0:
                    data, cuts = ids.tobytes(), [*starts.tolist(), 4 * len(ids)]
                    out += [data[x:y] for x, y in zip(cuts, cuts[1:])]  # noqa: B905
                else:
                    out += self.plain([before + u for u in group])
        return out

    def _learn(self, units: set[str]) -> dict[str, bytes | None]:
        """A table that holds all the units; the cache, unless they would not fit into it."""
        new = units.difference(self.known)  # looks up the units; ``-`` with a view would walk the whole cache
        fresh: dict[str, bytes | None] = {}
        words: set[str] = set()
        lines: set[str] = set()
        signed: dict[str, str] = {}
        for u in new:
            stem = u
            if not u.isalpha():
                if not u or u.strip(_SPACES) != (u[1:] if u[0] == "\n" else u):
                    fresh[u] = None
                    continue
                stem = u.rstrip(_SIGNS)
                if len(stem) < len(u) and stem[-1:] in _ENDS and not any(t in u for t in self.added):
                    signed[u] = stem
                    if stem in self.known:
                        continue
                else:
                    stem = u
            (lines if stem[0] == "\n" else words).add(stem)
        fresh.update(zip(words, self._units([*words], self.opens, " "), strict=True))
        fresh.update(zip(lines, self._units([u[1:] for u in lines], self.breaks, "\n"), strict=True))
        signs = {u[len(stem) :] for u, stem in signed.items()}
        unseen = [*signs.difference(self.signs)]
        added = dict(zip(unseen, self.plain(unseen), strict=True))
        for u, stem in signed.items():
            sign = u[len(stem) :]
            fresh[u] = (fresh.get(stem) or self.known[stem]) + (added.get(sign) or self.signs[sign])
        cost = self._cost(fresh) + self._cost(added)
        if self.held + cost > self.most:
            fresh.update((u, self.known[u]) for u in units - new)
            self.known, self.signs, self.held = {}, {}, 0
            cost = self._cost(fresh) + self._cost(added)
            if cost > self.most:
                return fresh
        self.known.update(fresh)
        self.signs.update(added)
        self.held += cost
        return self.known

    @staticmethod
    def _cost(table: dict[str, bytes | None]) -> int:
        return sum(map(len, table)) + sum(map(len, filter(None, table.values()))) + UNIT_BYTES * len(table)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_unit:
            return self.plain(texts)
        return [ids for k in range(0, len(texts), STEP_TEXTS) for ids in self._encode(texts[k : k + STEP_TEXTS])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts = []
        for t in texts:
            if "\n" not in t:
                parts.append(t.split(" "))
            elif not _BLANK.search(t):  # only line feeds between two characters: a part starts at each
                parts.append(t.replace("\n", " \n").split(" "))
            else:  # a unit may not begin with a line feed here
                parts.append(t.split(" ") if " \n" not in t else [""] * 2)
        units: set[str] = set()
        for p in parts:
            units.update(p[1:])
        known = self._learn(units)
        heads = self.plain([p[0] for p in parts])
        out = []
        for text, head, p in zip(texts, heads, parts, strict=True):
            try:
                out.append(head + b"".join(map(known.__getitem__, p[1:])))
            except TypeError:  # a unit that can't be cut off
                first, *rest = _CUT.split(text)
                out.append(b"".join(self.plain([first, *(" " + u for u in rest)])))
        return out


@cache
def encoder(path: str, cache_bytes: int | None = None) -> TokenEncoder:
    """One encoder for each vocabulary file and Python worker."""
    return TokenEncoder(path, cache_bytes=cache_bytes)
