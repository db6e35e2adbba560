"""A byte-level BPE vocabulary (.json of the tokenizers library): splitting, ids, and counts at every prefix.

Tokens never cross the pieces that the vocabulary's splitting pattern makes, and pieces repeat.  Ids come from the
tokenizers library: its model encodes each piece that a worker has not yet seen (where a piece has characters that the
library might split by another version of Unicode, the whole tokenizer does); prefix counts come from dynamic programming
over each such piece.  What a worker remembers is bounded in bytes, long pieces are never remembered, and neither changes
a result.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np

#: Fixed value: the splitting pattern of byte-level BPE vocabularies of this kind.  Letters stand first: no text that
#: begins a contraction begins a run of letters, so the order of these alternatives changes nothing.
SPLIT = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?=\p{White_Space}|\Z)|\p{White_Space}+"
#: As SPLIT, but white space stays with the piece behind it: cuts in there change how the text before them is split.
UNITS = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|(?>\p{White_Space}+)(?:(?<! )(?:'s|'t|'re|'ve|'m|'ll|'d)|\p{L}+|\p{N}+|[^\p{White_Space}\p{L}\p{N}]+)?"
ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\p{White_Space}": r"\t-\r "}
#: A character whose class may differ between versions of Unicode.
UNSURE = re.compile("[^\x00-\u024f]").search
SHORT = 256  # characters of a piece that is remembered
TOGETHER = 2000  # pieces in one text for the library
#: Bytes (about) of one table of a worker.  An executor has some workers for each of its cores, and idle ones keep theirs.
HELD = 64 << 20


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


@cache
def _two_byte_classes() -> dict[str, str]:
    """The classes of ASCII over all characters up to U+FFFF, as the regex module knows them."""
    import regex

    every = "".join(chr(i) for i in range(1 << 16) if not 0xD800 <= i < 0xE000)
    return {name: "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(f"{name}+", every)) for name in ASCII}


class _Splitter:
    """Finds all pieces of a text; where all characters are of ASCII, or up to U+FFFF, with the standard library, which is faster."""

    def __init__(self, pattern: str) -> None:
        import regex

        def narrow(classes: dict[str, str]) -> Callable[[str], list[str]]:
            out = re.sub(r"(?<!\[)(?<!\})(\\p\{\w+\})(?![\\\]])", r"[\1]", pattern)
            for name in classes:
                out = out.replace(name, classes[name])
            return re.compile(out).findall

        self.ascii, self.two_byte, self.full = narrow(ASCII), narrow(_two_byte_classes()), regex.compile(pattern).findall

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        return self.two_byte(text) if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self.full(text)


class _Known(dict):
    """What ``make`` gives for short pieces; forgets all when it holds ``most`` bytes (about)."""

    def __init__(self, make: Callable[[str], bytes | int], most: int) -> None:
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, piece: str) -> bytes | int:
        out = self.make(piece)
        if len(piece) <= SHORT:
            self.keep(piece, out)
        return out

    def keep(self, piece: str, out: bytes | int) -> None:
        self.held += 180 + len(piece) if isinstance(out, int) else 250 + len(piece) + len(out)
        if self.held > self.most:
            self.forget()
        self[piece] = out

    def keep_all(self, pieces: list[str], out: list[bytes] | list[int]) -> None:
        size = sum(map(len, pieces)) + (180 * len(out) if isinstance(out[0], int) else 250 * len(out) + sum(map(len, out)))
        if size > self.most:
            return
        if self.held + size > self.most:
            self.forget()
        self.held += size
        self.update(zip(pieces, out))

    def forget(self) -> None:
        self.clear()
        self.held = 0


class Vocabulary:
    def __init__(self, path: str, most: int = HELD) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.model, self.plain = self.library.model, self._plain(spec)
        self.letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = {s: self.library.token_to_id(s) for s in special}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words = {i: bytes(byte_of[c] for c in word) for word, i in spec["model"]["vocab"].items() if all(c in byte_of for c in word)}
        self.mark = self._mark(spec["added_tokens"])
        self.split, self.units = _Splitter(SPLIT), _Splitter(UNITS)
        self.ids = _Known(self._ids, most)
        self.sizes = _Known(lambda piece: len(self._ids(piece)) // 4, most)
        self.steps = _Known(self._steps, most)
        self.single: dict[int, bool] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self._ends = None

    def _parts(self, text: str) -> list[str]:
        """The text between special strings, and these."""
        if self.special_cut is None or not any(s in text for s in self.special):
            return [text]
        return self.special_cut.split(text)

    # Ids.

    def _ids(self, piece: str) -> bytes:
        return np.array(self.library.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _mark(added: list[dict]) -> str | None:
        """A special string that can part texts: the only one, that nothing before or behind it changes or completes."""
        if len(added) != 1 or any(added[0].get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")):
            return None
        s = added[0]["content"]
        return None if any(s.startswith(s[-k:]) for k in range(1, len(s))) else s

    @staticmethod
    def _plain(spec: dict) -> bool:
        """Whether the library does nothing with a piece but to give its bytes, as letters, to the model."""
        by_bytes = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        return spec.get("normalizer") is None and by_bytes.items() <= (spec.get("pre_tokenizer") or {}).items() and spec["model"].get("type") == "BPE"

    def _made(self, pieces: list[str], sizes: bool) -> list[int] | list[bytes]:
        """How many ids the library gives for each piece, or their bytes."""
        if self.plain and not any(map(UNSURE, pieces)):
            letters = codecs.charmap_decode(b"\xff".join(map(str.encode, pieces)), "strict", "".join(self.letters))[0]
            found = map(self.model.tokenize, letters.split(self.letters[0xFF]))  # no UTF-8 text has that byte
            if sizes:
                return list(map(len, found))
            lists = [[t.id for t in x] for x in found]
            ends = np.cumsum(list(map(len, lists))).tolist()
            ids, begins = np.array([i for x in lists for i in x], "<u4"), [0, *ends[:-1]]
        else:
            ids, begins, ends = self._joined(pieces)
        if sizes:
            return [b - a for a, b in zip(begins, ends)]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(begins, ends)]

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, list[int], list[int]]:
        """Ids, and where those of each piece begin and end; pieces go to the library as one text, parted by the mark."""
        if self.mark is not None and not any(self.mark in p for p in pieces):
            ids = np.array(self.library.encode_batch_fast([self.mark.join(pieces)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.special[self.mark])
            if len(at) == len(pieces) - 1:
                return ids, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)]
        found = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        ends = np.cumsum([len(x) for x in found]).tolist()
        return np.array([i for x in found for i in x], "<u4"), [0, *ends[:-1]], ends

    def _looked_up(self, texts: list[str], known: _Known) -> list[list]:
        """What ``known`` has for each piece, for each text; unknown short pieces of all of them are encoded at once.

        Only one of the tables of ids and of sizes is held at a time: a worker goes from one to the other seldom.
        """
        other = self.ids if known is self.sizes else self.sizes
        if other:
            other.forget()
        split, looked = self.split, []
        unknown: set[str] = set()
        for text in texts:
            parts = self._parts(text)
            pieces = split(text) if len(parts) == 1 else [p for part in parts for p in ([part] if part in self.special else split(part))]
            found = list(map(known.get, pieces))
            at, place = [], -1
            for _ in range(found.count(None)):
                place = found.index(None, place + 1)
                at.append(place)
            names = [pieces[i] for i in at]
            unknown.update(names)
            looked.append((found, at, names))
        short = [p for p in unknown if len(p) <= SHORT and p not in self.special]
        fresh = {p: known.make(p) for p in unknown.difference(short)}
        sure, other = [p for p in short if not UNSURE(p)], [p for p in short if UNSURE(p)]
        for group in [x[i : i + TOGETHER] for x in (sure, other) for i in range(0, len(x), TOGETHER)]:
            made = self._made(group, known is self.sizes)
            fresh.update(zip(group, made))
            known.keep_all(group, made)
        for p in unknown.intersection(self.special):
            known.keep(p, fresh[p])
        for found, at, names in looked:
            for i, p in zip(at, names):
                found[i] = fresh[p]
        return [found for found, _, _ in looked]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids that the library gives for each text."""
        return [np.frombuffer(b"".join(x), "<u4") for x in self._looked_up(texts, self.ids)]

    def counts(self, texts: list[str]) -> list[int]:
        """How many ids the library gives for each text."""
        return list(map(sum, self._looked_up(texts, self.sizes)))

    # Counts at every prefix.

    def _encoded(self, data: bytes) -> list[int]:
        return [t.id for t in self.library.model.tokenize("".join([self.letters[b] for b in data]))]

    def _single(self, t: int) -> bool:
        if (ok := self.single.get(t)) is None:
            ok = self.single[t] = self._encoded(self.words[t]) == [t]
        return ok

    def _fits(self, a: int, b: int) -> bool:
        if (ok := self.fits.get((a, b))) is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            ok = self.fits[a, b] = self._encoded(self.words[a] + self.words[b]) == [a, b]
        return ok

    def ends(self):
        """Automaton that names the tokens ending at each byte, longest first."""
        if self._ends is None:
            import ahocorasick

            self._ends = ahocorasick.Automaton()
            for t, word in self.words.items():
                self._ends.add_word(word.decode("latin-1"), (len(word), t))
            self._ends.make_automaton()
        return self._ends

    def piece(self, piece: str) -> np.ndarray:
        """counts[i]: tokens of the first i characters of a piece, alone.

        The encoding of a prefix is that of a shorter one plus a last token, and only one token goes with what stands
        before it (two neighbours must encode to themselves): last[i] and count[i] follow from left to right.
        """
        data = piece.encode()
        count, last = [0] * (len(data) + 1), [-1] * (len(data) + 1)
        if len(data) > 4 * SHORT:
            count, last = array("i", count), array("i", last)
        single, fits = self._single, self._fits
        for end, (size, t) in self.ends().iter(data.decode("latin-1")):
            i = end + 1
            if last[i] < 0:
                j = i - size
                if single(t) if j == 0 else last[j] >= 0 and fits(last[j], t):
                    count[i], last[i] = count[j] + 1, t
        if -1 in last[1:]:
            raise ValueError(f"no encoding for a prefix of {piece[:40]!r}")
        counts = np.array(count, np.int64)
        if len(piece) == len(data):
            return counts
        begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        return counts[np.append(np.flatnonzero(begins), len(data))]

    def _steps(self, unit: str) -> bytes:
        """How much the count of a text grows with each character of a unit."""
        core = unit.lstrip()  # where a unit has both, its white space stands first
        gap = unit[: len(unit) - len(core)]
        while gap and self.split(gap) != [gap]:  # str.lstrip also takes control characters that are no white space here
            gap = gap[:-1]
        core = unit[len(gap) :]
        if not core or gap in ("", " "):
            counts = self._core(unit)
        else:
            run = self.piece(gap)
            kept, head = (gap[:-1], " ") if gap[-1] == " " else (gap, "")
            before = (int(run[len(kept)]) if head else int(run[-2]) + int(self.piece(gap[-1])[1])) if len(gap) > 1 else int(run[-1])
            inside = self._core(head + core)
            counts = np.concatenate([run, before + inside[len(head) + 1 :]])
        return np.diff(counts).astype("<i2").tobytes()

    def _core(self, unit: str) -> np.ndarray:
        counts = self.piece(unit)
        if len(unit) == 3 and unit in ("'re", "'ve", "'ll"):  # two characters of these are two pieces
            counts[2] = int(counts[1]) + int(self.piece(unit[1])[1])
        return counts

    def prefix_steps(self, text: str) -> np.ndarray:
        """steps[i]: tokens of text[: i + 1] less those of text[:i]; their running sum is the count at every prefix."""
        out: list[bytes] = []
        begun, ahead = 0, ""  # of the part before a special string: its tokens and itself
        for part in self._parts(text):
            if part not in self.special:
                out.append(b"".join(map(self.steps.__getitem__, self.units(part))))
                ahead = part
                begun = int(np.frombuffer(out[-1], "<i2").sum(dtype=np.int64))
                continue
            # Inside a special string, a cut leaves ordinary text that joins with what stands before it.
            counts = [begun, *(sum(self._total(p) for p in self.split(ahead + part[:c])) for c in range(1, len(part))), begun + 1]
            out.append(np.diff(counts).astype("<i2").tobytes())
        return np.frombuffer(b"".join(out), "<i2")

    def _total(self, piece: str) -> int:
        return len(self.ids[piece]) // 4


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str, most: int = HELD) -> Vocabulary:
    """One for each file and worker; its tables hold ``most`` bytes (about) each from now on."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    for known in (_loaded[path].ids, _loaded[path].sizes, _loaded[path].steps):
        known.most = most
    return _loaded[path]
