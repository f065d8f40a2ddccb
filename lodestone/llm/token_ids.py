"""Whole texts to token ids with the tokenizers library, at the speed of its distinct words.

Byte-pair merges never cross a pre-token. A place before a space or line feed that follows a character other than white
space is always such a border for the pre-tokenizers named in ``segments_of``; so the ids of a text are the ids of its
segments in a row, and a segment that has been seen needs no second encoding. A tokenizer of another kind gets whole texts, and
so does a text that holds a special token's string where such strings are taken for the token.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

from lodestone.llm.runtime import hold

#: A segment: leading white space, then characters up to the next space or line feed. Rarer white space stays inside.
SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: Before the names of segments that were cut by that pattern.
CUT = "  "
#: The one pre-tokenizer for which words and closing marks come apart too. Fixed value.
WORDS_AND_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Segments for it: spaces and line feeds are no part of one, and a run of letters ends before a mark. Only letters that any version
#: of Unicode knows, and that normalising leaves a letter (not U+0130, whose lower case ends in a mark), are told from marks here.
BARE_SEGMENT = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ɏΑ-ΡΣ-Ωα-ωА-я]+(?=[.,;:!? \n])|[.,;:!?]+(?=[ \n])|(?:[^\S \n]\s*\S*|\S+)(?:[^\S \n]\s*\S*)*")
#: The marks that end such a word, which are a pre-token of their own there too: a word is encoded once, whatever follows it.
MARK = frozenset(".,;:!?")
MARKS = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-įı-ɏΑ-ΡΣ-Ωα-ωА-я])[.,;:!?]+$")
#: Segments kept by a Python worker, about 180 MB unless an operator asks for fewer. When there are more, the older half goes.
MOST_KEPT = 900_000

_encoders: dict[tuple, SegmentEncoder] = {}


def _steps(part: dict | None, inner: str) -> list[dict]:
    return (part.get(inner, []) if part["type"] == "Sequence" else [part]) if part else []


def segments_of(spec: dict) -> re.Pattern | None:
    """The pattern of segments that the tokenizer's normalizer and pre-tokenizer treat independently; None if none is known to be."""
    for step in _steps(spec.get("normalizer"), "normalizers"):
        if step["type"] not in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") and not (step["type"] == "Replace" and step.get("pattern") == {"Regex": "\\s+"} and step.get("content") == " "):
            return None
    if any(not x.get("special") or any(x.get(k) for k in ("normalized", "single_word", "lstrip", "rstrip")) for x in spec.get("added_tokens", [])) or spec.get("post_processor"):
        return None
    parts = _steps(spec.get("pre_tokenizer"), "pretokenizers")
    level = parts[-1] if parts else {}
    if level.get("type") != "ByteLevel" or level.get("add_prefix_space"):
        return None
    if len(parts) == 1:
        return SEGMENT if level.get("use_regex") else None
    split = parts[0]
    removed = len(parts) == 2 and not level.get("use_regex") and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
    return BARE_SEGMENT if removed and split.get("pattern") == {"Regex": WORDS_AND_MARKS} else None


class Places(dict):
    """The place of each segment in a table; a segment that is asked for first gets the next place."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []

    def __missing__(self, segment: str) -> int:
        self.names.append(segment)
        self[segment] = place = len(self.names) - 1
        return place

    def forget(self, n: int) -> None:
        """Drop the ``n`` oldest; the others move up."""
        del self.names[:n]
        self.clear()
        self.update(zip(self.names, range(len(self.names)), strict=True))


def words_of(text: str) -> list[str]:
    """Names of the segments of a text whose white space is single spaces and line feeds within it, several times faster than by pattern.

    A word stands for itself behind a space, with a line feed before it for that, with a space before it for itself: a text's first
    word. In other texts a name may be empty or end in white space; those have no segment.
    """
    names = text.replace("\n", " \n").split(" ")
    names[0] = " " + names[0]
    return names


def word_segment(name: str) -> str | None:
    if name.startswith(CUT):
        return name[len(CUT) :]
    if not name or name[-1].isspace():
        return None
    return name[1:] if name[0] == " " else name if name[0] == "\n" else " " + name


class SegmentEncoder:
    """Encodes texts to little-endian id bytes, as the library does with ``add_special_tokens=False``.

    A special token's string in a text becomes that token, which is the library's default; with ``special_as_text`` it is
    ordinary text, as texts from outside should be read before training.
    """

    def __init__(self, path: str, special_as_text: bool = False, most_kept: int | None = None):
        from tokenizers import Tokenizer

        self.most_kept = most_kept or MOST_KEPT

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.segment = segments_of(spec)
        self.by_segment, self.by_word = self.segment is not None, self.segment is SEGMENT
        special = [] if special_as_text else [x["content"] for x in spec.get("added_tokens", []) if x["content"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        # the tokenizer would do it itself, but fewer segments differ this way
        self.lower = any(x["type"] == "Lowercase" for x in _steps(spec.get("normalizer"), "normalizers"))
        if sys.byteorder != "little":
            raise RuntimeError("ids are written as the processor holds them, which must be little-endian")
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        #: The place of each segment, and its ids; None where a name has no segment, and whether there was such a name.
        self.kept, self.table, self.gaps = Places(), [], False

    def _library(self, texts: list[str]) -> list[bytes]:
        kind = self.dtype.char
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_segment:
            return self._library(texts)
        if self.special is None:
            return self._by_segments(texts)
        held = [k for k, t in enumerate(texts) if self.special.search(t)]
        if not held:
            return self._by_segments(texts)
        whole = dict(zip(held, self._library([texts[k] for k in held]), strict=True))
        parts = iter(self._by_segments([t for k, t in enumerate(texts) if k not in whole]))
        return [whole[k] if k in whole else next(parts) for k in range(len(texts))]

    def _by_segments(self, texts: list[str]) -> list[bytes]:
        if self.lower:
            texts = [t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for t in texts]
        find, kept, table = self.segment.findall, self.kept, self.table
        if len(table) > self.most_kept:
            kept.forget(len(table) // 2)
            del table[: len(table) // 2]
        if not self.by_word:
            places = [list(map(kept.__getitem__, find(t))) for t in texts]
            table.extend(self._library(kept.names[len(table) :]))
            return [b"".join(map(table.__getitem__, p)) for p in places]
        cut = lambda t: [CUT + x for x in find(t)]
        places = [list(map(kept.__getitem__, cut(t) if not t or "  " in t or "\n\n" in t or t[0].isspace() or t[-1].isspace() else words_of(t))) for t in texts]
        self._fill()
        # other white space before a space or line feed
        for k in [k for k, p in enumerate(places) if None in map(table.__getitem__, p)] if self.gaps else ():
            places[k] = list(map(kept.__getitem__, cut(texts[k])))
        self._fill()
        return [b"".join(map(table.__getitem__, p)) for p in places]

    def _fill(self) -> None:
        """The ids of the segments that are new in the table."""
        kept, table, names = self.kept, self.table, self.kept.names
        alone, texts, both = [], [], []
        place = len(table)
        while place < len(names):  # the words before marks may be new too, and come at the end
            name = names[place]
            if name[-1:] in MARK and not name.startswith(CUT) and (marks := MARKS.search(name)):
                both.append((place, kept[name[: marks.start()]], kept[CUT + marks.group()]))
            elif (segment := word_segment(name)) is None:
                self.gaps = True
            else:
                alone.append(place)
                texts.append(segment)
            place += 1
        table.extend([None] * (len(names) - len(table)))
        for place, ids in zip(alone, self._library(texts), strict=True):
            table[place] = ids
        for place, word, marks in both:
            table[place] = table[word] + table[marks]


def encoder(path: str, special_as_text: bool = False, most_kept: int | None = None) -> SegmentEncoder:
    """The worker's encoder for that file; what it has seen stays for later tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task's own core
    hold("token_ids", _encoders.clear)
    key = (path, special_as_text, most_kept)
    if key not in _encoders:
        _encoders[key] = SegmentEncoder(path, special_as_text, most_kept)
    return _encoders[key]
