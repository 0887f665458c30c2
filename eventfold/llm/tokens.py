"""Token ids by a public tokenizer file, with a memory of the pieces a worker
has met.

The pre-tokenizers of both files never join what stands before a run of spaces
(or, where white space is dropped, of any white space) with the run, so a text
is cut there into units and each is encoded on its own; the concatenated ids
equal those of the whole text (tests hold them against the library on whole
texts). Units repeat, so a worker remembers their ids, up to a bounded number.
Where white space is kept and the file's merges stand in the order of its ids,
ids are ranks: the ranks engine gives the same ids, several times faster, and
takes texts whole. Other units are encoded by the file's own library. A text
that holds the literal of a special token is encoded whole, as the library does
by default: the literal gives the token's id.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable
from itertools import chain

#: White space as the tokenizer library's patterns understand it (Unicode White_Space).
_WS = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Where a run of spaces follows another character and is followed by one: no file's pattern joins both sides.
_CUT = re.compile(r"(?<=\S)(?= +[^ ])")
_BLANK_SPACE = re.compile(r"\s ")
_WORD = re.compile(f"[^{_WS}]+")
END_ID = 1
MEMORY_PIECES = 400_000

#: The pre-tokenizer pattern of byte-level BPE files with ``use_regex``, and that of BPE files with word ends.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END_BYTES = [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes in order for U+0100 and on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


Engine = Callable[[list[str]], list]


def ranks_engine(path: str):
    """The ranks engine for a byte-level BPE file, special tokens' strings being plain text, or None.

    If the file's merges give its tokens in the order of their ids, ids are ranks and the ranks engine
    (several times faster than the file's own library) gives the same ids."""
    alphabet = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    in_order = (sorted(ranks.values()) == list(range(len(ranks))) and len(ranks) == 256 + len(merges)
                and all(model["vocab"][t] == 256 + i for i, t in enumerate(merges)))
    plain = (spec.get("normalizer") is None and spec["pre_tokenizer"]["type"] == "ByteLevel"
             and spec["pre_tokenizer"].get("use_regex", True) and not spec["pre_tokenizer"]["add_prefix_space"])
    if not (in_order and plain):
        return None
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_level_encoder(path: str) -> Engine:
    """Texts to lists of ids, by a byte-level BPE file, special tokens' strings being plain text: by the ranks
    engine, if it gives the file's ids, else by the file's own library."""
    from tokenizers import Tokenizer

    engine = ranks_engine(path)
    if engine:
        return lambda texts: list(map(engine.encode_ordinary, texts))
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]


#: Letters of two UTF-8 bytes that lower() and NFC treat one by one: Latin, Greek and Cyrillic, without capital sigma and dotted I.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u02af\u0391-\u03a1\u03a4-\u03c9\u0400-\u0450]+")


def word_end_encoder(path: str) -> Engine | None:
    """Pieces without white space to lists of ids by a BPE file whose words end in a suffix, None for a piece
    that needs the file's own library; None if the file is of another kind or its merges are not in the order of its ids.

    A byte that ends a word is a symbol of its own. One table of ranks over byte strings holds inner and last
    symbols, if the bytes that can end a word get other byte values: in ASCII pieces the high bit is free for
    that, in words of two-byte letters the bytes that no such word holds are."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    if not suffix or pre[0].get("pattern", {}).get("Regex") != WORD_END_PATTERN or pre[1:] != WORD_END_BYTES:
        return None
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    numbers = [model["vocab"][t] for t in merges]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    if any(a >= b for a, b in zip(numbers, numbers[1:])) or len(model["vocab"]) != 512 + len(merges) + len(special & model["vocab"].keys()):
        return None
    import unicodedata

    import tiktoken

    alphabet = byte_alphabet()
    tokens = [(bytes(alphabet[c] for c in (t[:-len(suffix)] if t.endswith(suffix) and t != suffix else t)), t.endswith(suffix) and t != suffix, i)
              for t, i in model["vocab"].items() if t not in special]

    def engine(inner: set[int], last: dict[int, int]):
        """Words of the bytes ``inner``; a byte that ends one is written as ``last`` of it."""
        ranks = {t[:-1] + bytes((last[t[-1]] if end else t[-1],)): i for t, end, i in tokens
                 if inner.issuperset(t) and (not end or t[-1] in last)}
        spare = iter(range(1 << 30, 1 << 31))  # the library wants a rank for every byte; these are never met
        ranks.update((bytes((b,)), next(spare)) for b in range(256) if bytes((b,)) not in ranks)
        return tiktoken.Encoding("word-ends", pat_str=r".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    plain = engine(set(range(128)), {b: b | 128 for b in range(128)})
    used = {*range(97, 123), *range(128, 192), *range(0xC3, 0xD2)}
    ends = [*range(97, 123), *range(128, 192)]
    last = dict(zip(ends, (b for b in range(256) if b not in used)))
    wide = engine(used, last)
    cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)

    def encode(pieces: list[str]) -> list[list[int] | None]:
        out: list[list[int] | None] = []
        for p in pieces:
            if p.isascii():
                ids: list[int] = []
                for word in cut.findall(p.lower()):
                    ids += plain(word[:-1].encode() + bytes((ord(word[-1]) | 128,)))
                out.append(ids)
                continue
            letters = p.rstrip(".,;:!?")
            word, marks = letters.lower().encode(), p[len(letters):]
            if _LETTERS.fullmatch(letters) and used.issuperset(word) and unicodedata.is_normalized("NFC", letters):
                ids = wide(word[:-1] + bytes((last[word[-1]],)))
                out.append(ids + plain(marks[:-1].encode() + bytes((ord(marks[-1]) | 128,))) if marks else ids)
            else:
                out.append(None)
        return out
    return encode


class Encoder:
    """ids(texts): the ids of each text as one bytes object, little-endian
    unsigned integers of ``width`` bytes. ``drops_blanks`` says that the file's
    normalizer and pre-tokenizer drop white space altogether."""

    _by_path: dict[tuple[str, bool], "Encoder"] = {}

    def __init__(self, path: str, drops_blanks: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Literals of the file's added tokens: those searched in the text as it is, and those in the normalized one, lower-cased.
        self.literals = [t.content for t in added if not t.normalized]
        self.normalized = [t.content.lower() for t in added if t.normalized]
        self.drops_blanks = drops_blanks
        #: The ranks engine, if the file allows it: it takes whole texts as fast as units and hands their ids over as bytes.
        self.ranks = None if drops_blanks else ranks_engine(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.engine = None if drops_blanks or self.ranks else byte_level_encoder(path)
        self.lower_engine = word_end_encoder(path) if drops_blanks else None
        #: ids by unit, and by first unit of a text (which has no space in front)
        self.known: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, drops_blanks: bool) -> "Encoder":
        """One encoder per Python worker, kept between tasks."""
        key = (path, drops_blanks)
        if key not in cls._by_path:
            cls._by_path[key] = cls(path, drops_blanks)
        return cls._by_path[key]

    def _cut(self, text: str | None) -> tuple[str, list[str]]:
        """The first unit of a text, and the units after it without the space in front of each."""
        if not text:
            return "", []
        if self.drops_blanks:
            if self.lower_engine and text.isascii():
                text = text.lower()  # as the normalizer does; fewer units to remember
            # Python's split() also cuts at four separators that are no white space here
            odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
            return "", _WORD.findall(text) if odd else text.split()
        head, *units = text.split(" ")
        if "" in units or not head or _BLANK_SPACE.search(text):
            head, *units = _CUT.split(text)
            units = [u[1:] for u in units]
        return head, units

    def _has_literal(self, text: str) -> bool:
        return any(x in text for x in self.literals) or bool(self.normalized) and any(x in text.lower() for x in self.normalized)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        if self.engine:
            return self.engine(pieces)
        if self.lower_engine:
            quick = self.lower_engine(pieces)
            slow = iter(self._by_file([p for p, ids in zip(pieces, quick) if ids is None]))
            return [next(slow) if ids is None else ids for ids in quick]
        return self._by_file(pieces)

    def _by_file(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, memory: dict[str, bytes], units: set[str], before: str) -> dict[str, bytes]:
        """The memory with all of ``units``; a full one keeps those of the units that it has."""
        fresh = list(units - memory.keys())
        if len(memory) + len(fresh) > MEMORY_PIECES:
            memory = {u: memory[u] for u in units & memory.keys()}
        kind = "H" if self.width == 2 else "I"
        for i in range(0, len(fresh), 10_000):
            part = fresh[i:i + 10_000]
            encoded = self._encode([before + u for u in part] if before else part)
            memory.update((u, struct.pack(f"<{len(e)}{kind}", *e)) for u, e in zip(part, encoded))
        return memory

    def ids(self, texts: list[str | None]) -> list[bytes]:
        whole = {i: t for i, t in enumerate(texts) if t and self._has_literal(t)}
        if self.ranks:
            kind = f"<u{self.width}"
            return [b"" if not t else self._by_library(t) if i in whole else self.ranks.encode_to_numpy(t, disallowed_special=()).astype(kind).tobytes()
                    for i, t in enumerate(texts)]
        cut = [("", []) if i in whole else self._cut(t) for i, t in enumerate(texts)]
        self.known = self._learn(self.known, set(chain.from_iterable(units for _, units in cut)), "" if self.drops_blanks else " ")
        self.heads = self._learn(self.heads, {head for head, _ in cut}, "")
        get = self.known.__getitem__
        out = [self.heads[head] + b"".join(map(get, units)) for head, units in cut]
        for i, t in whole.items():
            out[i] = self._by_library(t)
        return out

    def _by_library(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()


def batches(column, most_chars: int = 2_000_000):
    """(first row, texts) slices of an Arrow string column, of bounded size
    unless one text alone is larger."""
    texts, chars, first = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        texts.append(t)
        chars += len(t or "")
        if chars >= most_chars:
            yield first, texts
            texts, chars, first = [], 0, i + 1
    if texts:
        yield first, texts
