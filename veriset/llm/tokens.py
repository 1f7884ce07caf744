"""Whole-text tokenisation with a public tokenizer, and the cut of a text into parts that may be cached.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the
ids of the parts joined are the ids of the text.  Parts repeat a lot; each worker
keeps the ids of those it met, as little-endian bytes, in two generations of
``CACHE_BYTES`` each.  A text that could be read otherwise goes to the library whole, as does
one that holds an added token (as it is or lower-cased).
"""

from __future__ import annotations

import re
import struct
from codecs import charmap_decode
from collections.abc import Callable
from itertools import chain, compress, count, repeat
from operator import is_

import numpy as np

#: Bytes that a generation of a worker's cache may take, keys, values and their places counted.
CACHE_BYTES = 32 << 20
#: What a pair of bytes objects and its place in a dictionary take beside the bytes themselves (33 each, rounded up to 16, and about 45).
ENTRY_BYTES = 125
_ODD = re.compile(rb"[ \t-\r\x1c-\x1f]{2}|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf")
_FOREIGN = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf")
#: What every match of _FOREIGN begins with; to look for these first is several times faster.
_FOREIGN_LEADS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf")
#: White space other than spaces and line breaks, and two of these side by side.
_RARE_BLANKS = (b"\t", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x1d", b"\x1e", b"\x1f")
_PAIRS = (b"  ", b"\n\n", b" \n", b"\n ")
#: Marks that compose with A-Z: the library composes before it lower-cases, so such a text keeps its case.
_MARKS = (b"\xcc", b"\xcd")
#: Lower-case Latin letters alone: no normalizer changes them and no pre-tokenizer cuts them.
_PLAIN = re.compile(rb"(?=[a-z\xc3])[a-z]*(?:\xc3[\x9f-\xb6\xb8-\xbf][a-z]*)*")
#: The same with capitals, for tokenizers that keep the case: a space and such a word are one piece, a line break and such a word are two.
_LETTERS = re.compile(rb"\n?(?=[A-Za-z\xc3])[A-Za-z]*(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][A-Za-z]*)*")
#: ASCII signs; a run of them between letters and the end of a word is a piece of its own.
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Signs of a run whose ids are kept.
TAIL = 3
#: Words encoded as one text: fewer cost calls, more cost the library's queue of merges.
RUN = 64
_PROBE = "stupid straße élève niño zzqxj a ÿ"
_LED_PROBE = " stupid straße\nÉlève niño\nzzqxj A ÿ Àà\nÞ"


class _Parts:
    """Ids of parts as bytes; the older generation goes when the younger holds ``most`` bytes.

    What one call brings is kept until the next, so a call should ask for a bounded number of parts.
    """

    def __init__(self, encode: Callable[[list[bytes]], dict[bytes, bytes]], most: int) -> None:
        self.encode, self.most, self.held = encode, most, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def put(self, fresh: dict[bytes, bytes]) -> None:
        size = ENTRY_BYTES * len(fresh) + sum(map(len, fresh)) + sum(map(len, fresh.values()))
        if self.held and self.held + size > self.most:
            self.young, self.old, self.held = {}, self.young, 0
        self.young.update(fresh)
        self.held += size

    def look_up(self, parts: list[bytes]) -> list[bytes]:
        values = list(map(self.young.get, parts))
        absent = list(compress(count(), map(is_, values, repeat(None))))
        need, old = {parts[i] for i in absent}, self.old.get
        found = {p: v for p in need if (v := old(p)) is not None}  # an intersection would walk over the whole generation
        found |= self.encode(list(need.difference(found)))
        self.put(found)
        for i in absent:
            values[i] = found[parts[i]]
        return values


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids) if len(ids) < 64 else np.asarray(ids, "<u4").tobytes()


def is_odd(body: bytes) -> bool:
    """Whether a text may be cut otherwise than before single spaces and line breaks; the usual cases need no pattern."""
    if any(x in body for x in _RARE_BLANKS):
        return _ODD.search(body) is not None
    return any(x in body for x in _PAIRS) or is_foreign(body)


def is_foreign(body: bytes) -> bool:
    return any(x in body for x in (_FOREIGN_LEADS[:4] if body.isascii() else _FOREIGN_LEADS)) and _FOREIGN.search(body) is not None


def _byte_signs() -> str:
    """The sign that byte-level tokenizers have for each byte: the printable ones of Latin-1 themselves, the others in their order from U+0100 on."""
    others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return "".join(chr(256 + others.index(b) if b in others else b) for b in range(256))


_SIGN_OF_BYTE = _byte_signs()
#: Bytes of the words that _LETTERS matches.
_LETTER_BYTES = bytes(b for b in range(256) if chr(b).isascii() and chr(b).isalpha() or b == 0xC3 or 0x80 <= b <= 0xBF)


def _ends_sentence(token: str) -> bool:
    """Tokens whose last sign but quotes and brackets is a full stop, ! or ?."""
    return token.endswith("</w>") and token.removesuffix("</w>").rstrip("\"')]}»”’").endswith((".", "!", "?", "…", "。"))


def _ids(vocab: dict[str, int], rule: Callable[[str], bool]) -> np.ndarray:
    """Which ids have tokens that keep the rule."""
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for token, i in vocab.items() if rule(token)]] = True
    return out


class Encoder:
    """``encode(bodies) -> ids as little-endian uint32 bytes`` for one tokenizer file.

    ``kind``: ``byte`` for byte-level pre-tokenizers that keep a space with the word
    after it, ``word`` for those that drop white space.
    """

    def __init__(self, path: str, kind: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added += [t.lower() for t in self.added if t.lower() != t]
        self.leads = {x.encode() for t in self.added for x in (t[0], t[0].lower(), t[0].upper())}
        self.newline = self._call(["\n"])[0] if kind == "byte" else b""
        vocab = self.tokenizer.get_vocab()
        self.sentence_ends = _ids(vocab, _ends_sentence)
        self.bare, self.closes = self._bare(vocab) if kind == "word" else (None, np.zeros(0, bool))
        self.tails: dict[bytes, bytes] = {}
        self.plain = _PLAIN if kind == "word" else _LETTERS
        self.run, self.opens = self._run(vocab) if kind == "byte" else (None, np.zeros(0, bool))
        self.parts = _Parts(self._cached_parts, CACHE_BYTES)

    def _call(self, texts: list[str]) -> list[bytes]:
        return [pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bare(self, vocab: dict[str, int]) -> tuple:
        """The same model for plain words, without the passes that leave them as they are; and the ids that end a word."""
        from tokenizers import Tokenizer, pre_tokenizers

        bare = Tokenizer(self.tokenizer.model)  # shares the vocabulary
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        same = bare.encode(_PROBE, add_special_tokens=False).ids == self.tokenizer.encode(_PROBE, add_special_tokens=False).ids
        return (bare if same else None), _ids(vocab, lambda token: token.endswith("</w>"))

    def _run(self, vocab: dict[str, int]) -> tuple:
        """The same model without any cutting, for plain words with a space or line break before each; and the ids that begin with one of these.

        No merge may join a word to the space or line break behind it: then the ids of a run of words are those of its words.
        """
        from tokenizers import Tokenizer

        space, line, letters = (charmap_decode(x, "strict", _SIGN_OF_BYTE)[0] for x in (b" ", b"\n", _LETTER_BYTES))
        across = re.compile(f"(?=[{letters}{space}{line}]*$).*[{letters}][{space}{line}]")
        run = Tokenizer(self.tokenizer.model)  # shares the vocabulary
        probe = charmap_decode(_LED_PROBE.encode(), "strict", _SIGN_OF_BYTE)[0]
        same = run.encode(probe, add_special_tokens=False).ids == self.tokenizer.encode(_LED_PROBE, add_special_tokens=False).ids
        return (run if same and not any(map(across.match, vocab)) else None), _ids(vocab, lambda token: token.startswith((space, line)))

    def _led(self, words: list[bytes]) -> list[bytes]:
        """Ids of plain words with a space or line break before each, encoded in runs and cut before every id that begins with one."""
        if self.run is not None and words:
            runs = [(b" " + b" ".join(words[i : i + RUN])).replace(b" \n", b"\n") for i in range(0, len(words), RUN)]
            made = self.run.encode_batch_fast([charmap_decode(r, "strict", _SIGN_OF_BYTE)[0] for r in runs], add_special_tokens=False)
            ids = np.asarray(list(chain.from_iterable(e.ids for e in made)), "<u4")
            starts = (4 * np.flatnonzero(self.opens[ids])).tolist()
            if len(starts) == len(words) and starts[0] == 0:
                data = ids.tobytes()
                return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
        return self._byte_parts(words)

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """Ids of plain words, encoded as one text and cut behind every id that ends a word."""
        if self.bare is not None and words:
            ids = np.asarray(self.bare.encode_batch_fast([b" ".join(words).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) == len(words):
                data = ids.tobytes()
                return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return self._call([w.decode("utf-8") for w in words])

    def _tail(self, signs: bytes) -> bytes:
        if signs not in self.tails:
            self.tails[signs] = self._call([signs.decode("ascii")])[0]
        return self.tails[signs]

    def _cached_parts(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of parts and of words within them.  Signs behind letters are a piece of their own: such words are encoded without them."""
        young, old, is_plain = self.parts.young.get, self.parts.old.get, self.plain.fullmatch
        known: dict[bytes, bytes] = {}
        words: dict[bytes, None] = {}  # plain ones, to be encoded
        tailed, stems, tails, other = [], [], [], []
        for p in parts:
            w = p.rstrip(_SIGNS)
            n = len(p) - len(w)
            if n > TAIL or not is_plain(w):
                other.append(p)
            elif not n:
                words[p] = None
            elif ids := young(w) or old(w):
                known[p] = ids + self._tail(p[-n:])
            else:
                words[w] = None
                tailed.append(p)
                stems.append(w)
                tails.append(self._tail(p[-n:]))
        plainly, otherwise = (self._plain, self._word_parts) if self.kind == "word" else (self._led, self._byte_parts)
        known.update(zip(words, plainly(list(words)), strict=True))
        known.update([(p, known[w] + t) for p, w, t in zip(tailed, stems, tails, strict=True)])
        known.update(zip(other, otherwise(other), strict=True))
        return known

    def _holds_added(self, body: bytes) -> bool:
        if not any(x in body for x in self.leads):
            return False
        text = body.decode("utf-8")
        low = text.lower()
        return any(t in text or t in low for t in self.added)

    def _words(self, body: bytes) -> list[bytes] | None:
        """Words of a text in lower-case A-Z; None if it must go to the library whole."""
        if is_foreign(body):
            return None
        return body.split() if any(x in body for x in _MARKS) else body.lower().split()

    def _word_parts(self, parts: list[bytes]) -> list[bytes]:
        return self._call([p.decode("utf-8") for p in parts])

    def _byte_parts(self, parts: list[bytes]) -> list[bytes]:
        """A part stands after a space, or begins with the line break that it stands after."""
        ids = self._call([(p[1:] if p[:1] == b"\n" else b" " + p).decode("utf-8") for p in parts])
        return [self.newline + x if p[:1] == b"\n" else x for p, x in zip(parts, ids, strict=True)]

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        flat: list[bytes] = []
        spans: list[tuple[int, int] | None] = []
        lead = 0 if self.kind == "word" else 4
        for b in bodies:
            if self._holds_added(b):
                parts = None
            elif self.kind == "word":
                parts = self._words(b)
            elif is_odd(b) or len(self.newline) != lead:
                parts = None
            else:  # a line break before the text lets its first part be like any other; its id is cut off again
                parts = (b"\n" + b).replace(b"\n", b" \n").split(b" ")[1:]
            if parts is None:
                spans.append(None)
                continue
            at = len(flat)
            flat += parts
            spans.append((at, len(flat)))
        values = self.parts.look_up(flat)
        return [self._call([b.decode("utf-8")])[0] if span is None else b"".join(values[span[0] : span[1]])[lead:] for b, span in zip(bodies, spans, strict=True)]


_encoders: dict[tuple[str, str], Encoder] = {}


def release() -> None:
    """Forget the encoders and their caches; a worker that takes up other work calls this."""
    _encoders.clear()


def encoder(path: str, kind: str) -> Encoder:
    """One per worker process."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
