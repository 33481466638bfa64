"""Token ids of whole texts through a tokenizers file, with distinct chunks encoded once.

Pre-tokenisation of the two kinds of file known here never joins characters across the start of a run of ASCII white
space that follows another character, so a text is cut there, distinct pieces are encoded, and ids are joined again.
Texts are cut and pieces numbered by Arrow, without an object for each piece.  Texts with other white space, which
pre-tokenisers may join with ASCII white space, and texts that may hold a special token are encoded as they are, and so
is every text if the file is of another kind."""

from __future__ import annotations

import json
import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvane.llm.common import HELD, WordCache

_CHUNK = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 4 << 20
#: Distinct chunks that an encoder remembers, at most.
CACHED = 700_000
#: White space and invisible separators beyond ASCII.
_OTHER_SPACE = re.compile("[" + "".join(map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))) + "]")


#: Joins chunks for the encoder: a special token of both vocabularies, which pre-tokenisation cuts off first.
_SEPARATOR = "<|endoftext|>"
#: Chunks of one joined string.
_JOINED = 500
#: Words of letters of Latin-1, with marks after them or none, as chunks of texts that are cut at spaces.  Byte-level
#: pre-tokenisation makes the letters one word and the marks another.
_WORD = re.compile(rb"((?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++)([!#-&(-/:;=?@\[-`{}~]*+)").fullmatch
#: Words of one joined string.
_JOINED_WORDS = 200
#: The characters that the byte-level alphabet has for bytes.
_BYTE_CHARS = {i: chr(c) for i, c in zip([*(i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174), *(i for i in range(256) if i < 33 or 127 <= i <= 160 or i == 173)], [*(i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174), *range(256, 324)])}
#: The same for joined words read as Latin-1, whose spaces stay and whose 0x01 is a word's space: what is to be replaced.
_JOINED_CHARS = [("\1", _BYTE_CHARS[32]), ("\n", _BYTE_CHARS[10]), *((chr(i), _BYTE_CHARS[i]) for i in range(128, 256) if _BYTE_CHARS[i] != chr(i))]
# What a byte is to byte-level pre-tokenisation of Latin text.
_MARK_CLASS = bytes(46 if chr(i) in ".," else 97 if i >= 128 or chr(i).isalnum() else 32 if i in (10, 32) else 33 for i in range(256))


def _single_spaces(t: bytes) -> bool:
    """Whether white space of a text is single spaces and line breaks between other characters.  Its chunks are then cut
    at spaces and go without them, but for the first, which has a zero byte before it, and those of line breaks; in other
    texts each chunk has a zero byte before it."""
    return not (b"  " in t or b"\n\n" in t or b" \n" in t or b"\n " in t or t[:1] in b" \n" or t[-1:] in b" \n" or len(t) != len(t.translate(None, b"\0\t\v\f\r")))


def _unkey(c: bytes) -> bytes:
    return c[1:] if c[:1] == b"\0" else c if c[:1] == b"\n" else b" " + c


# What a byte is to pre-tokenisation: a stop or comma, a letter, digit or space, or something else.
_CLASS = bytes(46 if chr(i) in ".," else 97 if i >= 128 or chr(i).isalnum() or i in (*range(9, 14), 32) else 33 for i in range(256))
_ASCII = bytes(range(128))
#: Chunks of words that pre-tokenisation cuts as the known files do.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _latin(t: bytes) -> bool:
    """Whether all characters beyond ASCII are letters of Latin-1."""
    rest = t.translate(None, _ASCII)
    return not rest or 2 * rest.count(b"\xc3") == len(rest) and b"\xc3\x97" not in rest and b"\xc3\xb7" not in rest


def _lone_stops(t: bytes) -> bool:
    """Whether stops and commas of a Latin text stand next to white space, letters and digits alone.  Pre-tokenisation
    then cuts them off anyway, and as words of their own they leave fewer distinct words to encode."""
    c = t.translate(_CLASS)
    return not (b".." in c or b".!" in c or b"!." in c)


def _stops_apart(t: bytes) -> bytes:
    """A text of single spaces with its stops and commas as chunks of their own, if pre-tokenisation cuts all of them off:
    each stands after a letter or digit and before one, white space or the end.  Fewer distinct chunks are left to encode."""
    c = t.translate(_MARK_CLASS)
    if b".." in c or b"!." in c or b".!" in c or b" ." in c or c[:1] == b"." or not _latin(t):
        return t
    return t.replace(b".", b" \0.").replace(b",", b" \0,")


def known_kind(path: str, spaces: bool) -> bool:
    """Whether a file's normaliser, pre-tokeniser and special tokens are those that cutting at white space relies on."""
    with open(path, encoding="utf-8") as f:
        head = json.load(f)
    steps = lambda x, many: [] if not x else x[many] if x["type"] == "Sequence" else [x]
    normal, cut = steps(head.get("normalizer"), "normalizers"), steps(head.get("pre_tokenizer"), "pretokenizers")
    special = all(t["special"] and not t["normalized"] and t["content"].startswith("<|") for t in head["added_tokens"])
    if not special or head["model"]["type"] != "BPE" or head["model"].get("dropout") or any(t["content"] == _SEPARATOR for t in head["added_tokens"]) is False:
        return False
    if spaces:
        return not normal and [(c["type"], c.get("use_regex"), c.get("add_prefix_space")) for c in cut] == [("ByteLevel", True, False)]
    return (
        [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cut] == ["Split", "ByteLevel"]
        and cut[0]["pattern"] == {"Regex": _WORD_PATTERN} and cut[0]["behavior"] == "Removed" and not cut[1]["use_regex"]
    )


def encoder(path: str, spaces: bool, remembered: int = CACHED, escape: bool = False) -> Encoder:
    """This process's encoder of a file: a reused Python worker keeps its chunks from one task to the next."""
    held = sys.modules.setdefault(HELD, types.ModuleType(HELD)).__dict__
    if (path, spaces, remembered, escape) not in held:
        held.clear()
        held[path, spaces, remembered, escape] = Encoder(path, spaces, remembered, escape)
    return held[path, spaces, remembered, escape]


class Encoder:
    """encode(texts) returns the ids of all texts end to end and the number of each, as the library's plain call gives
    them with add_special_tokens=False.

    `spaces`: the vocabulary's ids depend on white space and case (byte-level); otherwise words in lower case are looked
    up.  `escape`: a special token's name in a text is encoded as plain characters; by default it is that token, as in
    the plain call."""

    def __init__(self, path: str, spaces: bool, remembered: int = CACHED, escape: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.joiner = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tok.encode_special_tokens = escape
        self.cut = self.joiner.token_to_id(_SEPARATOR) if known_kind(path, spaces) else None
        self.spaces = spaces
        self.byword = None
        if spaces and self.cut is not None and self.tok.token_to_id(_BYTE_CHARS[10]) is not None:
            from tokenizers import pre_tokenizers

            self.byword, self.line = Tokenizer.from_file(path), self.tok.token_to_id(_BYTE_CHARS[10])
            self.byword.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._reset()
        self.cache = WordCache(self._grow, limit=remembered, compact=self._compact)

    def _reset(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _compact(self, kept: np.ndarray) -> None:
        size = self.size[kept]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        self.flat = np.concatenate([self.flat[np.repeat(self.start[kept] - (ends - size), size) + np.arange(total)], np.zeros(1 << 16, np.uint32)])
        self.used = total
        spare = np.zeros(1 << 14, np.int64)
        self.start, self.size = np.concatenate([ends - size, spare]), np.concatenate([size, spare])

    def _plain(self, text: bytes) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)

    def _chunks(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks end to end, and the number of each."""
        if not self.byword:
            return self._pieces([_unkey(c) for c in chunks] if self.spaces else chunks)
        found = list(map(_WORD, chunks))
        words = np.fromiter(map(bool, found), bool, len(chunks))
        (ids, sizes), (rest, rest_sizes) = self._words([m for m in found if m]), self._pieces([_unkey(c) for c, m in zip(chunks, found) if not m])
        lens = np.zeros(len(chunks), np.int64)
        lens[words], lens[~words] = sizes, rest_sizes
        out, own = np.zeros(int(lens.sum()), np.uint32), np.repeat(words, lens)
        out[own], out[~own] = ids, rest
        return out, lens

    def _words(self, found: list) -> tuple[np.ndarray, np.ndarray]:
        """The same for words with a space before them: the library splits them at spaces alone, already in the byte-level
        alphabet, with a line break after each."""
        lines = [b"\1%b %b \n" % m.groups() for m in found]
        joined = [b"".join(lines[i : i + _JOINED_WORDS]).decode("latin-1") for i in range(0, len(lines), _JOINED_WORDS)]
        for old, new in _JOINED_CHARS:
            joined = [j.replace(old, new) for j in joined]
        return self._at(self.byword, joined, self.line)

    def _pieces(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        between = _SEPARATOR.encode()
        joined = [(between.join(chunks[i : i + _JOINED]) + between).decode("utf-8", "replace") for i in range(0, len(chunks), _JOINED)]
        return self._at(self.joiner, joined, self.cut)

    @staticmethod
    def _at(tok, joined: list, cut: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of joined strings without the cuts between chunks, and how many each chunk has."""
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(x.ids, np.uint32) for x in tok.encode_batch_fast(joined, add_special_tokens=False))])
        cuts = np.flatnonzero(flat == cut)
        return flat[flat != cut], np.diff(cuts, prepend=-1) - 1

    def _grow(self, chunks: list, start: int) -> None:
        if start == 0:
            self._reset()
        ids, lens = self._chunks(chunks)
        end = start + len(chunks)
        if end > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(max(end, len(x)), np.int64)]) for x in (self.start, self.size))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[start:end] = lens
        self.start[start:end] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        whole, kinds = {}, ([], [])  # texts as they are; two ways to cut the others
        for i, t in enumerate(texts):
            if not t:
                continue
            latin = _latin(t)
            if self.cut is None or b"<|" in t or t.translate(None, _KEEP) or not latin and _OTHER_SPACE.search(t.decode("utf-8", "replace")):
                whole[i] = self._plain(t)
            elif self.spaces:
                kinds[not _single_spaces(t)].append(i)
            else:
                kinds[not (latin and _lone_stops(t))].append(i)
        pieces, counts = zip(*(self._cut([texts[i] for i in own], simple) for own, simple in zip(kinds, (True, False))))
        order = np.array(kinds[0] + kinds[1], np.int64)
        at = self.cache.lookup_array(pa.concat_arrays(pieces))
        counts = np.concatenate(counts)
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(total)]
        per_text = np.zeros(len(texts), np.int64)
        per_text[order] = np.bincount(np.repeat(np.arange(len(order)), counts), sizes, len(order)).astype(np.int64)
        if whole or len(kinds[0]) and len(kinds[1]):
            own = dict(zip(order.tolist(), np.split(ids, np.cumsum(per_text[order])[:-1]) if len(order) else [])) | whole
            for i, x in whole.items():
                per_text[i] = len(x)
            ids = np.concatenate([np.zeros(0, np.uint32), *(own[i] for i in sorted(own))]).astype(np.uint32)
        return ids, per_text

    def _cut(self, texts: list, simple: bool) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, and how many each has."""
        if not texts:
            return pa.array([], pa.binary()), np.zeros(0, np.int64)
        if not self.spaces:
            low = pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.string()))
            if simple:
                low = pc.replace_substring(pc.replace_substring(low, ".", " . "), ",", " , ")
            cut = pc.ascii_split_whitespace(low)  # an end of white space gives an empty word, which has no ids
        elif simple:
            cut = pc.split_pattern(pa.array([b"\0" + _stops_apart(t).replace(b"\n", b" \n") for t in texts], pa.binary()), " ")
        else:
            cut = pa.array([[b"\0" + c for c in _CHUNK.findall(t)] for t in texts], pa.list_(pa.binary()))
        return cut.flatten().cast(pa.binary()), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)


#: All bytes but the four ASCII separators 0x1C to 0x1F, to find whether a text has one of those.
_KEEP = bytes(i for i in range(256) if not 0x1C <= i <= 0x1F)
