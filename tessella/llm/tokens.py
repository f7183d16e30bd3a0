"""Token ids of whole texts by the tokenizers library, with a bounded memory of chunks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import common

#: Chunks longer than this, or more than this many, are not remembered.
LONGEST, MOST = 64, 800_000
#: How the vocabulary writes the end of a word.
WORD_END = "</w>"

#: Characters of texts that are encoded at once.
SLICE = 1 << 22

#: Words that the tokenizer does not split before its model.
_WORD = re.compile(r"[a-zß-öø-ÿ]+")
_LATIN_WORD = re.compile(_WORD.pattern.encode("latin-1"))

#: By Latin-1 byte: the lower-case letter; ASCII punctuation; the letters a-z, ß-ö, ø-ÿ; what chunks are separated by.
_LOWER = bytes(ord(chr(i).lower()) for i in range(256))
_PUNCT = np.array([33 <= i <= 47 or 58 <= i <= 64 or 91 <= i <= 96 or 123 <= i <= 126 for i in range(256)])
_LETTER = np.array([bool(_WORD.fullmatch(chr(i))) for i in range(256)])
_BLANK = np.array([i in b" \n" for i in range(256)])

_encoders: dict[tuple[str, bool], Encoder] = {}
common.CACHES["tokens"] = _encoders.clear


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a tokenizer file; it lives as long as the worker."""
    if (e := _encoders.get(path)) is None:
        e = _encoders[path] = Encoder(path)
    return e


def slices(texts: list[str | None], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``size`` characters each."""
    begin = n = 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= size:
            yield begin, i + 1
            begin, n = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _byte_level() -> dict[int, str]:
    """How a byte-level vocabulary writes the letters of Latin-1 words."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {i: "".join(sign[b] for b in chr(i).encode()) for i in range(256)}


class Encoder:
    """Encodes texts to little-endian uint32 bytes.

    Where the tokenizer removes all white space before its model (as ``word_bpe_49k.json`` does), no token and
    no normalisation reaches over a blank, so a text's ids are those of its blank-separated chunks
    in turn. Chunks met before come from a dictionary; new ones go to the library, words to its model by themselves where that
    gives the same, others together, a special token between them. Any other tokenizer file gets whole texts.

    Latin-1 texts without special tokens are cut as bytes, in lower case and with the stops behind a word apart, which leaves
    the same ids in fewer different chunks. Their chunks are remembered as bytes, those of other texts as strings.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(True)
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark = next((i for i, t in sorted(added.items()) if not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        self.chunked = self.mark is not None and self._drops_blanks()
        self.specials = [t.content for t in added.values()]
        self.folds = self.chunked and self._folds()
        vocab = self.tokenizer.get_vocab(True)
        self.closes = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.closes[[i for t, i in vocab.items() if t.endswith(WORD_END) and t not in self.specials]] = True
        self.signs = _byte_level()
        self.direct = self.folds and self._by_model()
        self.known: dict[str | bytes, bytes] = {}

    def _drops_blanks(self) -> bool:
        probe = ["a b", " a  b\n", "'s 'll 12 ab\n'd", "é, ́x .  y", "\t<|x|> À z"]
        whole = [e.ids for e in self.tokenizer.encode_batch(probe, add_special_tokens=False)]
        parts = [[i for c in re.split("[ \n]+", p) if c for i in self.tokenizer.encode(c, add_special_tokens=False).ids] for p in probe]
        return whole == parts

    def _folds(self) -> bool:
        """Whether the tokenizer itself lowers case and sets a stop or comma after a letter apart."""
        marks = re.sub(r"[0-9A-Za-z]", "", "".join(map(chr, range(33, 127))))
        probe = "".join(map(chr, [*range(33, 127), *range(161, 256)]))
        pairs = [(probe, probe.lower()), ("Aé. bÀ, c.\nD,", "aé . bà , c . d ,"), (f"é{marks}", f"é {marks}"), *((f"é{m} s", f"é {m} s") for m in marks)]
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        return all(ids(p) == ids(q) for p, q in pairs)

    def _by_model(self) -> bool:
        """Whether the model alone gives a word's ids."""
        letters = [chr(i) for i in range(256) if _LETTER[i]]
        probe = ["the", "dog", "überfällig", "été", "niño", "tokenizers", "".join(letters), "a" * 300, *letters, *(f"a{c}" for c in letters), *(f"{c}ing" for c in letters)]
        model = self.tokenizer.model.tokenize
        return all([t.id for t in model(w.translate(self.signs))] == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)

    def _learn_latin(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        rest = chunks
        if self.direct:
            model, signs, rest = self.tokenizer.model.tokenize, self.signs, []
            ids, ends, words = [], [0], []
            for c in chunks:
                if _LATIN_WORD.fullmatch(c):
                    w = c.decode("latin-1")
                    ids += [t.id for t in model(w if c.isascii() else w.translate(signs))]
                    ends.append(4 * len(ids))
                    words.append(c)
                else:
                    rest.append(c)
            data = np.array(ids, dtype="<u4").tobytes()
            out.update((c, data[a:b]) for c, a, b in zip(words, ends, ends[1:], strict=False))
        found = self._learn([c.decode("latin-1") for c in rest])
        out.update((c.encode("latin-1"), x) for c, x in found.items())
        return out

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        words = [c for c in chunks if _WORD.fullmatch(c)]
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if ends.size != len(some):
                continue  # this tokenizer does not mark the ends of words: these go the general way
            ends, data = (4 * ends).tolist(), ids.tobytes()
            out.update((c, data[a:b]) for c, a, b in zip(some, [0, *ends], ends, strict=False))
        chunks = [c for c in chunks if c not in out]
        plain = [c for c in chunks if not any(s in c for s in self.specials)]
        own = set(plain)
        odd = [c for c in chunks if c not in own]
        sep = self.tokenizer.id_to_token(self.mark)
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([sep.join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(ids == self.mark)
            ends = [*cut.tolist(), ids.size]
            begins = [0, *(cut + 1).tolist()]
            data = ids.tobytes()
            out.update((c, data[4 * a : 4 * b]) for c, a, b in zip(some, begins, ends, strict=True))
        for c in odd:
            out[c] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out

    def _latin(self, text: str) -> bytes | None:
        """``text`` in Latin-1, if it may be cut as bytes."""
        if "<|" in text or any(s in text for s in self.specials):
            return None
        try:
            return text.encode("latin-1")
        except UnicodeEncodeError:
            return None

    def _remember(self, fresh: dict) -> None:
        if len(self.known) + len(fresh) > MOST:
            self.known.clear()
        self.known.update((c, ids) for c, ids in fresh.items() if len(c) <= LONGEST)

    def _encode_latin(self, texts: list[bytes]) -> list[bytes]:
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        data = np.frombuffer((b"\n".join(texts) + b"\n").translate(_LOWER), dtype=np.uint8)
        keep, punct = ~_BLANK[data], _PUNCT[data]
        first = np.r_[True, ~keep[:-1]] & keep
        # punctuation between a letter and a blank is split from the letter by the tokenizer either way
        edge = np.flatnonzero(punct[1:] != punct[:-1]) + 1
        if punct[0]:
            edge = edge[1:]
        begin, end = edge[::2], edge[1::2]  # the last byte is a blank
        first[begin[_LETTER[data[begin - 1]] & ~keep[end]]] = True
        at = np.cumsum(keep)
        offsets = np.r_[at[first] - 1, at[-1]].astype(np.int32)
        if offsets.size == 1:
            return [b""] * len(texts)
        chunks = pa.Array.from_buffers(pa.binary(), offsets.size - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])]).dictionary_encode()
        own, which = chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), chunks.indices.to_numpy()
        parts = list(map(self.known.get, own))
        fresh = self._learn_latin([c for c, x in zip(own, parts, strict=True) if x is None])
        if fresh:
            parts = [fresh[c] if x is None else x for c, x in zip(own, parts, strict=True)]
            self._remember(fresh)
        ids = np.frombuffer(b"".join(parts), dtype="<u4")
        n = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        shift, n = (np.cumsum(n) - n)[which], n[which]
        ends = np.r_[0, np.cumsum(n)]
        stream = ids[np.repeat(shift - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        # how many chunks begin before each text's end
        cuts = 4 * ends[np.searchsorted(offsets[:-1], at[np.cumsum(sizes) - 1])]
        cuts = [0, *cuts.tolist()]
        return [stream[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _encode_any(self, texts: list[str]) -> list[bytes]:
        known = self.known
        split = [t.replace("\n", " ").split(" ") for t in texts]
        every = set().union(*split)
        every.discard("")
        new = every.difference(known)
        fresh = self._learn(list(new))
        # looked up in these texts' own chunks: few enough for the processor's caches
        own = {c: known[c] for c in every - new} | fresh
        own[""] = b""
        self._remember(fresh)
        return [b"".join(map(own.__getitem__, chunks)) for chunks in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.chunked:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out: list[bytes] = [b""] * len(texts)
        for a, b in slices(texts):
            latin = [self._latin(t) if self.folds else None for t in texts[a:b]]
            for some, f in (([i for i, x in enumerate(latin) if x is not None], lambda i: self._encode_latin([latin[j] for j in i])), ([i for i, x in enumerate(latin) if x is None], lambda i: self._encode_any([texts[a + j] for j in i]))):
                if some:
                    for i, ids in zip(some, f(some), strict=True):
                        out[a + i] = ids
        return out
