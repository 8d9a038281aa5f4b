"""Token ids of whole texts by a public vocabulary file, for tasks on executors.

The default vocabulary lower-cases, drops white space and never joins characters across it,
so a text's ids are those of its blank-parted chunks in order. Chunks repeat far more than
texts do: each Python worker keeps a table of chunks already encoded. The table is emptied
when full, which changes speed only. Any other vocabulary is used as it is unless
``by_chunk=True`` says that this holds of it too.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator

#: Chunks that a worker's table may hold, and the longest that it keeps.
TABLE, LONGEST = 1_000_000, 48
#: Lower-case letters that are one code point in every normal form.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the UTF-8 bytes of the letters in ``_PLAIN``.

    Bytes that print as themselves stay; the others, in order, become the code points
    from 256 on."""
    stays = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in stays)}
    return {c: "".join(chr(moved.get(b, b)) for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class Encoder:
    """Ids of texts as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, by_chunk: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_chunk = by_chunk
        self.known: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.marks = {c: self.plain(c) for c in (".", ",")}

    def plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, c: str) -> bytes:
        if c[-1:] in (".", ",") and _PLAIN.fullmatch(c[:-1]):  # the mark is a piece of its own
            return self._chunk(c[:-1]) + self.marks[c[-1]]
        if _PLAIN.fullmatch(c):  # one run of letters: only the merges are left to do
            ids = [x.id for x in self.model.tokenize(c if c.isascii() else c.translate(self.letters))]
            return struct.pack(f"<{len(ids)}I", *ids)
        return self.plain(c)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            if not self.by_chunk or "<|" in t:  # might hold the name of a special token
                yield self.plain(t)
                continue
            chunks = t.encode("utf-8", "replace").lower().decode().replace("\n", " ").split(" ")
            known = self.known
            try:
                yield b"".join(map(known.__getitem__, chunks))
                continue
            except KeyError:
                pass
            if len(known) > TABLE:
                known.clear()
            long = []
            for c in chunks:
                if c not in known:
                    known[c] = self._chunk(c)
                    if len(c) > LONGEST:
                        long.append(c)
            yield b"".join(map(known.__getitem__, chunks))
            for c in long:
                known.pop(c, None)


@functools.lru_cache(maxsize=2)
def encoder(path: str, by_chunk: bool = True) -> Encoder:
    """One encoder for each Python worker; its table serves the tasks to come."""
    return Encoder(path, by_chunk)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
