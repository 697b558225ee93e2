"""Token ids of a word-based BPE vocabulary, with a bounded cache of words.

White space separates words and is dropped by this vocabulary, so the ids of a text are those of its words in order.
Words of ASCII and Latin-1 letters, digits and signs are merged by ``tiktoken`` with the same ranks (an end of word is
a byte that UTF-8 never uses); any other word, and any text with a special token's opening, goes to ``tokenizers``.
Both give the same ids; tests compare them.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

END = b"\xff"
LETTER = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])"
PIECES = re.compile(LETTER + rb"+|[0-9]|[!-&(-/:-@\[-`{-~]+").findall
PLAIN = re.compile(rb"(?:[a-z0-9!-&(-/:-@\[-`{-~]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
CACHED_WORDS = 200_000


class WordIds(dict):
    """Word (UTF-8) to its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, special_as_text: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        byte_of = _byte_of_symbol()
        ranks = {}
        for token, number in self.whole.get_vocab(with_added_tokens=False).items():
            word = token.endswith("</w>") and len(token) > 4
            letters = token[:-4] if word else token
            if all(c in byte_of for c in letters):
                ranks[bytes(byte_of[c] for c in letters) + (END if word else b"")] = number
        ranks[END] = max(ranks.values()) + 1_000_000
        self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks,
                                       special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        low = word.decode().lower().encode()
        if PLAIN(low) and b"<|" not in low:
            ids = [i for part in PIECES(low) for i in self.piece(part + END)]
        else:
            ids = self.whole.encode(word.decode(), add_special_tokens=False).ids
        self[word] = found = array("I", ids).tobytes()
        return found

    def of(self, text: bytes) -> bytes:
        """Ids of a text, four bytes each."""
        if b"<|" in text:  # a special token may span what looks like words
            return array("I", self.whole.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        if len(self) > CACHED_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself if it prints, else as the next free character from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def word_ids(path: str, special_as_text: bool = False) -> WordIds:
    """One cache per Python worker."""
    return WordIds(path, special_as_text)
