"""Token ids of many texts from a tokenizer file.

A byte-level BPE file splits text at its pattern first, and no piece of that pattern crosses a blank before a visible
character, save to take that one blank along. So a text is cut there into pre-tokens ("The", " cat", " sat.\\n"), and the ids of a
text are the ids of its pre-tokens in order. Pre-tokens repeat far more than texts do: each worker keeps what it has encoded.
Missing ones are encoded together, as one text, whose token bytes show where each begins.

Ids are looked up for all pre-tokens of a batch at once: their 64-bit hashes index a direct-mapped table of places in a pool of
ids, and the batch's ids are gathered from there. A hit counts only if its bytes are those of the pre-token: up to ``EXACT`` bytes
hash and length determine them, longer ones are compared.

Texts that hold a special string, and files of other kinds, go through their own library whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np

from costproof.llm.bytehash import EXACT, batches, between_blanks, mix, same, windows

# The pattern of byte-level BPE files (before merges).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens that a worker keeps beside the frequent ones, and their characters together; the longest a shared table holds.
KEPT, CHARACTERS, LONGEST = 500_000, 16_000_000, 64
#: Bits of the direct-mapped table, and ids in its pool before both start afresh.
SLOT_BITS, POOL = 21, 1 << 24
_DOUBLE = re.compile(r" \s")
_CUT = re.compile(r" (?=\S)")


def cut(text: str) -> list[str]:
    """Pre-tokens of a text; each but the first begins with a blank that is left out here."""
    return _CUT.split(text) if _DOUBLE.search(text) else text.split(" ")


class Encoder:
    """Ids of texts by a tokenizer file; ``frequent`` holds pre-tokens (as ``cut`` gives them after a blank) with their lengths."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        self.path, self.frequent = path, frequent or {}
        self.known: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.pieces = self.whole = None
        self.characters = 0
        if path.endswith(".model"):
            import sentencepiece

            self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = self.whole.get_piece_size()
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.size = self.library.get_vocab_size(with_added_tokens=True)
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.special = [t["content"] for t in spec["added_tokens"]]
            if _plain_bytes(spec):
                self._pieces_of(spec)
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32

    def _pieces_of(self, spec: dict) -> None:
        import tiktoken

        table = _byte_table()
        ranks = {bytes(table[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.pieces = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in ranks.items():
            self.bytes_of[i] = len(token)

    def _library(self, texts: list[str]) -> list[list[int]]:
        if self.whole is not None:
            return self.whole.encode(texts, num_threads=1)
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, found: Iterable[str], keep: dict[str, int], led: bool) -> None:
        """Numbers of tokens of pre-tokens, all led by a blank or none, into ``keep``."""
        found = list(found)
        self.characters += sum(map(len, found))
        together = [c for c in found if led and c and not c[0].isspace()]
        alone = found if len(together) < 2 else [c for c in found if not c or c[0].isspace()]
        if len(together) > 1:
            joined = " " + " ".join(together)
            ends = np.flatnonzero(np.frombuffer(joined.encode() + b" ", np.uint8) == 0x20)[1:]
            if len(ends) != len(together):  # some hold blanks themselves
                ends = np.cumsum(np.fromiter((len(c.encode()) + 1 for c in together), np.int64, len(together)))
            ids = np.asarray(self.pieces.encode_ordinary(joined), np.int64)
            reached = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(reached, ends)
            if not np.array_equal(reached[last], ends):
                alone = found
            else:
                keep.update(zip(together, np.diff(np.concatenate(([0], last + 1))).tolist(), strict=True))
        for c in alone:
            keep[c] = len(self.pieces.encode_ordinary(" " + c if led else c))

    def _cut_all(self, texts: list[str]) -> list[tuple[str, list[str]] | None]:
        if len(self.known) + len(self.first) > KEPT or self.characters > CHARACTERS:
            self.known.clear(), self.first.clear()
            self.characters = 0
        parts, firsts, rest = [], set(), set()
        for text in texts:
            if any(s in text for s in self.special):
                parts.append(None)
                continue
            part = cut(text)
            first = part.pop(0)
            firsts.add(first)
            rest.update(part)
            parts.append((first, part))
        self.learn(firsts - self.first.keys(), self.first, False)
        self.learn(rest - self.known.keys() - self.frequent.keys(), self.known, True)
        return parts

    def lengths(self, texts: list[str]) -> list[int]:
        """Numbers of tokens."""
        if self.pieces is None:
            return [len(ids) for ids in self._library(texts)]
        out = []
        for a, b in batches(texts):
            parts = self._cut_all(texts[a:b])
            first, known, frequent = self.first, self.known, self.frequent
            for text, part in zip(texts[a:b], parts, strict=True):
                if part is None:
                    out.append(len(self._library([text])[0]))
                elif frequent:
                    out.append(first[part[0]] + sum([frequent[c] if c in frequent else known[c] for c in part[1]]))
                else:
                    out.append(first[part[0]] + sum(map(known.__getitem__, part[1])))
        return out

    def _fresh(self) -> None:
        self.slot_hash = np.zeros(1 << SLOT_BITS, np.uint64)
        self.slot_at = np.zeros(1 << SLOT_BITS, np.int64)
        self.slot_n = np.zeros(1 << SLOT_BITS, np.int32)
        self.slot_led = np.zeros(1 << SLOT_BITS, bool)
        self.slot_byte = np.zeros(1 << SLOT_BITS, np.int64)
        self.slot_bytes = np.zeros(1 << SLOT_BITS, np.int64)
        self.pool, self.used = np.zeros(1 << 20, self.dtype), 0
        self.raw, self.raw_used = np.zeros(1 << 20, np.uint8), 0

    def _pooled(self, ids: np.ndarray) -> int:
        """Where ``ids`` begin in the pool."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(ids)), self.dtype)))
        self.pool[at : self.used] = ids
        return at

    def _stored(self, found: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Where the bytes of pre-tokens begin in their pool, which ends in padding."""
        at = self.raw_used + np.cumsum(lengths) - lengths
        end = self.raw_used + int(lengths.sum())
        if end + 8 > len(self.raw):
            self.raw = np.concatenate((self.raw, np.zeros(max(len(self.raw), end + 8 - len(self.raw)), np.uint8)))
        self.raw[self.raw_used : end] = np.frombuffer(b"".join(found), np.uint8)
        self.raw_used = end
        return at

    def _encode_led(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places in the pool, lengths) of pre-tokens that follow a blank."""
        joined = b" " + b" ".join(found)
        ids = np.asarray(self.pieces.encode_ordinary(joined.decode()), np.int64)
        ends = np.cumsum(np.fromiter((len(c) + 1 for c in found), np.int64, len(found)))
        last = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends)
        if not np.array_equal(np.cumsum(self.bytes_of[ids])[last], ends):
            each = [self.pieces.encode_ordinary(" " + c.decode()) for c in found]
            n = np.array([len(x) for x in each], np.int64)
            return self._pooled(np.array([i for x in each for i in x], np.int64)) + np.cumsum(n) - n, n
        begin = np.concatenate(([0], last[:-1] + 1))
        return self._pooled(ids) + begin, last + 1 - begin

    def _encode_at(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, led: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(places in the pool, lengths, bytes) of the pre-tokens at places of a buffer."""
        found = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        at, n = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        if led.any():
            at[led], n[led] = self._encode_led([c for c, follows in zip(found, led.tolist(), strict=True) if follows])
        for k in np.flatnonzero(~led).tolist():
            ids = np.asarray(self.pieces.encode_ordinary(found[k].decode()), np.int64)
            at[k], n[k] = self._pooled(ids), len(ids)
        return at, n, found

    def _gathered(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts whose blanks all stand between visible characters."""
        if not hasattr(self, "pool") or max(self.used, self.raw_used) > POOL:
            self._fresh()
        hashes, starts, ends, first, buffer = between_blanks(texts)
        view, length = windows(buffer), ends - starts
        led = np.ones(len(hashes), bool)
        led[first[:-1]] = False  # a text's first pre-token follows no blank
        hashes[~led] = mix(hashes[~led], 31)
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, n = self.slot_at[slot], self.slot_n[slot].astype(np.int64)
        hit = np.flatnonzero((self.slot_hash[slot] == hashes) & (n > 0) & (self.slot_led[slot] == led) & (self.slot_bytes[slot] == length))
        known = np.zeros(len(hashes), bool)
        known[hit[length[hit] <= EXACT]] = True
        hit = hit[length[hit] > EXACT]
        known[hit[same(view, starts[hit], windows(self.raw), self.slot_byte[slot[hit]], length[hit])]] = True
        miss = np.flatnonzero(~known)
        if len(miss):
            raw = buffer.tobytes()
            new, where, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            where = miss[where]
            new_at, new_n, found = self._encode_at(raw, starts[where], ends[where], led[where])
            at[miss], n[miss] = new_at[back], new_n[back]
            model = where[back]  # the pre-token whose ids were taken for the hash
            alike = (length[model] == length[miss]) & (led[model] == led[miss])
            check = np.flatnonzero(alike & (length[miss] > EXACT))
            alike[check] = same(view, starts[miss[check]], view, starts[model[check]], length[miss[check]])
            odd = miss[~alike]
            if len(odd):
                at[odd], n[odd], _ = self._encode_at(raw, starts[odd], ends[odd], led[odd])
            place = slot[where]
            self.slot_hash[place], self.slot_at[place], self.slot_n[place], self.slot_led[place] = new, new_at, new_n, led[where]
            self.slot_byte[place], self.slot_bytes[place] = self._stored(found, length[where]), length[where]
        upto = np.cumsum(n)
        out = self.pool[np.repeat(at - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        cuts = np.concatenate(([0], upto))[first].tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids as arrays of ``dtype``."""
        if self.pieces is None:
            return [np.asarray(ids, self.dtype) for ids in self._library(texts)]
        out: list[np.ndarray | None] = [None] * len(texts)
        even, raw = [], []
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = np.asarray(self._library([text])[0], self.dtype)
            elif not text or text[0] == " " or text[-1] == " " or _DOUBLE.search(text):
                out[i] = np.asarray(self.pieces.encode_ordinary(text), self.dtype)
            else:
                even.append(i)
                raw.append(text.encode())
        for a, b in batches(raw, 1 << 21):
            for i, ids in zip(even[a:b], self._gathered(raw[a:b]), strict=True):
                out[i] = ids
        return out


def _plain_bytes(spec: dict) -> bool:
    """Whether a file splits by PATTERN alone and merges bytes alone."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (
        spec.get("normalizer") is None and spec.get("post_processor") is None and spec.get("truncation") is None and spec.get("padding") is None
        and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        and model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and len(model["vocab"]) > 256
    )


def _byte_table() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, use: str = "ids") -> Encoder:
    """This worker's encoder for a file and use; its pre-tokens outlive a task."""
    if (path, use) not in _ENCODERS:
        _ENCODERS[path, use] = Encoder(path)
    return _ENCODERS[path, use]
