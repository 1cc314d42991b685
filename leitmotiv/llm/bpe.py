"""BPE encoding and decoding by dynamic programming over prefixes.

For a word's every prefix, BPE has exactly one last token: of the vocabulary's matches that end there (an Aho-Corasick
automaton yields them, the longest first), the one that is compatible with the last token of the prefix before it. Two tokens
are compatible if no merge across their border would have come before the merges that made them. Following the stored
tokens back from the word's end gives the ids, without running any merge.

A word's last symbol carries the vocabulary's word end. It is a symbol of its own in the automaton, so that tokens with a word end
match at a word's end only.

Splitting into words follows the tokenizer file: NFC, lower case by character, words by its pattern, bytes as
characters. White space never joins two words, so a text is cut at ASCII white space first, and each piece between is
encoded once and kept in a bounded memo.

One pass in Arrow batches, no shuffle. The vocabulary goes to the executors as a broadcast of the file's size, which is
checked (MAX_VOCABULARY_BYTES).

Defined results: null and empty texts have no ids. Special tokens in a text become their ids. Repeated rows each get their own
row. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leitmotiv.llm.common import kept, map_arrow, utf8

MAX_VOCABULARY_BYTES = 64 << 20
#: Entries of a generation of a worker's memos, of which each has two, and of the memo of pairs before it starts anew (some 150 MB in all, as
#: two workers and a full heap share an executor's memory); it bounds memory and changes no result.
MEMO = 100_000


class Memo:
    """Of the last entries asked for, the last `most` for certain and twice as many at most."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        if (out := self.new.get(key)) is None and (out := self.old.get(key)) is not None:
            self.put(key, out)
        return out

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it's printable Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class WordBPE:
    """spec: the parsed tokenizer file."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE vocabulary over bytes is needed")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.bytes = byte_characters()
        self.table = {i: c for i, c in self.bytes.items()}
        # Symbols: a character for each byte, and one in the private area for each byte at a word's end.
        self.last = {c: chr(0xE000 + b) for b, c in self.bytes.items()}
        self.token: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        for r, (a, b) in enumerate(merges):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((x, y), r)
            if z not in self.made:
                self.made[z] = (r, x, y)
        for r, x, y in self.made.values():
            if max(self.made.get(x, (-1,))[0], self.made.get(y, (-1,))[0]) >= r:
                raise ValueError("a merge comes before the merges of its parts")
        single = {self.vocab[c] for c in self.bytes.values() if c in self.vocab} | {self.vocab[c + self.end] for c in self.bytes.values() if c + self.end in self.vocab}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            if i in single or i in self.made:
                s = self._symbols(t)
                self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.left: dict[int, tuple] = {}
        self.right: dict[int, tuple] = {}
        self.pairs: dict[int, bool] = {}
        self.shown = {str(i): t for i, t in self.token.items()}
        # Ids joined by a space, the only form that is kept of a word or piece.
        self.words = Memo(MEMO)
        self.pieces = Memo(MEMO)

    def _symbols(self, token: str) -> str:
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return body[:-1] + self.last[body[-1]]
        return token

    def _spine(self, token: int, side: int) -> tuple[tuple[int, int | float], ...]:
        """The token and its parts at its left (side 1) or right (side 2) edge, each with the rank that uses it up."""
        memo = self.left if side == 1 else self.right
        if (out := memo.get(token)) is None:
            spine, used, t = [], float("inf"), token
            while True:
                spine.append((t, used))
                if t not in self.made:
                    break
                used, t = self.made[t][0], self.made[t][side]
            out = memo[token] = tuple(spine)
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of a's and b's symbols, one after the other, is the two tokens a and b."""
        if (out := self.pairs.get(a << 32 | b)) is None:
            rank = self.rank
            out = not any(
                (r := rank.get((x, y))) is not None and r < used_x and r <= used_y
                for x, used_x in self._spine(a, 2)
                for y, used_y in self._spine(b, 1)
            )
            if len(self.pairs) > 4 * MEMO:
                self.pairs.clear()
            self.pairs[a << 32 | b] = out
        return out

    def encode_word(self, word: str) -> str:
        """The ids, joined by a space, of one word as the splitting pattern yields it."""
        if (out := self.words.get(word)) is not None:
            return out
        table = self.table
        s = "".join([table[b] for b in word.encode()])
        if self.end:
            s = s[:-1] + self.last[s[-1]]
        token: list[int | None] = [None] * (len(s) + 1)
        back = [0] * (len(s) + 1)
        done = 0
        compatible = self.compatible
        known = self.pairs.get
        for stop, (n, t) in self.automaton.iter(s):
            stop += 1
            if stop == done:
                continue  # the prefix has its token
            start = stop - n
            if start:
                before = token[start]
                if before is None:
                    continue
                fits = known(before << 32 | t)
                if fits is None:
                    fits = compatible(before, t)
                if not fits:
                    continue
            token[stop], back[stop], done = t, start, stop
        ids, at = [], len(s)
        while at:
            ids.append(token[at])
            at = back[at]
        out = " ".join(map(str, reversed(ids)))
        self.words.put(word, out)
        return out

    def encode_piece(self, piece: bytes) -> str:
        """Of text without ASCII white space: ids joined by a space."""
        if (out := self.pieces.get(piece)) is not None:
            return out
        ids: list[str] = []
        text = piece.decode()
        parts = [(text, False)] if self.special_pattern is None or "<|" not in text else self._special_parts(text)
        for part, special in parts:
            if special:
                ids.append(str(self.specials[part]))
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            for word in (part,) if part.isalpha() else self.pattern.findall(part):
                ids.append(self.encode_word(word))
        out = " ".join(ids)
        if len(piece) <= 64:
            self.pieces.put(piece, out)
        return out

    def _special_parts(self, text: str) -> list[tuple[str, bool]]:
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def encode(self, text: bytes) -> tuple[str, int, str]:
        """Ids joined by a space, how many, and the decoded text."""
        known, encode = self.pieces.new.get, self.encode_piece
        ids = " ".join(filter(None, [known(p) or encode(p) for p in text.split()]))
        each = ids.split(" ") if ids else []
        return ids, len(each), " ".join([self.shown[i] for i in each])

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the file names no decoder; special tokens stay."""
        return " ".join(self.token[i] for i in ids if i in self.token)


def load(spec: str) -> WordBPE:
    """A worker's own tokenizer for the text of a tokenizer file."""
    return kept("bpe", hashlib.sha256(spec.encode()).hexdigest(), lambda: WordBPE(json.loads(spec)))


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids (array<int>) and decoded.

    vocabulary: the path of a tokenizer file on the driver.
    """
    if os.path.getsize(vocabulary) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has more than {MAX_VOCABULARY_BYTES} bytes")
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    held: list[WordBPE] = []

    def batch(b: pa.RecordBatch) -> dict:
        if not held:
            held.append(load(spec.value))
        bpe, out = held[0], {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        more = {"ids": [], "decoded": []} if with_ids else {}
        for text in utf8(b.column(1)):
            ids, n, decoded = bpe.encode(text)
            out["n_tokens"].append(n)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if with_ids:
                more["ids"].append([int(x) for x in ids.split()])
                more["decoded"].append(decoded)
        if with_ids:
            more["ids"] = pa.array(more["ids"], pa.list_(pa.int32()))
        return {"id": b.column(0)} | out | more

    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", ids array<int>, decoded string" if with_ids else ""
    out = map_arrow(docs.select(id_col, text_col), batch, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}", "bpe")
    return out.withColumnRenamed("id", id_col)
