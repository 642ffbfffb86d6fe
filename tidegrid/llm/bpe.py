"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

The encoder never replays merges. It takes the longest token at each place, as found by
an Aho-Corasick automaton, and keeps it if the pair with the token before is compatible:
no merge that BPE would have made earlier crosses their border. Otherwise it tries the
next shorter token, and steps back where none is left. Compatible neighbours everywhere
mean exactly the merge order's result, and no place is tried twice.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import hashing
from tidegrid.llm.common import schema_with

# Word pattern of the vocabulary's pre-tokenizer, end-of-word mark.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
SPLIT = re.compile(r"[\x20\x09-\x0D]+").split
# Words remembered by one Python worker; beyond it the memory starts anew.
REMEMBERED = 250_000


def byte_signs() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in plain}
    spare = (b for b in range(256) if b not in signs)
    signs.update({b: chr(256 + i) for i, b in enumerate(spare)})
    return [signs[b] for b in range(256)]


class Bpe:
    """Tables of one vocabulary. Inside, a word is a string of byte values, its last raised by 256."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        values = {sign: b for b, sign in enumerate(byte_signs())}

        def inner(token: str) -> str:
            body, last = (token[: -len(END)], 256) if token.endswith(END) else (token, 0)
            codes = [values[c] for c in body]
            codes[-1] += last
            return "".join(map(chr, codes))

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {inner(t): i for t, i in vocab.items()}
        self.length = {i: len(t) for t, i in self.ids.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        # rank[i]: when BPE makes token i; single bytes come before all merges.
        self.joined = {(vocab[a], vocab[b]): vocab[a + b] for a, b in pairs}
        self.rank = {i: -1 for i in vocab.values()}
        self.parts = {i: (i, i) for i in vocab.values()}
        for rank, (a, b) in enumerate(pairs):
            self.rank[vocab[a + b]] = rank
            self.parts[vocab[a + b]] = (vocab[a], vocab[b])
        # shorter[i]: the longest other token that begins token i.
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.shorter = {}
        for token, i in self.ids.items():
            cut = len(token) - 1
            while cut and token[:cut] not in self.ids:
                cut -= 1
            self.shorter[i] = self.ids[token[:cut]] if cut else None
        # The offset table: token i is written in store[offset[i]:offset[i + 1]].
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.offsets, parts, at = [0], [], 0
        for i in range(max(names) + 1):
            parts.append(names.get(i, ""))
            at += len(parts[-1])
            self.offsets.append(at)
        self.store = "".join(parts)
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words = regex.compile(WORDS)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between neighbours ``a`` and ``b`` alone.

        The border would close by a merge of a piece that ends ``a`` with a piece that
        begins ``b``. Going back in merge order, the pieces at the border are those that
        exist together; a merge of theirs counts only if its turn came before one of
        them was merged further.
        """
        key, until, answer = (a, b), 1 << 60, True
        left, right = a, b
        while True:
            merged = self.joined.get((left, right))
            if merged is not None and self.rank[merged] < until:
                answer = False
                break
            turn_left, turn_right = self.rank[left], self.rank[right]
            if turn_left < 0 and turn_right < 0:
                break
            if turn_left > turn_right:
                # The left piece was made last: before that turn its right part was there.
                # Merges at one's turn happen left to right, so the left piece wins a tie.
                until, left = turn_left, self.parts[left][1]
            else:
                until, right = turn_right + 1, self.parts[right][0]
        if len(self.fits) > 500_000:
            self.fits.clear()
        self.fits[key] = answer
        return answer

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        if not word.isascii():
            word = word.encode("utf-8").decode("latin-1")
        text = word[:-1] + chr(ord(word[-1]) + 256)
        whole = self.ids.get(text)
        if whole is not None:
            return (whole,)
        length, fits, shorter = self.length, self.fits, self.shorter
        longest: list[int | None] = [None] * len(text)
        # Matches come by their ends, so the last one kept for a beginning is the longest.
        for end, i in self.automaton.iter(text):
            longest[end - length[i] + 1] = i
        open_ = [True] * (len(text) + 1)
        taken: list[int] = []
        at, token = 0, longest[0]
        while at < len(text):
            while token is not None:
                end = at + length[token]
                if open_[end]:
                    if not taken:
                        break
                    fit = fits.get((taken[-1], token))
                    if fit if fit is not None else self.compatible(taken[-1], token):
                        break
                token = shorter[token]
            if token is not None:
                taken.append(token)
                at = end
                token = longest[at] if at < len(text) else None
            else:
                open_[at] = False  # nothing leads on from here
                token = taken.pop()
                at -= length[token]
        return tuple(taken)

    def encode(self, text: str) -> list[int]:
        """Token ids of a text; the strings of special tokens in it are special tokens."""
        ids: list[int] = []
        marked = any(mark in text for mark in self.special)
        for piece in self.split.split(text) if marked else [text]:
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                for word in self.words.findall(normal(piece)):
                    found = self.known.get(word)
                    if found is None:
                        if len(self.known) >= REMEMBERED:
                            self.known.clear()
                        found = self.known[word] = self.encode_word(word)
                    ids.extend(found)
        return ids

    def written(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids in decimal and decoded text, each joined by one space.

        No token crosses white space, so what a chunk between white space gives is
        remembered as a whole.
        """
        n, ids, back = 0, [], []
        chunks = self.chunks
        for chunk in SPLIT(text):
            found = chunks.get(chunk)
            if found is None:
                if len(chunks) >= REMEMBERED:
                    chunks.clear()
                own = self.encode(chunk)
                found = chunks[chunk] = (len(own), " ".join(map(str, own)), self.decode(own))
            if found[0]:
                n += found[0]
                ids.append(found[1])
                back.append(found[2])
        return n, " ".join(ids), " ".join(back)

    def decode(self, ids: list[int]) -> str:
        """Tokens as written, joined by one space: this vocabulary has no decoder of its own."""
        offsets, store = self.offsets, self.store
        return " ".join([store[offsets[i] : offsets[i + 1]] for i in ids])


def normal(text: str) -> str:
    """Composed characters, then lower case of each character by itself."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


_LOADED: dict[int, Bpe] = {}


def loaded(spec: str) -> Bpe:
    """The vocabulary's tables, built once per Python worker."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(spec)
    return _LOADED[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


ADDED = "n_tokens long, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string"


def encode_decode(
    docs: DataFrame,
    path: str,
    *,
    text_col: str = "text",
    keep: list[str] | None = None,
    results: tuple[str, ...] = ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"),
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all but the text) with the wanted ``results``.

    ``path`` is a vocabulary file on the driver; its text (under 2 MB) travels with the tasks.
    A null text is an empty one: no tokens, an empty decoded text. Each row is encoded by
    itself, so repeated rows give repeated results and an empty table an empty one. A kept
    column that is named like a result is dropped in favour of the result.
    """
    spec = read_spec(path)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results]
    if keep is None:
        kept = [c for c in kept if c != text_col]
    types = dict(part.strip().split(" ") for part in ADDED.split(","))
    added = ", ".join(f"{c} {types[c]}" for c in results)
    schema = schema_with(docs, kept, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec)
        for batch in batches:
            for piece in hashing.slices(batch, len(kept), 1_000_000):
                yield encoded(bpe, piece)

    def encoded(bpe: Bpe, piece: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in results}
        for text in piece.column(len(kept)):
            n, line, back = bpe.written(text.as_py() or "")
            for name in results:
                out[name].append(
                    n if name == "n_tokens"
                    else np.array(line.split(), np.int32) if name == "ids"
                    else back if name == "decoded"
                    else digest(line if name == "ids_sha256" else back)
                )
        columns = [piece.column(i) for i in range(len(kept))]
        for name in results:
            if name == "ids":
                bounds = np.cumsum([0, *map(len, out[name])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int32), *out[name]])
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)))
            else:
                columns.append(pa.array(out[name], pa.int64() if name == "n_tokens" else pa.string()))
        return pa.RecordBatch.from_arrays(columns, [*kept, *results])

    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("_bpe_text"))
    return given.mapInArrow(run, schema)
