"""BPE encoding by backtracking, decoding by an offset table.

Text is split into words as the tokenizer file says.  Within a word the encoder
goes left to right: an Aho-Corasick automaton gives the longest token that starts
at each position; a token may follow another only if the pair is compatible, that
is, if merging their joined symbols in rank order leaves the border between them.
Where nothing compatible follows, it takes the last token back and tries its next
shorter prefix; positions found dead are never tried twice, so the work is linear
in the word.  The result is that of the merge procedure.

Nulls count as empty texts, and an empty text has no tokens.  Very long texts and
words are encoded whole.  Rows that repeat are encoded each, ids may be of any type,
and an empty table gives no rows.  A column that bears the name of a result is
replaced; other columns are carried along.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.common import map_arrow, sliced

#: Fixed value: marks the last symbol of a word in the vocabulary.
WORD_END = "</w>"
#: Word results kept by a Python worker; all are dropped when so many are there; so with pairs.
CACHED_WORDS, CACHED_PAIRS = 200_000, 300_000
_FINAL = 0x2000
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


# Fixed value: the normalizer of a tokenizer file that ``split_words`` carries out.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


class WordBpe:
    """Encoder and decoder for a word-level BPE file of the ``tokenizers`` format."""

    _loaded: dict[str, "WordBpe"] = {}

    @classmethod
    def load(cls, path: str) -> "WordBpe":
        if path not in cls._loaded:
            with open(path, encoding="utf-8") as f:
                cls._loaded[path] = cls(json.load(f), path)
        return cls._loaded[path]

    def __init__(self, spec: dict, path: str | None = None):
        model = spec["model"]
        if spec.get("normalizer") != NORMALIZER:
            raise ValueError("texts are normalized by NFC, white space as blanks and lower case; the tokenizer file asks for another normalizer")
        self.path = path
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern_text = split["pattern"]["Regex"]
        self.pattern = regex.compile(self.pattern_text)
        self.to_symbols = dict(enumerate(byte_symbols()))
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        n = max(*self.vocab.values(), *self.special.values(), 0) + 1
        names = [""] * n
        for token, i in chain(self.vocab.items(), self.special.items()):
            names[i] = token
        self.names = names
        blob = [f" {x}".encode() for x in names]
        self.offsets = np.zeros(n + 1, np.int64)
        np.cumsum([len(b) for b in blob], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(blob), np.uint8)

        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (left, right) in enumerate(model["merges"]):
            a, b, c = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.rank.setdefault((a, b), r)
            self.parts.setdefault(c, (a, b, r))
        self.right_spine: dict[int, tuple[tuple[int, int], ...]] = {}
        self.left_spine: dict[int, tuple[tuple[int, int], ...]] = {}
        self.symbols: dict[str, int] = {}
        sound: set[int] = set()
        for token, i in sorted(self.vocab.items(), key=lambda x: self.parts.get(x[1], (0, 0, -1))[2]):
            if self._sound(i, sound):
                sound.add(i)
                self.symbols[self._of_symbols(token)] = i
        self.automaton = ahocorasick.Automaton()
        for s, i in self.symbols.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.length = {i: len(s) for s, i in self.symbols.items()}
        self.by_id = {i: s for s, i in self.symbols.items()}
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)

    @staticmethod
    def _of_symbols(token: str) -> str:
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            body = token[: -len(WORD_END)]
            return body[:-1] + chr(_FINAL + ord(body[-1]))
        return token

    def _spines(self, i: int) -> None:
        """What the last and the first symbol of token i belong to while it is built, innermost last; with the rank that ends each."""
        for spine, side in ((self.right_spine, 1), (self.left_spine, 0)):
            out, at, until = [], i, _NEVER
            while True:
                out.append((at, until))
                if at not in self.parts:
                    break
                until = self.parts[at][2]
                at = self.parts[at][side]
            spine[i] = tuple(out)

    def _crossed(self, a: int, b: int, but: tuple[int, int] | None = None) -> bool:
        rank = self.rank
        for x, x_until in self.right_spine[a]:
            for y, y_until in self.left_spine[b]:
                r = rank.get((x, y))
                if r is not None and r < x_until and r <= y_until and (x, y) != but:
                    return True
        return False

    def _sound(self, i: int, sound: set[int]) -> bool:
        """Whether merging the symbols of token i gives token i itself."""
        self._spines(i)
        if i not in self.parts:
            return True
        a, b, r = self.parts[i]
        if a not in sound or b not in sound:
            return False
        rank = self.rank
        for x, x_until in self.right_spine[a]:
            for y, y_until in self.left_spine[b]:
                q = rank.get((x, y))
                if q is not None and (x, y) != (a, b) and q < x_until and q <= y_until and q < r:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Table entry for (a, b), computed when first asked for."""
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) >= CACHED_PAIRS:
                self.fits.clear()
            got = self.fits[a, b] = not self._crossed(a, b)
        return got

    def _shorter(self, i: int) -> int:
        """The next shorter token that starts as token i does, or -1."""
        got = self.shorter.get(i)
        if got is None:
            s = self.by_id[i]
            got = next((self.symbols[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.symbols), -1)
            self.shorter[i] = got
        return got

    def encode_symbols(self, s: str) -> list[int]:
        n = len(s)
        if not n:
            return []
        longest, reach = [-1] * n, [0] * n
        for end, (i, k) in self.automaton.iter(s):
            start = end - k + 1
            if k > reach[start]:
                reach[start], longest[start] = k, i
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token, length = 0, longest[0], self.length
        while True:
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self._shorter(token)
            if token >= 0:
                out.append(token)
                at += length[token]
                if at == n:
                    return out
                token = longest[at]
            else:
                dead[at] = 1
                if not out:
                    raise ValueError(f"no encoding for {s!r}")
                token = out.pop()
                at -= length[token]
                token = self._shorter(token)

    def encode_word(self, word: str) -> tuple[int, ...]:
        plain = word.isascii() and word.isprintable()
        s = word if plain else word.encode("utf-8", "replace").decode("latin-1").translate(self.to_symbols)
        s = s[:-1] + chr(_FINAL + ord(s[-1]))
        whole = self.symbols.get(s)
        return (whole,) if whole is not None else tuple(self.encode_symbols(s))

    def split_words(self, text: str) -> list[str]:
        if text.isascii() or max(text) < "԰":
            return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        # Other scripts: character classes by the tokenizer library's own Unicode version.
        from tokenizers import Regex, normalizers, pre_tokenizers

        if not hasattr(self, "_exact"):
            self._exact = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(self.pattern_text), "removed", invert=True)
        normal, split = self._exact
        return [w for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.special_split is None or "<|" not in text and not self.special_split.search(text):
            return list(chain.from_iterable(map(self.words.__getitem__, self.split_words(text))))
        out: list[int] = []
        for piece in self.special_split.split(text):
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out += chain.from_iterable(map(self.words.__getitem__, self.split_words(piece)))
        return out

    def decode_flat(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all ids, a space before each, and where each id's bytes end."""
        first, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)
        return self.blob[where].tobytes(), ends

    def decode(self, ids: Sequence[int]) -> str:
        return self.decode_flat(np.asarray(ids, np.int64))[0][1:].decode("utf-8")


class _Words(dict):
    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        got = self[word] = self.bpe.encode_word(word)
        return got


def _replaced(docs: DataFrame, **added: str) -> tuple[DataFrame, str]:
    """The rows without the columns to be added, and the schema with them."""
    kept = docs.drop(*added)
    return kept, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), *(f"`{k}` {v}" for k, v in added.items())])


def _encoded(bpe: WordBpe, texts: pa.Array) -> pa.ListArray:
    ends, flat, total = [0], [], 0
    for text in texts:
        ids = bpe.encode(text.as_py() or "")
        total += len(ids)
        flat.append(np.array(ids, np.int32))
        ends.append(total)
    return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))


#: Tokens decoded at a time; bounds a worker's memory for long texts.
DECODE_STEP = 1 << 18


def _decoded(bpe: WordBpe, lists: pa.ListArray) -> pa.Array:
    lists = lists.fill_null([])
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    texts: list[bytes] = []
    row, n = 0, len(lists)
    while row < n:
        upto = max(row + 1, int(np.searchsorted(ends, ends[row] + DECODE_STEP, "right")) - 1)
        parts, stops, base = [], [np.zeros(1, np.int64)], 0
        for at in range(ends[row], ends[upto], DECODE_STEP):
            data, found = bpe.decode_flat(ids[at : min(at + DECODE_STEP, ends[upto])].astype(np.int64))
            parts.append(data)
            stops.append(found + base)
            base += len(data)
        data, bounds = b"".join(parts), np.concatenate(stops)[ends[row : upto + 1] - ends[row]]
        texts += [data[a + 1 : b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        row = upto
    return pa.array(texts, pa.binary()).cast(pa.string())


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """Adds ``out_col`` (array of int, never null): the tokens of each whole text.

    A column of that name is replaced.  Works row by row, so nothing is shuffled.
    """
    kept, schema = _replaced(docs, **{out_col: "array<int>"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(tokenizer_path)
        for batch in sliced(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, _encoded(bpe, batch.column(text_col))], [*batch.schema.names, out_col])

    return map_arrow(kept, run, schema)


def decode(docs: DataFrame, tokenizer_path: str, tokens_col: str = "tokens", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col`` (string, never null): the text that the tokens stand for.

    Special tokens are shown; a null list counts as empty.
    """
    kept, schema = _replaced(docs, **{out_col: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(tokenizer_path)
        for batch in sliced(batches, tokens_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(bpe, batch.column(tokens_col))], [*batch.schema.names, out_col])

    return map_arrow(kept, run, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, text_col: str = "text", tokens_col: str = "tokens", decoded_col: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` in one pass and one worker process a task; the text column goes."""
    kept, _ = _replaced(docs, **{tokens_col: "array<int>", decoded_col: "string"})
    _, schema = _replaced(kept.drop(text_col), **{tokens_col: "array<int>", decoded_col: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(tokenizer_path)
        for batch in sliced(batches, text_col):
            names = [n for n in batch.schema.names if n != text_col]
            tokens = _encoded(bpe, batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), tokens, _decoded(bpe, tokens)], [*names, tokens_col, decoded_col])

    return map_arrow(kept, run, schema)


def digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, and SHA-256 of the ids and of the decoded text."""
    both = round_trip(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenizer_path)
    return both.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
