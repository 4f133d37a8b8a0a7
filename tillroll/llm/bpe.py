"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

Encoding.  For a merge list, a sequence of tokens is the encoding of its text exactly if each
token, and each pair of neighbours, is the encoding of its own text.  So the last token of
every prefix is found from the last token of a shorter one, at most ``lookahead`` (the longest
token's symbols) back.  Those last tokens form a tree of prefixes; whatever text follows, its
encoding runs through one of the last ``lookahead`` prefixes, so tokens up to their common
ancestor are stable and are emitted.  What is kept is the tree above that ancestor: memory
does not grow with the text.

Text is first split as the tokenizer's file says (added tokens in the raw text; NFC, lower
case; the split pattern).  None of these rules looks across white space, so stretches between
white space are encoded apart, the short ones through a bounded cache.

Decoding.  Token ids go through a state machine that turns bytes into text as they come and
holds back at most the three bytes of an unfinished character.

A null or empty text has no tokens.  Very long texts go through in pieces; only their ids are
kept, if asked for.  Rows are independent: repeats and ties need no rule.  An empty table gives
an empty result.  Columns may have any names; the one that ids or texts are written to replaces
a column of its name.

The tokenizer's file is read by the driver and broadcast as bytes (a few MB, whatever the input),
so executors need not have it.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType
from tokenizers import Tokenizer

from tillroll.llm._common import by_position, position

#: The White_Space characters, as the split pattern's \s has them.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CACHE_ENTRIES, WORD_ENTRIES, PAIR_ENTRIES, CACHE_CHARS, PIECE_CHARS = 120_000, 250_000, 250_000, 64, 1 << 18


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    code = {b: b for b in printable} | {b: 256 + k for k, b in enumerate(rest)}
    return [chr(code[b]) for b in range(256)]


class Transducer:
    """Merges symbols into tokens, one word after another; symbols and tokens are vocabulary ids."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.ranks = ranks
        parts = {new: pair for pair, (_, new) in ranks.items()}
        self.symbols: dict[int, tuple[int, ...]] = {}
        for new, pair in parts.items():
            self.symbols[new] = tuple(s for p in pair for s in self.symbols.get(p, (p,)))
        self.lookahead = max((len(s) for s in self.symbols.values()), default=1)
        self.backward: dict = {}
        for token, symbols in self.symbols.items():
            if self.merged(symbols) == [token]:
                node = self.backward
                for s in reversed(symbols):
                    node = node.setdefault(s, {})
                node[None] = token
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, symbols: Iterable[int]) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, while there is one."""
        out = list(symbols)
        while len(out) > 1:
            rank, at, new = min(((*self.ranks[p], k) for k, p in enumerate(zip(out, out[1:], strict=False)) if p in self.ranks), key=lambda x: (x[0], x[2]), default=(None, 0, 0))
            if rank is None:
                break
            out[new : new + 2] = [at]
        return out

    def _fits(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged((*self.symbols.get(a, (a,)), *self.symbols.get(b, (b,)))) == [a, b]
        return known

    def encode(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of one word's symbols, emitted as soon as no further symbol can change them."""
        recent: list[int] = []  # symbols of the last lookahead prefixes
        last: dict[int, tuple[int, int]] = {0: (-1, 0)}  # prefix length: its last token, the prefix before that
        done = n = 0
        root, pairs = self.backward, self.pairs
        for symbol in symbols:
            n += 1
            recent.append(symbol)
            if len(recent) > 2 * self.lookahead:
                del recent[: -self.lookahead]
            # The one token that ends here and fits the last token of the prefix before it.
            at, token, node = n - 1, symbol, root.get(symbol)
            while True:
                if token is not None and (before := last.get(at)) is not None:
                    b = before[0]
                    if b < 0:
                        break
                    fits = pairs.get((b, token))
                    if fits or (fits is None and self._fits(b, token)):
                        break
                at -= 1
                node = node[recent[at - n]]
                token = node.get(None)
            last[n] = (token, at)
            if len(last) > 4 * self.lookahead + 8:
                stable = self._common(last, n)
                if stable > done:
                    yield from self._path(last, stable, done)
                    # The tree above the stable prefix, and those that a next token may start from.
                    last = {k: v for k, v in last.items() if k >= stable}
                    done = stable
        yield from self._path(last, n, done)

    def _common(self, last: dict, n: int) -> int:
        live = {k for k in range(max(0, n - self.lookahead), n + 1) if k in last}
        while len(live) > 1:
            live.remove(top := max(live))
            live.add(last[top][1])
        return live.pop()

    @staticmethod
    def _path(last: dict, at: int, stop: int) -> list[int]:
        out = []
        while at > stop:
            token, at = last[at]
            out.append(token)
        return out[::-1]


class _Cache(dict):
    """Short keys (stretches without white space, or the words in them) and their packed ids; emptied when full."""

    def __init__(self, make, entries: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of one tokenizer file with word ends: byte-level BPE over split, lower-cased text."""

    def __init__(self, raw: bytes) -> None:
        spec = json.loads(raw)
        model, self.vocab = spec["model"], dict(spec["model"]["vocab"])
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError(f"no rules for {kinds}")
        self.end = model["end_of_word_suffix"] or ""
        v = self.vocab
        self.core = Transducer({(v[a], v[b]): (rank, v[a + b]) for rank, (a, b) in enumerate(map(tuple, model["merges"]))})
        signs = byte_symbols()
        self.inner, self.final = [v[s] for s in signs], [v[s + self.end] for s in signs]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {k: i.to_bytes(4, "little") for k, i in added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(pattern.replace("\\s", SPACE))
        self.stretch = regex.compile(f"[^{SPACE}]+")
        self.surface = {i: t for t, i in (v | added).items()}
        self.byte_of = {s: b for b, s in enumerate(signs)}
        self.cache = _Cache(lambda key: b"".join(self._stretch(key)))
        self.words = _Cache(self._word, WORD_ENTRIES)
        # Which characters are letters, and their lower case, differ between versions of Unicode;
        # beyond the Latin blocks, which no version changes, the library's own tables decide.
        rules = Tokenizer.from_buffer(raw)
        self.normal, self.pieces = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str

    def _words(self, text: str) -> Iterator[bytes]:
        if text.isascii() or max(text) < "\u0250":
            return (m[0].encode() for m in self.word.finditer(text.lower()))
        return (bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in self.pieces(self.normal(text)))

    def _stretch(self, text: str) -> Iterator[bytes]:
        for raw in self._words(text):
            if len(raw) <= CACHE_CHARS:
                yield self.words[raw]
            else:
                for token in self.core.encode(self._symbols(raw)):
                    yield token.to_bytes(4, "little")

    def _symbols(self, raw: bytes) -> Iterator[int]:
        inner = self.inner
        for k in range(len(raw) - 1):
            yield inner[raw[k]]
        yield self.final[raw[-1]]

    def _word(self, raw: bytes) -> bytes:
        return b"".join([token.to_bytes(4, "little") for token in self.core.encode(self._symbols(raw))])

    def _plain(self, text: str) -> Iterator[bytes]:
        """Ids of a text without added tokens, in pieces cut at white space."""
        at = 0
        while at < len(text):
            stop = min(len(text), at + PIECE_CHARS)
            if stop < len(text):
                # Back to white space, if there is any in the piece, else on to the next.
                cut = max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))
                if cut > at:
                    stop = cut
                else:
                    m = self.stretch.match(text, stop)
                    stop = m.end() if m else stop
            piece = text[at:stop]
            at = stop
            words = piece.split()
            if any(c in piece for c in "\x1c\x1d\x1e\x1f"):  # white space to split() only
                words = self.stretch.findall(piece)
            if len(words) == 1 and len(words[0]) > CACHE_CHARS:
                yield from self._stretch(words[0])
            else:
                yield b"".join(map(self.cache.__getitem__, words))

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, in pieces."""
        if not text:
            return
        for part in self.split_added.split(text) if self.split_added and "<|" in text else (text,):
            if part in self.added:
                yield self.added[part]
            else:
                yield from self._plain(part)

    def decoder(self, surface: bool = True) -> Decoder:
        return Decoder(self, surface)


class Decoder:
    """Incremental decoding: ids in, text out.

    With ``surface`` the pieces are the tokens as the vocabulary spells them, joined by single
    spaces, as the library decodes where the file names no decoder; without it, the bytes they
    stand for, a space after each word.
    """

    def __init__(self, codec: Codec, surface: bool = True) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        end = codec.end
        if surface:
            self.table = {i: t.encode() for i, t in codec.surface.items()}
        else:
            plain = lambda t: bytes(codec.byte_of[c] for c in t.removesuffix(end)) + b" " * t.endswith(end) if t in codec.vocab else t.encode()
            self.table = {i: plain(t) for i, t in codec.surface.items()}
        self.join, self.first = (b" " if surface else b""), True

    def feed(self, packed: bytes, final: bool = False) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        raw = self.join.join(map(self.table.__getitem__, ids))
        if ids and not self.first:
            raw = self.join + raw
        self.first = self.first and not ids
        return self.machine.decode(raw, final)

    def reset(self) -> None:
        self.machine.reset()
        self.first = True


def digests(codec: Codec, decoder: Decoder, text: str | None, ids: list[bytes] | None = None) -> tuple[int, str, str]:
    """Number of tokens, SHA-256 of the packed ids, SHA-256 of the decoded text; nothing of the whole is kept but, if asked for, the ids."""
    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
    decoder.reset()
    for piece in codec.encode(text):
        n += len(piece) // 4
        of_ids.update(piece)
        of_text.update(decoder.feed(piece).encode())
        if ids is not None:
            ids.append(piece)
    of_text.update(decoder.feed(b"", True).encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


_CODECS: dict[bytes, Codec] = {}


def codec_of(raw: bytes) -> Codec:
    """One codec a worker process and file."""
    key = hashlib.sha256(raw).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(raw)
    return _CODECS[key]


def load(path: str) -> Codec:
    return codec_of(Path(path).read_bytes())


def _shipped(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encode_digests(df: DataFrame, path: str, keep: list[str], text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Columns ``keep``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of each row's whole text."""
    held = [f"_c{i}" for i in range(len(keep))]
    kept = by_position(df).select(*(F.col(position(df, c)).alias(h) for c, h in zip(keep, held, strict=True)), F.col(position(df, text_col)).alias("_text"))
    schema = StructType(list(kept.schema)[:-1]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    file = _shipped(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(file.value)
        decoder = codec.decoder()
        for batch in batches:
            found, ids = [], []
            for x in batch.column("_text"):
                own = [] if with_ids else None
                found.append(digests(codec, decoder, x.as_py(), own))
                if with_ids:
                    ids.append(np.frombuffer(b"".join(own), "<i4"))
            made = zip(*found, strict=True) if found else ((), (), ())
            cols = [batch.column(c) for c in held] + [pa.array(list(x), t) for x, t in zip(made, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, *([_lists(ids)] if with_ids else [])], names=schema.names)

    return kept.mapInArrow(run, schema).toDF(*keep, *schema.names[len(keep) :])


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, "i4")))


def _replaced(df: DataFrame, col: str, kind: object) -> tuple[list[int], StructType, list[str]]:
    """Which columns of df stay beside a new one, the schema of both by position, and the names that they get."""
    stay = [k for k, c in enumerate(df.columns) if c.lower() != col.lower()]
    schema = StructType([by_position(df).schema[k] for k in stay]).add("_new", kind)
    return stay, schema, [*(df.columns[k] for k in stay), col]


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the token ids of each text as an array column."""
    stay, schema, names = _replaced(df, ids_col, ArrayType(IntegerType()))
    text, file = position(df, text_col), _shipped(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(file.value)
        for batch in batches:
            ids = [np.frombuffer(b"".join(codec.encode(x.as_py())), "<i4") for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in stay), _lists(ids)], names=schema.names)

    return by_position(df).mapInArrow(run, schema).toDF(*names)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded", surface: bool = True) -> DataFrame:
    """Add the text of each array of token ids; a null array gives an empty text."""
    stay, schema, names = _replaced(df, text_col, "string")
    ids, file = position(df, ids_col), _shipped(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = codec_of(file.value).decoder(surface)
        for batch in batches:
            out = []
            for x in batch.column(ids):
                decoder.reset()
                out.append(decoder.feed(np.asarray(x.as_py() or [], "<u4").tobytes(), True))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in stay), pa.array(out, pa.string())], names=schema.names)

    return by_position(df).mapInArrow(run, schema).toDF(*names)
