"""Word-level BPE by a depth-first walk over the trie of distinct words, so that what prefixes share is done once.

The state of a prefix is its last token: a sequence of tokens is an encoding exactly if every two neighbours are
compatible, that is, if no merge across their border comes before the merges that build them. So the encoding of a
prefix is that of a shorter prefix and one more token, and words that share a prefix share its states. A word's last
symbol carries the word end, so the last token is found anew at each word's end node, from the states on the path.

Defined results: null is the empty text and has no tokens (an empty id text, an empty decoded text); text of only white
space likewise; very long words and texts are encoded whole; repeated rows give repeated results; strings of special
tokens in a text become these tokens, as the library does by default.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, held, prepare

VOCABULARY = "word_bpe_49k.json"
#: Words, pieces and pairs that a worker keeps at hand (two generations of each); it drops them when its task ends.
CACHE = 50_000
#: Bytes of texts that are encoded together.
GATHER = 5_000_000
#: Letters and signs whose classes and lower case no Unicode version changes, and that are their own NFC.
_COMMON = re.compile("[!-~\xa1-\xac\xae-\u012f\u0132-\u017f]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Encoder for a tokenizers file of the word BPE kind."""

    def __init__(self, path: str) -> None:
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.path, self._library = path, None
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max(*self.vocab.values(), *self.special.values()))
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = s
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = _byte_symbols()
        self.rank: dict[int, int] = {}  # by both parts' ids in one number
        self.split: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            x, y = self.vocab[a], self.vocab[b]
            self.rank[x << 20 | y] = r
            self.split[self.vocab[a + b]] = (x, y, r)
        self.size = [len(s) for s in self.names]
        self.numbers = [str(i) for i in range(len(self.names))]
        self._spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self._pairs: dict[int, bool] = {}
        self._sound: dict[int, bool] = {}
        self._known = Cache(self._shown)
        self._build_suffixes()
        self._sound.clear()
        self._spines.clear()

    def library(self):
        """The tokenizers library's own encoder, read when it is first needed."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _build_suffixes(self) -> None:
        """An automaton over the tokens: the state after a prefix gives all tokens that end there, longest first."""
        goto: list[dict[str, int]] = [{}]
        inner: list[tuple] = [()]
        final: list[tuple] = [()]
        for name, token in self.vocab.items():
            if not self.sound(token):
                continue
            stem = name.removesuffix(self.end)
            node = 0
            for c in stem:
                if (child := goto[node].get(c)) is None:
                    child = goto[node][c] = len(goto)
                    goto.append({})
                    inner.append(())
                    final.append(())
                node = child
            if stem:
                (inner if stem is name or stem == name else final)[node] = ((token, len(stem)),)
        fail = [0] * len(goto)
        level = list(goto[0].values())
        while level:
            deeper = []
            for node in level:
                inner[node] += inner[fail[node]]
                final[node] += final[fail[node]]
                for c, child in goto[node].items():
                    f = fail[node]
                    while f and c not in goto[f]:
                        f = fail[f]
                    fail[child] = goto[f].get(c, 0)
                    deeper.append(child)
            level = deeper
        self._goto, self._fail, self._inner, self._final = goto, fail, inner, final

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The token's outermost parts on one side, smallest first, each with the rank of the merge that takes it up."""
        if (found := self._spines.get((token, side))) is None:
            found, until, t = [], float("inf"), token
            while True:
                found.append((t, until))
                if t not in self.split:
                    break
                until = self.split[t][2]
                t = self.split[t][side]
            found.reverse()
            self._spines[token, side] = found
        return found

    def _border(self, left: int, right: int) -> float:
        """The rank of the first merge across the border of two tokens; -1 if there is one before both are whole."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            r = self.rank.get(x << 20 | y, float("inf"))
            if i == len(a) - 1 and j == len(b) - 1:
                return r
            # of equal ranks, the merge further left comes first
            if r < x_until and r <= y_until:
                return -1
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def sound(self, token: int) -> bool:
        """Whether merging the token's own characters gives the token."""
        if (ok := self._sound.get(token)) is None:
            if token in self.split:
                x, y, r = self.split[token]
                ok = self._border(x, y) == r and self.sound(x) and self.sound(y)
            else:
                ok = True
            self._sound[token] = ok
        return ok

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        if (ok := self._pairs.get(key)) is None:
            if len(self._pairs) > 2 * CACHE:
                self._pairs.clear()
            ok = self._pairs[key] = self._border(left, right) == float("inf")
        return ok

    def forget(self) -> None:
        """Drops what was computed on the way; it is found again when needed."""
        self._pairs.clear()
        self._spines.clear()
        self._known.clear()

    def words_of(self, chunk: str) -> list[str]:
        """The words of a piece of text without white space, as visible byte symbols."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk.isprintable():
                return [chunk[:-1].lower(), chunk[-1]] if chunk[:-1].isalpha() else self._words.findall(chunk.lower())
        if _COMMON.fullmatch(chunk):
            text = chunk.lower()
            s = self.symbols
            if text.isalpha():
                return ["".join([s[b] for b in text.encode()])]
            return ["".join([s[b] for b in w.encode()]) for w in self._words.findall(text)]
        # rarer characters: their classes depend on the Unicode version, so the library's own rules split them
        library = self.library()
        return [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(chunk))]

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words (byte symbols), by one depth-first walk of their trie that carries the last-token states.

        Sorted words are the trie's ends in depth-first order, and a node is a prefix that neighbours share. So a word is
        put in by going back to the node where it leaves the word before it; only the path to that node is ever held.
        """
        out: dict[str, list[int]] = {}
        goto, fail, inner, final, size = self._goto, self._fail, self._inner, self._final, self.size
        pairs, compatible = self._pairs, self.compatible
        last: list[int] = [0]  # last token of each prefix on the path; the empty prefix has none
        states: list[int] = [0]  # the automaton's state at each prefix
        before_ = ""
        for w in sorted(words):
            shared, most = 0, min(len(before_), len(w) - 1)
            while shared < most and before_[shared] == w[shared]:
                shared += 1
            before_ = w
            # the node of a whole word has a state, but no last token until a longer word goes through it
            del states[shared + 1 :], last[shared + 1 :]
            state = states[shared]
            for depth in range(len(last), shared + 1):
                last.append(self._last(inner[state], depth, last, w))
            for depth in range(shared + 1, len(w)):
                c = w[depth - 1]
                while (to := goto[state].get(c)) is None and state:
                    state = fail[state]
                state = to or 0
                states.append(state)
                for t, n in inner[state]:
                    if (at := depth - n) == 0 or ((ok := pairs.get(last[at] << 20 | t)) is None and compatible(last[at], t)) or ok:
                        break
                else:
                    raise ValueError(f"no token ends at {c!r}")
                last.append(t)
            depth, c = len(w), w[-1]
            while (to := goto[state].get(c)) is None and state:
                state = fail[state]
            state = to or 0
            states.append(state)
            for t, n in final[state]:
                if (at := depth - n) == 0 or ((ok := pairs.get(last[at] << 20 | t)) is None and compatible(last[at], t)) or ok:
                    break
            else:
                raise ValueError(f"no token ends {w!r}")
            ids = [t]
            while at:
                ids.append(x := last[at])
                at -= size[x]
            ids.reverse()
            out[w] = ids
        return out

    def _last(self, tokens: tuple, depth: int, last: list[int], word: str) -> int:
        """The last token of the word's prefix of this depth, of those that may end there."""
        for t, n in tokens:
            if depth == n or self.compatible(last[depth - n], t):
                return t
        raise ValueError(f"no token ends at {depth} of {word!r}")

    def pieces_of(self, chunk: str) -> list[str | int]:
        """The words of a piece without white space, and the ids of special tokens in it."""
        if "<|" not in chunk or not self._special:
            return self.words_of(chunk)
        found: list[str | int] = []
        for piece in self._special.split(chunk):
            found += [self.special[piece]] if piece in self.special else self.words_of(piece)
        return found

    def encode_chunks(self, chunks: list[str]) -> dict[str, list[int]]:
        """Ids of pieces of text without white space; the words of all pieces share one trie."""
        parts = {chunk: self.pieces_of(chunk) for chunk in chunks}
        ids = self.encode_words(list({w for found in parts.values() for w in found if isinstance(w, str)}))
        return {chunk: [x for p in found for x in ((p,) if isinstance(p, int) else ids[p])] for chunk, found in parts.items()}

    def _shown(self, words: list[str]) -> dict[str, tuple[int, str, str]]:
        """(number of ids, ids as text, decoded text) of words."""
        numbers, names = self.numbers, self.names
        return {w: (len(ids), " ".join([numbers[i] for i in ids]), " ".join([names[i] for i in ids])) for w, ids in self.encode_words(words).items()}

    def show_chunks(self, chunks: list[str]) -> dict[str, tuple[int, str, str]]:
        """The same of pieces of text; a piece that is one word has that word's own entry."""
        parts: dict[str, str | list] = {}
        words: set[str] = set()
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha():
                own = parts[chunk] = chunk.lower()
                words.add(own)
            else:
                found = parts[chunk] = self.pieces_of(chunk)
                words.update([w for w in found if w.__class__ is str])
        self._known.fill(words)
        known, numbers, names = self._known.young, self.numbers, self.names
        out = {}
        for chunk, found in parts.items():
            if found.__class__ is str:
                out[chunk] = known[found]
            else:
                n, ids, texts = zip(*[known[w] if w.__class__ is str else (1, numbers[w], names[w]) for w in found]) if found else ((), (), ())
                out[chunk] = sum(n), " ".join(ids), " ".join(texts)
        return out

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder, so the library joins the tokens' names by spaces."""
        return " ".join([self.names[i] for i in ids])


def model(path: str) -> WordBPE:
    return held(("bpe", path), lambda: WordBPE(path))


class Cache:
    """What pieces of text become, for the pieces seen lately: two generations, so memory stays bounded."""

    def __init__(self, make, limit: int = CACHE) -> None:
        self.make, self.limit, self.young, self.old = make, limit, {}, {}

    def fill(self, chunks: set[str]) -> None:
        """Afterwards young has all the chunks. The limit may be passed by one batch's own chunks."""
        young, old = self.young, self.old
        missing = [c for c in chunks if c not in young]
        if len(young) + len(missing) > self.limit:
            self.old, self.young = young, {c: young[c] for c in chunks if c in young}
            old, young = self.old, self.young
        moved = [c for c in missing if c in old]
        for c in moved:
            young[c] = old[c]
        if len(moved) < len(missing):
            young.update(self.make([c for c in missing if c not in old]))


    def clear(self) -> None:
        self.young, self.old = {}, {}


_CACHES: dict[tuple, Cache] = {}


def _texts_cache(path: str) -> Cache:
    """Piece -> (number of its ids, its ids as text, its decoded text)."""

    def make(chunks: list[str]) -> dict:
        return model(path).show_chunks(chunks)

    return _CACHES.setdefault(("texts", path), Cache(make, CACHE // 2))


def slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[pa.Array]:
    """Runs of texts of about so many bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def gathered(batches: Iterator[pa.RecordBatch], most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of about so many bytes, where a larger run is worth its memory."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def coded(texts: pa.Array, listed: bool = True) -> tuple:
    """The texts' pieces between ASCII white space: (a code for each piece, borders of the texts, piece of each code, as a
    list or an array).

    Other white space stays inside pieces. A blank text is one empty piece.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    borders = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten().dictionary_encode()
    return flat.indices.to_numpy(), borders, flat.dictionary.to_pylist() if listed else flat.dictionary


def encoded(df: DataFrame, id_col: str, text_col: str, path: str | None = None, keep_text: bool = True) -> DataFrame:
    """(id long, n_tokens long, ids string, decoded string): ids and decoded are the whole results; with keep_text off,
    their SHA-256 stand in their place, so that they never leave the worker."""
    prepare(df.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the caches are large and nothing here makes cycles
        cache = _texts_cache(path)
        try:
            for b in gathered(batches, GATHER):
                start = 0
                for part in slices(b.column(1), GATHER):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(part)), *whole(cache, part)], ["id", "n_tokens", "ids", "decoded"])
                    start += len(part)
        finally:  # the worker goes on to other operators' tasks
            cache.clear()
            model(path).forget()
            gc.enable()
            given_back()

    def whole(cache: Cache, part: pa.Array) -> list[pa.Array]:
        codes, borders, pieces = coded(part)
        cache.fill(set(pieces))
        values = list(map(cache.young.__getitem__, pieces))
        counts = np.fromiter([x[0] for x in values], np.int32, len(values))
        n_tokens = np.add.reduceat(counts[codes], borders[:-1], dtype=np.int64) if len(part) else np.zeros(0, np.int64)
        if not counts.all():  # a piece without tokens has no place in a join
            real = counts[codes] > 0
            borders, codes = np.concatenate([[0], np.cumsum(real)])[borders], codes[real]
        out = [pa.array(n_tokens)]
        for k in (1, 2):
            names = [x[k] for x in values]
            # one text at a time: nothing of the size of a batch is built
            joined = (" ".join([names[c] for c in codes[a:b].tolist()]) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()))
            out.append(pa.array(joined if keep_text else (hashlib.sha256(x.encode()).hexdigest() for x in joined), pa.string(), size=len(part)))
        return out

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, n_tokens long, ids string, decoded string")


def op4(spark, sf_dir: str) -> DataFrame:
    found = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", keep_text=False)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
