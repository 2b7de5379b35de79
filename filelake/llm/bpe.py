"""BPE encoding and decoding by a backtracking encoder over an Aho-Corasick automaton.

The byte-pair merge procedure gives, for each string, the one token sequence in which every
adjacent pair is *compatible*: merging the two tokens' joined text from its bytes would stop at
exactly that pair. The encoder therefore walks the text once with longest token matches, checks
each new token against the one before it in a pair table, and on conflict backs off to the next
shorter token that is a prefix, or drops the last token. No merge queue is kept.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, texts

#: Word ends are bound to a word's last byte, so a symbol is (bytes, is last).
END = "</w>"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stays, others move past U+0100."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = (chr(256 + k) for k in range(256))
    return [chr(b) if b in kept else next(moved) for b in range(256)]


class BacktrackingBPE:
    """Encoder for one word at a time, for a vocabulary with merges in rank order.

    Works on strings of stand-in symbols (one character a byte); with ``word_end`` the last
    symbol of a word carries the mark. The mark is put in as one private character joined to
    the last byte's symbol: the alphabet of symbols is first mapped to single characters.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str = "", cache: int = 300_000):
        self.symbols = byte_symbols()
        # one character per symbol: plain bytes as they are, ending bytes in a private plane
        self.plain = {s: s for s in self.symbols}
        self.ending = {s: chr(0xF0000 + k) for k, s in enumerate(self.symbols)}
        self.word_end = word_end
        self.cache_size, self.cache = cache, {}
        self.token_of: dict[str, int] = {}
        self.text: dict[int, str] = {}
        for token, i in vocab.items():
            key = self._key(token)
            self.token_of[key] = i
            self.text[i] = key
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.split: dict[int, tuple[int, int]] = {}
        for rank, (x, y) in enumerate(merges):
            out = vocab[x + y]
            self.merge[vocab[x], vocab[y]] = rank, out
            self.split.setdefault(out, (vocab[x], vocab[y]))
        self.rank = {out: rank for rank, out in self.merge.values()}
        self.automaton = ahocorasick.Automaton()
        for key, i in self.token_of.items():
            self.automaton.add_word(key, (len(key), i))
        self.size_of = {i: len(key) for key, i in self.token_of.items()}
        # next shorter token that is a prefix of a token
        self.shorter: dict[int, int] = {}
        for key, i in self.token_of.items():
            p = self.automaton.longest_prefix(key[:-1]) if len(key) > 1 else 0
            while p and key[:p] not in self.token_of:
                p -= 1
            self.shorter[i] = self.token_of[key[:p]] if p else -1
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def _key(self, token: str) -> str:
        if self.word_end and token.endswith(self.word_end) and len(token) > len(self.word_end):
            token = token[: -len(self.word_end)]
            return token[:-1] + self.ending[token[-1]]
        return token

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two tokens ends in exactly these two.

        Undo the merges of both in falling rank; at the seam no merge may come before those
        that were undone (at equal rank the left one is done first).
        """
        known = self.pairs.get((left, right))
        if known is None:
            known = self._compatible(left, right)
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit = float("inf")
        while True:
            found = self.merge.get((a, b))
            if found is not None and found[0] < limit:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                # the left token was made at rank ra; before that its right half stood at the seam
                limit, a = ra, self.split[a][1]
            else:
                # made at rb: a seam merge of equal rank lies further left and would have come first
                limit, b = rb + 1, self.split[b][0]

    def encode_word(self, key: str) -> list[int]:
        """Token ids of one word given as symbols; exact, one walk with back-off."""
        whole = self.token_of.get(key)
        if whole is not None:
            return [whole]
        n = len(key)
        longest = [-1] * n  # the longest token that starts at a position: of one start, longer ones end later
        for end, (size, i) in self.automaton.iter(key):
            longest[end - size + 1] = i
        size_of, shorter, pairs = self.size_of, self.shorter, self.pairs
        out: list[int] = []
        ends: list[int] = []
        dead = bytearray(n + 1)  # positions from which the rest can't be finished after a valid prefix
        at, last = 0, -1
        token = longest[0] if n else -1
        while at < n:
            end = at + size_of[token]
            if not dead[end]:
                ok = last < 0
                if not ok:
                    ok = pairs.get((last, token))
                    if ok is None:
                        ok = self.compatible(last, token)
                if ok:
                    out.append(token)
                    ends.append(at)
                    at, last = end, token
                    if at < n:
                        token = longest[at]
                    continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                token, at = shorter[out.pop()], ends.pop()
                last = out[-1] if out else -1
        return out

    def word(self, word: str) -> tuple[list[int], str]:
        """Ids of a pre-split word, and the same as decimal text; repeated words come from a bounded cache."""
        got = self.cache.get(word)
        if got is None:
            key = word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode()])
            if self.word_end and key:
                key = key[:-1] + self.ending[key[-1]]
            ids = self.encode_word(key)
            got = ids, " ".join(map(str, ids))
            if len(word) <= 64:
                if len(self.cache) >= self.cache_size:
                    self.cache.clear()
                self.cache[word] = got
        return got


class OffsetDecoder:
    """All token strings in one text, and an offset table: a token is text[offset[i]:offset[i + 1]]."""

    def __init__(self, vocab: dict[str, int]):
        at, parts, self.offset = 0, [], [0]
        by_id = {i: t for t, i in vocab.items()}
        for i in range(max(by_id, default=-1) + 1):
            parts.append(by_id.get(i, ""))
            at += len(parts[-1])
            self.offset.append(at)
        self.blob = "".join(parts)

    def token(self, i: int) -> str:
        return self.blob[self.offset[i] : self.offset[i + 1]]

    def decode(self, ids, joiner: str = " ") -> str:
        """Without a decoder in the vocabulary file, tokens are joined by one blank."""
        blob, off = self.blob, self.offset
        return joiner.join([blob[off[i] : off[i + 1]] for i in ids])


#: White space as the vocabulary file's normaliser knows it; Python's own also takes U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern of the vocabulary file's own splitter (fixed value), with that white space.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
SEPARATORS = regex.compile("[\x1c-\x1f]")


class WordTokenizer:
    """A vocabulary file with word ends: normalise, cut at special tokens, split into words, encode each."""

    def __init__(self, path: str, cache: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bpe = BacktrackingBPE(model["vocab"], merges, model.get("end_of_word_suffix") or "", cache)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile(f"({'|'.join(map(regex.escape, longest_first))})") if self.special else None
        self.chunks: dict[str, tuple[list[int], str]] = {}
        self.decoder = OffsetDecoder(model["vocab"] | self.special)

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # lower() has a rule for the final sigma that the file's plain mapping lacks
        return text.lower() if "Σ" not in text else "σ".join(p.lower() for p in text.split("Σ"))

    def chunk(self, chunk: str) -> tuple[list[int], str]:
        """Ids, plain and as text, of a normalised run without white space: no word crosses white space."""
        word = self.bpe.word
        if chunk.isalpha():
            got = word(chunk)
        elif chunk[:-1].isalpha() and chunk[-1] in ",.":
            (a, s), (b, r) = word(chunk[:-1]), word(chunk[-1])
            got = a + b, f"{s} {r}"
        else:
            found = [word(w) for w in WORD.findall(chunk)]
            got = [i for ids, _ in found for i in ids], " ".join([s for _, s in found])
        if len(chunk) <= 64:
            if len(self.chunks) >= self.bpe.cache_size:
                self.chunks.clear()
            self.chunks[chunk] = got
        return got

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids, and the ids as decimal text joined by one blank."""
        ids: list[int] = []
        said: list[str] = []
        pieces = [text]
        if self.cut and "<|" in text:
            pieces = self.cut.split(text)
        known, chunk = self.chunks.get, self.chunk
        for k, piece in enumerate(pieces):
            if k % 2:
                ids.append(self.special[piece])
                said.append(str(self.special[piece]))
                continue
            piece = self.normalise(piece)
            for c in piece.split() if not SEPARATORS.search(piece) else [piece]:
                i, s = known(c) or chunk(c)
                ids += i
                if s:
                    said.append(s)
        return ids, " ".join(said)

    def decode(self, ids) -> str:
        return self.decoder.decode(ids)


@lru_cache(maxsize=2)
def tokenizer(path: str, cache: int = 300_000) -> WordTokenizer:
    """One per Python worker and file, with word caches of ``cache`` entries (about half a kilobyte each)."""
    return WordTokenizer(path, cache)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine; executors look it up for themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, vocab: str = "word_bpe_49k.json", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with columns ``ids array<int>`` and ``decoded`` added (replaced where they exist), without ``text`` if it isn't kept.

    Map-only: nothing is shuffled, memory is one Arrow slice of texts and a bounded word cache.
    Null and empty texts give no ids and an empty text; repeated rows are encoded one by one.
    """
    rest = [c for c in docs.columns if c not in ("ids", "decoded")]
    base = docs.select(*rest)
    rest = [c for c in rest if keep_text or c != text]
    schema = base.select(*rest).withColumns({"ids": F.lit(None).cast("array<int>"), "decoded": F.lit(None).cast("string")}).schema

    def run(batches):
        # ids and texts go out whole: a smaller cache leaves room for them
        tok = tokenizer(vocabulary(vocab), 1 << 16)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                ids = [tok.encode(t)[0] for t in texts(part.column(text))]
                yield pa.RecordBatch.from_arrays(
                    [*part.select(rest).columns, pa.array(ids, pa.list_(pa.int32())), pa.array([tok.decode(i) for i in ids], pa.string())],
                    [*rest, "ids", "decoded"],
                )

    return base.mapInArrow(run, schema)


def digest_documents(docs: DataFrame, vocab: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text; keep counts and digests only, so that no ids leave the task."""

    def run(batches):
        tok = tokenizer(vocabulary(vocab))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n, ids_sha, text_sha = [], [], []
                for t in texts(part.column(1)):
                    ids, said = tok.encode(t)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(said.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(tok.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark, sf_dir):
    return digest_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op2_bpe": op2_bpe}
ORACLES: dict[str, str] = {}
