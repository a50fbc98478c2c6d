"""Token ids by the tokenizers and sentencepiece libraries, with each distinct word encoded once where it can be.

Both vocabularies start a new piece before a single space or line feed that stands between two other characters (the
byte-level one by its splitting pattern; the piece model has no piece that a space or line feed stands inside or ends),
so the ids of a text are the concatenation of the ids of its space-led words. Texts with any other white space (runs,
tabs, other Unicode spaces, at either end) are encoded whole.

``frequent_ids`` counts the words of the corpus in Spark and encodes the most frequent ones, at most a stated number, once per
corpus, to be handed to every worker. All other words are encoded where they are met, and a worker
remembers the last ones. Neither memory ever changes an id.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import discard, staged_at

# words kept by a worker at most; when full, the memory starts anew
MEMO = 1_000_000
# the bound of the words that are encoded once per corpus, and then of a worker's memory of the others
FREQUENT = 1 << 19
OTHERS = 200_000
JOINED = 256  # words that are encoded together
LONG_KEY = 64  # bytes; longer words are encoded where they are met


def public_path(name_or_path: str) -> str:
    if os.path.exists(name_or_path):
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def word_keys(texts: list[str | None]) -> list[list[str] | None]:
    """Per text its words, if its only white space is single spaces and line feeds between words, else none. A word that
    starts with a line feed stands for line feed + word, any other for space + word."""
    out: list[list[str] | None] = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        spaced = t.replace("\n", " ") if "\n" in t else t
        # of all white space only the ASCII space counts as printable; other unprintable characters are rare
        clean = "  " not in spaced and spaced[0] != " " and spaced[-1] != " "
        if clean and (spaced.isprintable() or spaced.split(" ") == spaced.split()):
            out.append((t if spaced is t else t.replace("\n", " \n")).split(" "))
        else:
            out.append(None)
    return out


class WordMemo:
    """Ids of texts as bytes of ``dtype``; subclasses encode whole texts and single words."""

    dtype = "<u4"
    # marks after an ASCII letter at a word's end that are always a piece of their own, with their ids
    ending: dict[str, bytes] = {}

    def __init__(self, memo: int = MEMO, frequent: dict[str, bytes] | None = None):
        self.memo: dict[str, bytes] = {}
        self.limit = memo
        self.frequent = frequent or {}

    def whole(self, texts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def words(self, keys: list[str]) -> list[bytes]:
        raise NotImplementedError

    def learn(self, keys: list[str]) -> None:
        """Put words into the memory. Marks that end a word are pieces of their own (see ``ending``), so a word is encoded
        once with and without them."""
        bare = [k[:-1] if k[-1:] in self.ending and k[-2:-1].isascii() and k[-2:-1].isalpha() else k for k in keys]
        new = list({b for b in bare if b not in self.memo and b not in self.frequent})
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.memo.update(zip(some, self.words(some)))
        for k, b in zip(keys, bare):
            if k is not b:
                self.memo[k] = (self.memo[b] if b in self.memo else self.frequent[b]) + self.ending[k[-1:]]

    def plain(self, texts: list[list[str]], led: bool) -> list[bytes]:
        """Ids of texts from their words."""
        out, lo = [], 0
        feed = len(self.words(["\n"])[0]) if not led and texts else 0
        known = self.frequent.get if self.frequent else self.memo.get
        while lo < len(texts):  # groups of texts whose other words fit the memory together
            need: set[str] = set()
            hi, group = lo, []
            while hi < len(texts) and (hi == lo or len(need) < self.limit // 4):
                keys = texts[hi] if led else ["\n" + texts[hi][0], *texts[hi][1:]]
                parts = list(map(known, keys))
                missing = None in parts
                if missing:
                    need.update([k for k, p in zip(keys, parts) if p is None])
                group.append((keys if missing else None, parts))
                hi += 1
            if len(self.memo) + 2 * len(need) > self.limit:
                self.memo.clear()
            self.learn([k for k in need if k not in self.memo])
            other = self.memo.__getitem__
            for keys, parts in group:
                if keys is not None:
                    parts = [other(k) if p is None else p for k, p in zip(keys, parts)]
                out.append(b"".join(parts)[feed:])
            lo = hi
        return out

    def __call__(self, texts: list[str | None], led: bool = False, keys: list[list[str] | None] | None = None) -> list[bytes]:
        """Ids of each text; null and empty texts have none. With ``led``, of a space and the text. ``keys`` are the texts'
        ``word_keys``, where they are known already."""
        out: list[bytes] = [b""] * len(texts)
        keys = word_keys(texts) if keys is None else keys
        words = [i for i, k in enumerate(keys) if k is not None]
        others = [i for i, (t, k) in enumerate(zip(texts, keys)) if t and k is None]
        for i, ids in zip(words, self.plain([keys[i] for i in words], led)):
            out[i] = ids
        for i, ids in zip(others, self.whole([" " + texts[i] if led else texts[i] for i in others]) if others else ()):
            out[i] = ids
        return out


class WordMemoEncoder(WordMemo):
    """Byte-level BPE of a JSON file by the tokenizers library. With ``plain_specials``, special tokens' strings in a text
    are ordinary text; otherwise they are what the library makes of them by default."""

    def __init__(self, path: str, memo: int = MEMO, frequent: dict[str, bytes] | None = None, plain_specials: bool = True):
        super().__init__(memo, frequent)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.feed = self.whole(["\n"])[0]
        sizes = [len(b) for b in byte_level_bytes(path)]
        specials = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.ending = {mark: self.whole([mark])[0] for mark in ",."}
        self.sizes = np.array([specials.get(i, n) for i, n in enumerate(sizes + [0] * (max([-1, *specials]) + 1 - len(sizes)))], np.int64)

    def whole(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in out]

    def words(self, keys: list[str]) -> list[bytes]:
        """Clean words are encoded in lines of JOINED and cut by the bytes that each id stands for."""
        out: list[bytes] = [b""] * len(keys)
        clean = [i for i, k in enumerate(keys) if (w := k[k[:1] == "\n" :]) and w.split() == [w]]
        lines = [clean[at : at + JOINED] for at in range(0, len(clean), JOINED)]
        words = [[keys[i] if keys[i][0] == "\n" else " " + keys[i] for i in line] for line in lines]
        for line, parts, ids in zip(lines, words, self.whole(["".join(w) for w in words]) if words else ()):
            ends = np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])
            cuts = [0, *(np.searchsorted(ends, np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in parts])) + 1).tolist()]
            for i, lo, hi in zip(line, cuts, cuts[1:]):
                out[i] = ids[4 * lo : 4 * hi]
        rest = sorted(set(range(len(keys))).difference(clean))
        for i, ids in zip(rest, self.whole([keys[i][1:] if keys[i][:1] == "\n" else " " + keys[i] for i in rest]) if rest else ()):
            out[i] = self.feed + ids if keys[i][:1] == "\n" else ids
        return out


class PieceEncoder(WordMemo):
    """A piece model by the sentencepiece library, which itself adds a space before a text; texts are always led by it."""

    dtype = "<u2"

    def __init__(self, path: str, memo: int = MEMO, frequent: dict[str, bytes] | None = None):
        super().__init__(memo, frequent)
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        if self.model.get_piece_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")

    def whole(self, texts: list[str]) -> list[bytes]:
        """Of texts that begin with the space that the library adds."""
        return [np.asarray(ids, dtype="<u2").tobytes() for ids in self.model.encode([t[1:] for t in texts], num_threads=1)]

    def words(self, keys: list[str]) -> list[bytes]:
        # before a line feed the added space is a piece of its own: it is cut off
        return [ids[2:] if k[:1] == "\n" else ids for k, ids in zip(keys, self.whole([" " + k for k in keys]))]

    def __call__(self, texts: list[str | None], led: bool = True, keys: list[list[str] | None] | None = None) -> list[bytes]:
        return super().__call__(texts, True, keys)


def piece_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a piece model: the piece in UTF-8 with U+2581 as space, <0xHH> as byte HH."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE's JSON file; ids without an entry have none."""
    import json

    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    byte_of = {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(other)}}
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        out[i] = bytes(byte_of[c] for c in entry)
    return out


def frequent_ids(docs: DataFrame, text_col: str, encoders: Callable[[], list[WordMemo]], most: int = FREQUENT) -> list[dict[str, bytes]]:
    """Per encoder, the ids of the most frequent words, at most ``most``: all of at least some count, in steps of a sixteenth
    of a power of two. The workers make the encoders; only that bounded table comes to the driver."""
    keys = F.split(F.replace(F.col(text_col), F.lit("\n"), F.lit(" \n")), " ")
    counts = docs.select(F.explode(keys).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.octet_length("word") <= LONG_KEY) & (F.col("word") != ""))
    counts, path = staged_at(counts.select("word", F.floor(F.log2("n") * 16).cast("int").alias("step")), "word_steps")
    least, total = None, 0
    for step, words in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 16 * 64 rows
        total += words
        if total > most:
            break
        least = step
    kept = counts.where(F.col("step") >= least) if least is not None else counts.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoders()
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.record_batch([b.column(0), *[pa.array(e.words(words), pa.binary()) for e in made]], names=["word", *[f"ids{i}" for i in range(len(made))]])

    n = len(encoders())
    schema = "word string, " + ", ".join(f"ids{i} binary" for i in range(n))
    known = kept.select("word").repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema).toArrow()
    discard(docs.sparkSession, path)
    words = known.column("word").to_pylist()
    return [dict(zip(words, known.column(f"ids{i}").to_pylist())) for i in range(n)]


_ENCODERS: dict[tuple, WordMemo] = {}


def worker_encoder(name_or_path: str, plain_specials: bool = True) -> WordMemoEncoder:
    """The worker's encoder of a vocabulary file: a path, or the name of a public tokenizer's file."""
    key = (name_or_path, plain_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordMemoEncoder(public_path(name_or_path), plain_specials=plain_specials)
    return _ENCODERS[key]
