"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over the bytes cuts each text where its low bits vanish, so equal passages of different texts give equal
chunks. Chunks that occur more than once in the corpus are encoded once, in the text that owns them; the other texts take
the ids by a join. Where two chunks meet, their ids may differ from those of the whole text: the join is repaired by
encoding the words on both sides again, wider and wider, until the new ids agree with the chunks' own at both ends.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import doc_texts, write_table

#: Bytes a chunk has on average beyond the least, at least, and at most.
MEAN_CHUNK, LEAST_CHUNK, MOST_CHUNK = 2048, 256, 16384
#: Entries of a worker's memo of words.
MEMO = 300_000

_gear = np.frombuffer(hashlib.shake_256(b"tidemark gear").digest(1024), np.uint32)
#: A single space between two characters that are not white space: always a border between pre-tokens.
_border = re.compile(r"(?<=\S) (?=\S)")
#: Words whose characters every version of the Unicode tables classes alike.
_plain = re.compile(r"(?:[!-~¡-ʯΑ-ωЀ-ѿ]+(?:\n+(?=[!-~¡-ʯΑ-ωЀ-ѿ])|(?: (?=[!-~¡-ʯΑ-ωЀ-ѿ]))|\Z))+")
# How byte-level BPE splits a text before merging; the same for texts without runs of white space, where it
# needs no look-ahead and runs as an automaton.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: A sign that is neither space, line feed nor of the kind that _plain allows.
_unplain = re.compile("[^\n !-~¡-ʯΑ-ωЀ-ѿ]")
_loose = re.compile(r" \s|\s |\A | \Z")


class Coder:
    """One tokenizer file: ids of a text, and the text of ids. Words between single spaces are encoded once and remembered."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and spec["normalizer"] is None
        if not plain or any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is no byte-level BPE whose words can be encoded alone")
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        letters = {c: b for b, c in _byte_letters().items()}
        added = {t["id"] for t in spec["added_tokens"]}
        self.bytes = [
            t.encode() if i in added else bytes(letters[c] for c in t)
            for i, t in ((i, self.tokenizer.id_to_token(i) or "") for i in range(size))
        ]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        #: Where the merges are in the order of their ids, ranks say the same as merges, and the rank coder is faster.
        self.ranked = self.ranked_no_runs = None
        if all(x < y for x, y in zip(made, made[1:], strict=False)) and len(made) + 256 == len(vocab) - len(added & set(vocab.values())):
            ranks = {b: i for i, b in enumerate(self.bytes) if i not in added}
            self.ranked, self.ranked_no_runs = (
                tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) for name, pattern in (("ranked", PATTERN), ("no runs", NO_RUNS))
            )
        self.memo: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words as they are after a space. Plain ones are encoded together and cut at the spaces."""
        if self.ranked is None or not _plain.fullmatch(line := " ".join(words)) or self.special.search(line):
            plain = [w for w in words if self.ranked is not None and _plain.fullmatch(w) and not self.special.search(w)]
            for w in set(words).difference(plain):
                self.memo[w] = self._alone(" " + w)
            words, line = plain, " ".join(plain)
        if words:
            ids = self.ranked.encode_to_numpy(" " + line, disallowed_special=())
            sizes = [len(w.encode()) + 1 for w in words]
            at = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1
            ids, start, memo = ids.astype(np.uint16).tobytes(), 0, self.memo
            for w, end in zip(words, (2 * at).tolist(), strict=True):
                memo[w] = ids[start:end]
                start = end

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, as unsigned 16-bit integers: plain ones by ranks in one piece, the others by remembered words."""
        out = [None if self.ranked is None or _unplain.search(t) or any(x in t for x in self.specials) else self._by_ranks(t) for t in texts]
        others = iter(self._by_words([t for t, x in zip(texts, out, strict=True) if x is None]))
        return [next(others) if x is None else x for x in out]

    def _by_ranks(self, text: str) -> np.ndarray:
        runs = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        return (self.ranked if runs else self.ranked_no_runs).encode_to_numpy(text, disallowed_special=()).astype(np.uint16)

    def _by_words(self, texts: list[str], at_once: int = 64) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), at_once):
            split = [_border.split(t) if _loose.search(t) else t.split(" ") for t in texts[i : i + at_once]]
            heads = [words[0] for words in split]
            for words in split:
                del words[0]
            memo = self.memo
            if len(memo) > MEMO:
                memo.clear()
            if unknown := set().union(*split).difference(memo):
                self._learn(list(unknown))
            for head, words in zip(heads, split, strict=True):
                if (lead := self.first.get(head)) is None:
                    lead = self._alone(head) if head else b""
                    if len(self.first) < MEMO // 8:
                        self.first[head] = lead
                out.append(np.frombuffer(b"".join([lead, *map(memo.__getitem__, words)]), np.uint16))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def cuts(data: bytes) -> list[int]:
    """Chunk borders of UTF-8 bytes, 0 and the length included; a border never splits a character."""
    n = len(data)
    if n <= LEAST_CHUNK:
        return [0, n] if n else [0]
    a = np.frombuffer(data, np.uint8)
    h = _gear[a]
    for w in (1, 2, 4, 8, 16):  # then h[i] covers the 32 bytes that end at i
        h[w:] = h[w:] + (h[:-w] << np.uint32(w))
    starts = (a & 0xC0) != 0x80
    marks = np.flatnonzero((h[:-1] >> np.uint32(32 - MEAN_CHUNK.bit_length() + 1) == 0) & starts[1:]) + 1
    out = [0]
    for m in [*marks.tolist(), n]:
        while m - out[-1] > MOST_CHUNK:
            at = out[-1] + MOST_CHUNK
            while not starts[at]:
                at -= 1
            out.append(at)
        if m == n or m - out[-1] >= LEAST_CHUNK:
            out.append(m)
    return out if out[-1] == n else [*out, n]


def chunk_mark(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _token_at(ends: np.ndarray, byte: int) -> int | None:
    """Number of tokens before a byte position, if a token ends there."""
    if byte == 0:
        return 0
    i = int(np.searchsorted(ends, byte))
    return i + 1 if i < len(ends) and ends[i] == byte else None


def _borders_back(text: str):
    """A function that gives the last n borders of text, the last one first."""
    found: list[int] = []

    def last(n: int) -> list[int]:
        at = found[-1] if found else len(text) - 1
        while len(found) < n and (at := text.rfind(" ", 1, at)) > 0:
            if not text[at - 1].isspace() and not text[at + 1].isspace():
                found.append(at)
        return found[:n]

    return last


def _borders_on(text: str):
    """A function that gives the first n borders of text."""
    found: list[int] = []

    def first(n: int) -> list[int]:
        at = found[-1] if found else 0
        while len(found) < n and 0 < (at := text.find(" ", at + 1, len(text) - 1)):
            if not text[at - 1].isspace() and not text[at + 1].isspace():
                found.append(at)
        return found[:n]

    return first


def joined(coder: Coder, chunks: list[str], ids: list[np.ndarray]) -> np.ndarray:
    """Ids of the concatenated chunks, from the chunks' own ids, which are encoded again only around the joins."""
    done_text, done = "", np.empty(0, np.uint16)
    parts: list[np.ndarray] = []
    for text, own in zip(chunks, ids, strict=True):
        if not text:
            continue
        if not done_text:
            done_text, done = text, own
            continue
        left_ends, right_ends = np.cumsum(coder.lengths[done]), np.cumsum(coder.lengths[own])
        left, right = _borders_back(done_text), _borders_on(text)
        wide = 2
        while True:
            # One word more than needed on either side: it must come out as it was.
            la, ra = left(wide), right(wide)
            a, b = la[-1] if len(la) == wide else 0, ra[-1] if len(ra) == wide else len(text)
            again = coder.encode(done_text[a:] + text[:b])
            cut_a = _token_at(left_ends, int(left_ends[-1]) - len(done_text[a:].encode()))
            cut_b = _token_at(right_ends, len(text[:b].encode()))
            fits = cut_a is not None and cut_b is not None
            if fits and len(la) == wide:
                same = _token_at(left_ends, int(left_ends[-1]) - len(done_text[la[-2] :].encode()))
                fits = same is not None and np.array_equal(done[cut_a:same], again[: same - cut_a])
            if fits and len(ra) == wide:
                same = _token_at(right_ends, len(text[: ra[-2]].encode()))
                fits = same is not None and np.array_equal(own[same:cut_b], again[len(again) - (cut_b - same) :])
            if fits or (a == 0 and b == len(text)):
                break
            wide *= 2
        if fits:
            keep, rest = done[:cut_a], own[cut_b:]
        else:
            keep, rest = done[:0], own[:0]
        if b < len(text):
            # Words after b are settled on their left; what lies before is complete.
            parts += [keep, again]
            done_text, done = text[b:], rest
        else:
            parts.append(keep)
            done_text, done = done_text[a:] + text, again
    return np.concatenate([*parts, done]) if parts else done


def _pack(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def _unpack(data: bytes) -> bytes:
    return zstandard.decompress(data)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_ids, marks, sizes = [], [], []
        for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = t.as_py().encode("utf-8", "surrogatepass")
            at = cuts(data)
            for a, b in zip(at, at[1:], strict=False):
                doc_ids.append(doc_id)
                marks.append(chunk_mark(data[a:b]))
                sizes.append(b - a)
        yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(marks, pa.binary()), pa.array(sizes, pa.int32())], names=["doc_id", "mark", "size"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([_pack(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(1)], pa.binary())], names=["doc_id", "packed"])


def _result(c: Coder, ids: np.ndarray, digest: bool) -> tuple:
    """(packed ids, number, digest of ids, digest of the decoded text): the ids, or what is asked for in their place."""
    if not digest:
        return _pack(ids.tobytes()), len(ids), None, None
    of_text = hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()
    return None, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), of_text


def _encode_own(path: str, digest: bool):
    """Per text: its result, or, if it takes chunks of others, its own pieces' ids and the marks of those it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                todo, texts = [], []
                for doc_id, packed, taken, given in zip(*(part.column(n).to_pylist() for n in ("doc_id", "packed", "taken", "given")), strict=True):
                    data, taken, given = _unpack(packed), set(taken or ()), set(given or ())
                    at = cuts(data)
                    pieces = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
                    marks = [chunk_mark(x) for x in pieces] if taken or given else [None] * len(pieces)
                    strings = [x.decode("utf-8", "surrogatepass") for x in pieces]
                    texts += [x for x, m in zip(strings, marks, strict=True) if m is None or m not in taken]
                    todo.append((doc_id, packed, strings, marks, taken, given))
                encoded, rows = iter(c.encode_many(texts)), []
                for doc_id, packed, strings, marks, taken, given in todo:
                    own = [None if m is not None and m in taken else next(encoded) for m in marks]
                    out = [{"mark": m, "ids": x.tobytes()} for m, x in {m: x for m, x in zip(marks, own, strict=True) if m in given}.items()]
                    if taken:
                        whole = b"".join(x.tobytes() for x in own if x is not None)
                        wanted = [m if x is None else None for m, x in zip(marks, own, strict=True)]
                        rows.append((doc_id, packed, [0 if x is None else len(x) for x in own], wanted, out, _pack(whole), None, None, None))
                    else:
                        rows.append((doc_id, None, None, None, out, *_result(c, joined(c, strings, own), digest)))
                yield _rows(rows, OWN)

    return run


RESULT = [("ids", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
OWN = pa.schema([
    ("doc_id", pa.int64()), ("packed", pa.binary()), ("counts", pa.list_(pa.int32())), ("wanted", pa.list_(pa.binary())),
    ("given", pa.list_(pa.struct([("mark", pa.binary()), ("ids", pa.binary())]))), *RESULT,
])
RESULT_SQL = "ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
OWN_SQL = (
    "doc_id long, packed binary, counts array<int>, wanted array<binary>, given array<struct<mark: binary, ids: binary>>, " + RESULT_SQL
)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _finish(path: str, digest: bool):
    """Per text with borrowed chunks: the ids of its pieces put together and repaired."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch, rows = whole.slice(i, 64), []
                columns = (batch.column(n).to_pylist() for n in ("doc_id", "packed", "ids", "counts", "wanted", "found"))
                for doc_id, packed, ids, counts, wanted, found in zip(*columns, strict=True):
                    data, own = _unpack(packed), np.frombuffer(_unpack(ids), np.uint16)
                    have = {f["mark"]: np.frombuffer(f["ids"], np.uint16) for f in found}
                    at = cuts(data)
                    texts = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at, at[1:], strict=False)]
                    ends = np.cumsum(counts)
                    pieces = [own[e - n : e] if m is None else have[m] for n, e, m in zip(counts, ends, wanted, strict=True)]
                    rows.append((doc_id, *_result(c, joined(c, texts, pieces), digest)))
                yield _rows(rows, pa.schema([("doc_id", pa.int64()), *RESULT]))

    return run


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    texts = doc_texts(docs, id_col, text_col)
    marks = texts.mapInArrow(_marks, "doc_id long, mark binary, size int")
    seen = marks.groupBy("mark").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("mark", "owner")
    shared = write_table(seen, "shared-chunks")
    use = marks.join(shared, "mark").select("doc_id", "mark", (F.col("owner") == F.col("doc_id")).alias("own")).distinct()
    use = use.groupBy("doc_id").agg(
        F.collect_list(F.when(~F.col("own"), F.col("mark"))).alias("taken"), F.collect_list(F.when(F.col("own"), F.col("mark"))).alias("given")
    )
    packed = texts.mapInArrow(_packed, "doc_id long, packed binary")
    own = write_table(packed.join(use, "doc_id", "left").mapInArrow(_encode_own(path, digest), OWN_SQL), "own-ids")
    given = own.select(F.explode("given").alias("g")).select("g.mark", F.col("g.ids").alias("chunk")).dropDuplicates(["mark"])
    open_ = own.where("packed is not null")
    needs = open_.select("doc_id", F.explode(F.array_distinct(F.filter("wanted", lambda m: m.isNotNull()))).alias("mark"))
    found = needs.join(given, "mark").groupBy("doc_id").agg(F.collect_list(F.struct("mark", F.col("chunk").alias("ids"))).alias("found"))
    names = ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    finished = open_.select("doc_id", "packed", "ids", "counts", "wanted").join(found, "doc_id").mapInArrow(_finish(path, digest), f"doc_id long, {RESULT_SQL}")
    return own.where("packed is null").select(names).unionByName(finished)


def encoded_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens): the ids of every whole text, as zstd-packed little-endian unsigned 16-bit integers.

    Null and empty texts have no ids. Ids must be distinct: rows that repeat one are told apart by their text only if it
    is equal, so repeated rows keep one result each. Extra columns are ignored; an empty table gives an empty one.
    """
    return _encoded(docs, path, id_col, text_col, False).select("doc_id", "ids", "n_tokens")


def encoding_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the ids and the text decoded from them, as digests.

    Every row has a result, also where its id is null or repeated with another text; null and empty texts have no ids.
    Extra columns are ignored; an empty table gives an empty one.
    """
    return _encoded(docs, path, id_col, text_col, True).drop("ids")
