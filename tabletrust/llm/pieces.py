"""SentencePiece models on the tokenizers library: encode, decode and verify.

The model file is read as a protobuf message by a few lines here: pieces with scores and kinds, the
model type, and the normaliser's settings. From these an equal tokenizer is built: normaliser, white
space marker, unigram scores or merges ranked by piece score, and byte fallback. Texts are encoded in
batches by the library's threads; ids can be verified against the sentencepiece library, and decoding
against the text.

If no piece has the white space marker behind another character, words are independent. Then each
distinct word goes through the library once per process and memory, and very long texts are cut at blanks
so that no encoding of a whole long text is ever held.

Defined results: null and empty texts have no ids and decode to the empty text. Every input row gives
one result row, also when rows repeat. A text that contains the marker itself does not round-trip
(the format cannot tell it from a blank), which `round_trip` shows.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.llm.text import as_texts, small_batches

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: Kinds of pieces in the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Threads of one task, characters in one call of the library, and per part of a long text.
THREADS, CALL_CHARS, PART_CHARS = 2, 1 << 20, 1 << 16
#: Words that one process remembers.
REMEMBERED = 500_000
#: The coder of this process, kept over its tasks.
_CODERS: dict[tuple, Coder] = {}


@dataclass
class Model:
    """What the encoders need to know of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_blanks: bool = True
    escape_blanks: bool = True

    @cached_property
    def unknown(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)

    @cached_property
    def words_independent(self) -> bool:
        """No piece reaches over the start of a word, and each word starts as the text does."""
        over = re.compile(f"[^{MARKER}]{MARKER}")
        return (
            self.dummy_prefix and self.escape_blanks and not self.remove_extra_blanks
            and not self.charsmap and not any(over.search(p) for p, _, _ in self.pieces)
        )


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, message[at : at + size]
            at += size


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            score = struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0]
            model.pieces.append((got[1].decode(), score, got.get(3, NORMAL)))
        elif number == 2:
            got = dict(_fields(value))
            model.kind, model.byte_fallback = got.get(3, UNIGRAM), bool(got.get(35, 0))
        elif number == 3:
            got = dict(_fields(value))
            model.charsmap = got.get(2, b"")
            model.dummy_prefix = bool(got.get(3, 1))
            model.remove_extra_blanks = bool(got.get(4, 1))
            model.escape_blanks = bool(got.get(5, 1))
    return model


def build(model: Model):
    """The tokenizers-library tokenizer that equals `model`."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    names = [p for p, _, _ in model.pieces]
    if model.kind == BPE:
        ids = {p: i for i, p in enumerate(names)}
        merges = []
        for i, (piece, score, kind) in enumerate(model.pieces):
            if kind in (NORMAL, UNUSED):
                cuts = ((piece[:k], piece[k:]) for k in range(1, len(piece)))
                merges += [(-score, i, ids[a], a, b) for a, b in cuts if a in ids and b in ids]
        core = models.BPE(
            vocab=ids, merges=[(a, b) for *_, a, b in sorted(merges)], unk_token=names[model.unknown],
            fuse_unk=True, byte_fallback=model.byte_fallback,
        )
    else:
        core = models.Unigram(
            [(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback
        )
    made = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if model.escape_blanks else " "))
    if model.escape_blanks:
        steps.append(normalizers.Replace(" ", MARKER))
    made.normalizer = normalizers.Sequence(steps)
    if model.words_independent:
        word = Regex(f"{MARKER}*[^{MARKER}]+|{MARKER}+")
        made.pre_tokenizer = pre_tokenizers.Split(word, "isolated")
    after = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        after.append(decoders.Strip(" ", 1, 0))
    made.decoder = decoders.Sequence(after)
    return made


def parts_of(text: str, model: Model, most: int = PART_CHARS) -> list[str]:
    """A long text cut at blanks that follow another character; the cut blank becomes the dummy prefix."""
    if len(text) <= most or not model.words_independent:
        return [text]
    parts, start = [], 0
    while len(text) - start > most:
        at = start + most
        while (at := text.find(" ", at)) > 0 and (text[at - 1] in f" {MARKER}"):
            at += 1
        if at < 0 or at == len(text) - 1:
            break
        parts.append(text[start:at])
        start = at + 1
    return [*parts, text[start:]]


def encode_all(texts: list[str], made, model: Model) -> list[np.ndarray]:
    """Ids of each text, in calls of bounded size."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        own = parts_of(text, model)
        parts += own
        owner += [i] * len(own)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    start = 0
    while start < len(parts):
        end, chars = start, 0
        while end < len(parts) and (end == start or chars + len(parts[end]) <= CALL_CHARS):
            chars += len(parts[end])
            end += 1
        coded = made.encode_batch_fast(parts[start:end], add_special_tokens=False)
        for i, code in zip(owner[start:end], coded):
            out[i].append(np.asarray(code.ids, np.int32))
        start = end
    return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


class Coder:
    """Encodes texts, remembers words, and tells how far ids can be trusted.

    Where words are independent each distinct word goes through the library once, many of them in
    one text, and a text's ids are its words' ids one behind another. With `other`, the
    sentencepiece library, a word is compared when it is met first, and so is decoding. Texts with
    runs of blanks, blanks at an end or markers, and all texts of other models, are encoded,
    compared and decoded whole.
    """

    def __init__(self, made, model: Model, other=None, threads: int = THREADS) -> None:
        self.made, self.model, self.other, self.threads = made, model, other, threads
        self.known: dict[str, bytes] = {}
        self.unlike: set[str] = set()
        self.lossy: set[str] = set()

    def code(self, texts: list[str]) -> list[tuple[np.ndarray, bool | None, bool]]:
        """(ids, agrees with the other library, decodes to the text) of each text."""
        out: list = [None] * len(texts)
        simple, rest = [], []
        for i, text in enumerate(texts):
            plain = self.model.words_independent and text and MARKER not in text
            plain = plain and "  " not in text and text[0] != " " != text[-1]
            (simple if plain else rest).append(i)
        for i in simple:
            out[i] = self._by_words(texts[i])
        ids = encode_all([texts[i] for i in rest], self.made, self.model)
        back = _decode_all(ids, self.made)
        for i, own, text in zip(rest, ids, back):
            like = np.array_equal(own, self.other.encode(texts[i])) if self.other else None
            out[i] = (own, like, text == texts[i])
        return out

    def _by_words(self, text: str) -> tuple[np.ndarray, bool | None, bool]:
        found, like, whole = [], True, True
        for part in parts_of(text, self.model, CALL_CHARS):
            words = part.split(" ")
            known = self.known
            new = list(set(words).difference(known))
            if new:
                known = self._learn(new)
                if known is not self.known:
                    known = known | {w: self.known[w] for w in set(words).difference(known)}
            found.append(b"".join(map(known.__getitem__, words)))
            like = like and not (self.unlike and not self.unlike.isdisjoint(words))
            whole = whole and not (self.lossy and not self.lossy.isdisjoint(words))
        return np.frombuffer(b"".join(found), np.int32), like if self.other else None, whole

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new words; they are remembered while there is room."""
        into = self.known if len(self.known) < REMEMBERED else {}
        lists = [new[i : i + 2_000] for i in range(0, len(new), 2_000)]
        joined = [" ".join(words) for words in lists]
        coded = self.made.encode_batch(joined, add_special_tokens=False)
        for words, text, code in zip(lists, joined, coded):
            ids, owner = np.array(code.ids, np.int32), np.array(code.word_ids)
            cuts = np.searchsorted(owner, np.arange(len(words) + 1))
            into.update(
                (w, ids[a:b].tobytes()) for w, a, b in zip(words, cuts.tolist(), cuts[1:].tolist())
            )
            if self.other:
                self._mark(words, into, self.unlike, lambda t, x: self.other.encode(t) == x)
            self._mark(words, into, self.lossy, lambda t, x: self.made.decode(x, False) == t)
        return into

    def _mark(self, words: list[str], ids: dict[str, bytes], bad: set[str], holds) -> None:
        """Put the words for which `holds` fails into `bad`; all in one text, then half of them."""
        own = np.frombuffer(b"".join(map(ids.__getitem__, words)), np.int32).tolist()
        if not holds(" ".join(words), own):
            if len(words) == 1:
                bad.update(words)
            else:
                self._mark(words[: len(words) // 2], ids, bad, holds)
                self._mark(words[len(words) // 2 :], ids, bad, holds)


def _decode_all(ids: list[np.ndarray], made) -> list[str]:
    return made.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


def _coder(data: bytes, threads: int, verify: bool) -> Coder:
    key = (data, threads, verify)
    if key not in _CODERS:
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        other = None
        if verify:
            import sentencepiece

            other = sentencepiece.SentencePieceProcessor(model_proto=data)
        model = parse_model(data)
        _CODERS.clear()
        _CODERS[key] = Coder(build(model), model, other, threads)
    return _CODERS[key]


def encode(
    docs: DataFrame, model_file: str = MODEL_FILE, threads: int = THREADS, verify: bool = True
) -> DataFrame:
    """doc_id, ids, n_ids, n_bytes (byte pieces), `round_trip` and `parity` of each row.

    `parity` says that the sentencepiece library gives the same ids; null without `verify`. The
    driver reads the model file, of some hundred KB, and sends it to every task.
    """
    with open(model_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(data.value, threads, verify)
        is_byte = np.array([kind == BYTE for _, _, kind in coder.model.pieces])
        for batch in small_batches(batches, "text"):
            ids, like, whole = zip(*coder.code(as_texts(batch.column("text"))))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "ids": pa.array(ids, pa.list_(pa.int32())),
                    "n_ids": pa.array([len(x) for x in ids], pa.int64()),
                    "n_bytes": pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                    "round_trip": pa.array(whole, pa.bool_()),
                    "parity": pa.array(like, pa.bool_()),
                }
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(
        code,
        "doc_id bigint, ids array<int>, n_ids bigint, n_bytes bigint, round_trip boolean,"
        " parity boolean",
    )


def decode(coded: DataFrame, model_file: str = MODEL_FILE, threads: int = THREADS) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give the empty text."""
    with open(model_file, "rb") as f:
        data = coded.sparkSession.sparkContext.broadcast(f.read())

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        made = build(parse_model(data.value))
        for batch in batches:
            ids = [x or [] for x in batch.column("ids").to_pylist()]
            texts = made.decode_batch(ids, skip_special_tokens=False)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": texts})

    rows = coded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids")
    return rows.mapInArrow(back, "doc_id bigint, text string")
