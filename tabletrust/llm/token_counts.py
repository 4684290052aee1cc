"""Token counts by a count-only Viterbi pass.

An Aho-Corasick automaton over the pieces of a unigram model lists every piece that ends at each
character. A best-path pass keeps, per character, the best score and the number of pieces on that
path; no path is kept and no token is made. Ties follow the tokenizers library: pieces are
tried from the left, and a later one must be better, so of equal paths the one whose last piece is
longest wins. A character without a piece of its own costs the smallest score less ten; with byte
fallback it counts as many pieces as it has UTF-8 bytes, otherwise a run of them counts as one.

Where no piece reaches over the start of a word, words are independent and each distinct word is
passed once per process, in a memory of bounded size. Scores add up in double precision.

Defined results: null and empty texts have no tokens. Every input row gives one result row, also when
rows repeat. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.llm.pieces import (
    MARKER, MODEL_FILE, NORMAL, UNUSED, USER_DEFINED, Model, parse_model,
)
from tabletrust.llm.text import as_texts, small_batches

#: What an unknown character costs more than the worst piece.
UNKNOWN_COST = 10.0
#: Words remembered by one process.
REMEMBERED = 400_000
_WORD = re.compile(" *[^ ]+| +")
#: The counter of this process, kept over its tasks.
_COUNTERS: dict[bytes, Counter] = {}


class Counter(dict):
    """The number of pieces of a word that follows a blank; new words are counted and remembered."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.words = model, model.words_independent
        known = [(p, s) for p, s, kind in model.pieces if kind in (NORMAL, UNUSED, USER_DEFINED)]
        self.automaton = ahocorasick.Automaton()
        for piece, score in known:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in known) - UNKNOWN_COST

    def __missing__(self, word: str) -> int:
        n = self.pieces(MARKER + word.replace(" ", MARKER))
        if len(self) < REMEMBERED:
            self[word] = n
        return n

    def pieces(self, text: str) -> int:
        """The number of pieces on the best path through `text`, which has its markers."""
        n, unknown, fallback = len(text), self.unknown, self.model.byte_fallback
        best, counts, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at, top, start, single = 0, None, 0, True

        def close(end: int) -> None:
            """Settle the character that ends at `end`, after all its pieces."""
            nonlocal top, start, single
            run = False
            if not single and (top is None or best[end - 1] + unknown > top):
                top, start, run = best[end - 1] + unknown, end - 1, not fallback
                more = not open_run[start] if run else len(text[start].encode())
            else:
                more = 1
            best[end], counts[end], open_run[end] = top, counts[start] + more, run
            top, single = None, False

        for last, (size, score) in self.automaton.iter(text):
            while at <= last:
                if at:
                    close(at)
                at += 1
                top, single = None, False
            total = best[at - size] + score
            if top is None or total > top or (total == top and at - size < start):
                top, start = total, at - size
            if size == 1:
                single = True
        while at <= n:
            if at:
                close(at)
            at += 1
        return counts[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        model = self.model
        if not self.words:
            if model.remove_extra_blanks:
                text = " ".join(text.split(" ")).strip(" ")
                text = re.sub(" {2,}", " ", text)
            text = " " + text if model.dummy_prefix else text
            return self.pieces(text.replace(" ", MARKER) if model.escape_blanks else text)
        text = text.replace(MARKER, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [w[1:] for w in _WORD.findall(" " + text)]
        else:
            words = text.split(" ")
        return sum(map(self.__getitem__, words))


def token_counts(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id, n_chars and n_tokens of each row, by the unigram reading of the model's pieces.

    The model must not have a normalisation table. The driver reads the file and sends it out.
    """
    with open(model_file, "rb") as f:
        raw = f.read()
    if parse_model(raw).charsmap:
        raise ValueError("models with a normalisation table are not counted here")
    data = docs.sparkSession.sparkContext.broadcast(raw)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if data.value not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[data.value] = Counter(parse_model(data.value))
        counter = _COUNTERS[data.value]
        for batch in small_batches(batches, "text"):
            texts = as_texts(batch.column("text"))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    "n_tokens": pa.array([counter.count(t) for t in texts], pa.int64()),
                }
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(counts, "doc_id bigint, n_chars bigint, n_tokens bigint")
