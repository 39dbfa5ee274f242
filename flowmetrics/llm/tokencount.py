"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton enumerates all vocabulary pieces in a text; dynamic
programming over positions carries the best score and its number of pieces
only.  Tie rules are the tokenizer's: a later candidate replaces an earlier
one only with a strictly higher score, candidates for a position come with the
longest piece first; a sign that is no piece by itself costs the lowest score
less 10, and neighbouring unknowns count as one token.

Spaces become U+2581 and one is put in front.  Where no piece has that sign
after another one, all paths meet before each run of it, so parts can be
counted alone and kept in a bounded cache; this is used if all scores are
whole numbers (sums are then exact in any order), else texts are counted
whole.

The default vocabulary holds the pieces and scores of ``VOCABULARY``.

Defined results: null and empty texts have 0 tokens and 0 characters; null and
repeated ids keep their rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
UNK_PENALTY = 10.0
CACHE_PARTS = 400_000


def load_vocabulary(name: str = VOCABULARY) -> tuple[list[tuple[str, float]], int]:
    """([(piece, score)], index of the unknown piece) of a public file."""
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    keep = [i for i in range(sp.get_piece_size())
            if sp.is_unknown(i) or not (sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in keep], [sp.is_unknown(i) for i in keep].index(True)


class CountViterbi:
    def __init__(self, vocab: list[tuple[str, float]], unk: int):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocab):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unk))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in vocab if len(p) == 1}
        self.unk_score = min(s for _, s in vocab) - UNK_PENALTY
        whole = all(float(s).is_integer() for _, s in vocab)
        inner = any(SPACE in p.lstrip(SPACE) for p, _ in vocab)
        self.by_part = whole and not inner and SPACE in self.singles
        self.cache: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """Number of tokens of the best path over ``text``."""
        n = len(text)
        score, count, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        found: list = [()] * (n + 1)
        for end, piece in self.automaton.iter(text):
            at = found[end + 1]
            if at:
                at.append(piece)
            else:
                found[end + 1] = [piece]
        singles = self.singles
        for end in range(1, n + 1):
            best = None
            for length, s, is_unk in found[end]:  # longest first
                v = score[end - length] + s
                if best is None or v > best:
                    best, start, u = v, end - length, is_unk
            if text[end - 1] not in singles:
                v = score[end - 1] + self.unk_score
                if best is None or v > best:
                    best, start, u = v, end - 1, True
            score[end], unk[end] = best, u
            count[end] = count[start] + (0 if u and unk[start] and start else 1)
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if text[0] != SPACE:
            text = SPACE + text
        if not self.by_part:
            return self.viterbi(text)
        total, cache = 0, self.cache
        for part in _PARTS.findall(text):
            c = cache.get(part)
            if c is None:
                c = self.viterbi(part)
                if len(part) <= 64:
                    if len(cache) >= CACHE_PARTS:
                        cache.clear()
                    cache[part] = c
            total += c
        return total


_PARTS = re.compile(f"{SPACE}+[^{SPACE}]*")


def token_counts(documents: DataFrame, vocab: list[tuple[str, float]] | None = None,
                 unk: int = 0) -> DataFrame:
    """doc_id, n_tokens, n_chars of every row.  ``vocab`` defaults to the
    public file, read by each task."""
    cols = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = cols.select("doc_id").schema.add("n_tokens", "long").add("n_chars", "long")

    def run(batches):
        counter = CountViterbi(*((vocab, unk) if vocab else load_vocabulary()))
        for b in batches:
            texts = [t.as_py() or "" for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.array([counter.count(t) for t in texts], np.int64)),
                 pa.array(np.array([len(t) for t in texts], np.int64))], schema.names)

    return cols.mapInArrow(run, schema)
