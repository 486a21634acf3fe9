"""Exact unigram token counts without tokenizing.

An Aho-Corasick automaton finds every vocabulary piece in a word; a dynamic program over the ends of matches keeps
the best score and the number of pieces on that path. Ties go as in the tokenizer: a path replaces another only if
its score is greater, and paths to an end are met in the order of the start of their last piece.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of unigram tokenizers: the word mark, and what an unknown character costs below the worst piece.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose count a worker keeps at a time; the memory is emptied when it is full.
CACHE_WORDS = 200_000
PIECES_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def load_pieces(path: str = PIECES_FILE) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in id order; id 0 stands for unknown characters."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Counts pieces of single words. Characters outside the vocabulary count as their UTF-8 bytes."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for p, score in dict(reversed(pieces)).items():  # of equal pieces the first counts
            self.find.add_word(p, (len(p), score))
        self.find.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.known = {c for p, _ in pieces for c in [p] if len(p) == 1}
        self.cache: dict[str, int] = {}

    def best(self, word: str) -> tuple[float, int]:
        """Score and number of pieces of the best path."""
        n = len(word)
        at: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (size, score) in self.find.iter(word):
            at[last + 1].append((size, score))
        scores, counts = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top, pieces = None, 0
            for size, score in sorted(at[end], reverse=True):  # the longest starts first
                s = scores[end - size] + score
                if top is None or s > top:
                    top, pieces = s, counts[end - size] + 1
            c = word[end - 1]
            if c not in self.known:
                s = scores[end - 1] + self.unknown
                if top is None or s > top:
                    top, pieces = s, counts[end - 1] + len(c.encode("utf-8", "surrogatepass"))
            scores[end], counts[end] = top, pieces
        return scores[n], counts[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if words[0] == "" and len(words) > 1:
            words = words[1:]
        total, cache = 0, self.cache
        for w in words:
            n = cache.get(w)
            if n is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                n = self.best(MARK + w)[1]
                if len(w) <= 64:
                    cache[w] = n
            total += n
        return total


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) per row of docs.

    The vocabulary, whose size does not depend on the data, is sent to the executors once. Null and empty texts
    have no tokens. Null and repeated keys and repeated rows are counted like others; an empty table gives no
    rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        counter = Counter(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counter.text(t.as_py()) for t in b.column(1)], pa.int64())], names=[key, "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, n_tokens long")
