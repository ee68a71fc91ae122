"""Token counts under a unigram tokenizer, by dynamic programming shared over a trie of pre-tokens.

A pre-token is a word behind the mark U+2581. Its count is the number of pieces in its best segmentation:
the greatest sum of log-probabilities, fewer pieces on ties. Piece number r of the vocabulary has the
probability 1 / (r + OFFSET) up to a constant (Zipf's law; ranks are what public vocabularies tell). A
character that no piece covers costs UNKNOWN and counts as its UTF-8 bytes, as byte fallback gives.

Distinct pre-tokens of a task go into a trie of their characters. A node holds the best score of the prefix that leads to
it, and its pieces: both are computed once, when the node is made, from the nodes above it (as many as the longest piece has characters), and shared by all
pre-tokens below. A pre-token's count is stored at its terminal (of up to DEPTH characters). The trie lives as long as its task, and starts anew
beyond MEMORY nodes. It is DEPTH characters deep: what a longer pre-token has behind them is shared with nothing, and is
computed with the last scores alone, so that a word of any length costs no memory.

The vocabulary is read on the driver, a file of fixed size, and sent to the tasks. Documents stay in place.

Null and empty texts have 0 pre-tokens and 0 tokens. Repeated rows and null ids get a row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, OFFSET, UNKNOWN, MEMORY, DEPTH = "▁", 3, -25.0, 1_000_000, 64


def zipf_pieces(model_file: str) -> dict[str, float]:
    """Pieces of a SentencePiece model with their log-probabilities by rank, control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kept = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + OFFSET) for r in range(len(kept))))
    return {p: -math.log(r + OFFSET) - total for r, p in enumerate(kept)}


class Trie:
    """Distinct pre-tokens, with forward scores at their prefixes and counts at their terminals."""

    def __init__(self, pieces: dict[str, float], longest: int):
        self.pieces, self.longest = pieces, longest
        #: Of the last two characters of pieces, the pieces' lengths: no other piece needs a look.
        self.lengths: dict[str, tuple[int, ...]] = {}
        for p in pieces:
            if len(p) > 1:
                self.lengths[p[-2:]] = (*self.lengths.get(p[-2:], ()), len(p))
        self.lengths = {k: tuple(sorted(set(v))) for k, v in self.lengths.items()}
        self.children: list[dict[str, int]] = [{}]
        self.score, self.count = [0.0], [0]
        self.terminals: dict[str, int] = {}

    def insert(self, token: str) -> int:
        """The token count of the pre-token, from its terminal."""
        if (found := self.terminals.get(token)) is not None:
            return found
        node, scores, counts = 0, [0.0], [0]
        children, score, count = self.children, self.score, self.count
        for end, char in enumerate(token[:DEPTH], 1):
            below = children[node]
            node = below.get(char, 0)
            if not node:
                node = below[char] = len(children)
                children.append({})
                best, n = self._step(token, end, scores, counts)
                score.append(best)
                count.append(n)
            scores.append(score[node])
            counts.append(count[node])
        for end in range(DEPTH + 1, len(token) + 1):
            best, n = self._step(token, end, scores, counts)
            scores.append(best)
            counts.append(n)
            if len(scores) > 4 * self.longest + DEPTH:  # the last ones are all that is asked for
                del scores[: -self.longest], counts[: -self.longest]
        if len(token) <= DEPTH:
            self.terminals[token] = counts[-1]
        return counts[-1]

    def _step(self, token: str, end: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """Best score and pieces of token[:end], from those of the prefixes before it, the longest last."""
        get, best = self.pieces.get, scores[-1] + UNKNOWN
        p = get(token[end - 1])
        if p is not None and scores[-1] + p >= best:
            best, n = scores[-1] + p, counts[-1] + 1
        else:
            n = counts[-1] + len(token[end - 1].encode("utf-8", "replace"))
        for size in self.lengths.get(token[end - 2 : end], ()) if end > 1 else ():
            if size > end:
                break
            p = get(token[end - size : end])
            if p is not None:
                s = scores[-size] + p
                if s > best or (s == best and counts[-size] + 1 < n):
                    best, n = s, counts[-size] + 1
        return best, n


def counted(docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_pre_tokens, n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    longest = max(map(len, pieces), default=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value, longest)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [(t.as_py() or b"").split() for t in b.column(1)]
            known: dict[bytes, int] = {}
            for w in {w for words in texts for w in words}:
                if len(trie.children) + len(trie.terminals) > MEMORY:
                    trie = Trie(shared.value, longest)
                known[w] = trie.insert(MARK + w.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_pre_tokens": [len(t) for t in texts], "n_tokens": [sum(known[w] for w in t) for t in texts]})

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(count, "doc_id long, n_pre_tokens long, n_tokens long")
