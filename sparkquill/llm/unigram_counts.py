"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A text is cut at ASCII white space; each word with the mark U+2581 before it is a pre-token. A worker
keeps a trie. The distinct pre-tokens of a shard are inserted in sorted order, so neighbours go on
from their common path; each node, a prefix, gets its forward score once, when it is made: the best
log probability of a segmentation of the prefix, and the fewest tokens that reach it. The node where
a pre-token ends stores that count. Later shards find their prefixes and terminals there; a trie of
MOST_NODES is dropped and begun anew, which changes no count.

Pieces come from a sentencepiece model file, a parameter; nothing is trained. A unigram model's scores
are log probabilities. The scores of a merge model are only ranks: there a piece of rank r gets the
log probability of Zipf's law, log(1 / (r + 1)) less the log of their sum, so that frequent, early
merges are likelier and each further token costs. A character that no piece covers counts as its
UTF-8 bytes (byte fallback) and scores UNKNOWN below the worst piece. Of segmentations with equal
scores that with fewer tokens counts.

Defined results: null, empty and white-space texts have no pre-token and no token; each row is
counted, repeated or not; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm.common import kept_in_worker, table, text_chunks

MARK = "▁"
UNKNOWN = 10.0
#: Nodes of a worker's trie (about 0.2 KB each) beyond which it is begun anew, between shards.
MOST_NODES = 1_200_000
#: Characters of a pre-token that the trie holds; the rest of a longer one is computed and not stored.
DEEPEST = 200
#: Text of a shard.
SHARD_BYTES = 4 << 20

_SPACES = str.maketrans(dict.fromkeys("\t\n\v\f\r", " "))


def zipf(pieces: list[str]) -> dict[str, float]:
    """Log probabilities of pieces in the order of their ranks."""
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {x: -math.log(r + 1) - total for r, x in enumerate(pieces)}


class PieceTable:
    """Piece to log probability, of the normal pieces of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)}
        if all(s == int(s) for s in scores.values()):  # a merge model: minus the ranks
            scores = zipf(sorted(scores, key=scores.__getitem__, reverse=True))
        self.scores = scores
        self.longest = max(map(len, self.scores))
        self.unknown = min(self.scores.values()) - UNKNOWN


class TrieCounter:
    """Counts of pre-tokens. A trie node has its children, forward score, fewest tokens and, if a pre-token ends there, the stored count."""

    def __init__(self, pieces: PieceTable, kept: int = MOST_NODES):
        self.pieces, self.kept = pieces, kept
        self.made = 0  # nodes ever made, for tests
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node and character to node
        self.best, self.fewest = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def insert(self, words: list[str]) -> Iterator[tuple[str, int]]:
        """Each of the new pre-tokens, in sorted order, with its count; the trie holds their first DEEPEST characters."""
        scores, longest, unknown = self.pieces.scores, self.pieces.longest, self.pieces.unknown
        get, child = scores.get, self.child
        # The current path: its nodes, and score and tokens of every prefix.
        path, best, fewest, last = [0], [0.0], [0], ""
        for word in words:
            token = MARK + word
            same, most = 0, min(len(token), len(last))
            while same < most and token[same] == last[same]:
                same += 1
            del path[same + 1 :], best[same + 1 :], fewest[same + 1 :]
            for end in range(same + 1, len(token) + 1):
                char = token[end - 1]
                edge = path[-1] << 21 | ord(char)
                node = child.get(edge) if end <= DEEPEST else None
                if node is None:
                    if char in scores:
                        top, count = float("-inf"), 0
                    else:
                        top, count = best[-1] + unknown, fewest[-1] + len(char.encode("utf-8", "surrogatepass"))
                    for begin in range(max(0, end - longest), end):
                        s = get(token[begin:end])
                        if s is not None:
                            s += best[begin]
                            if s > top or s == top and fewest[begin] + 1 < count:
                                top, count = s, fewest[begin] + 1
                    self.made += 1
                    if end <= DEEPEST:
                        node = child[edge] = len(self.best)
                        self.best.append(top)
                        self.fewest.append(count)
                else:
                    top, count = self.best[node], self.fewest[node]
                if end <= DEEPEST:
                    path.append(node)
                best.append(top)
                fewest.append(count)
            last = token
            yield word, fewest[-1]

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text."""
        if len(self.best) > self.kept:
            self.clear()
        words = [x.translate(_SPACES).split(" ") if x else [] for x in texts]
        known, deep = self.terminal, {}
        new = {w for one in words for w in one if w not in known}
        new.discard("")
        for word, n in self.insert(sorted(new)):
            (known if len(word) < DEEPEST else deep)[word] = n
        known[""] = 0
        of = known.__getitem__ if not deep else lambda w: known[w] if w in known else deep[w]
        tokens = [sum(map(of, one)) for one in words]
        pre = [len(one) - one.count("") for one in words]
        return pre, tokens


def counter(path: str) -> TrieCounter:
    """The worker's trie for a model file, kept between tasks."""
    return kept_in_worker(("unigram", path), lambda: TrieCounter(PieceTable(path)))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for chunk, texts in text_chunks(batches, "text", SHARD_BYTES, keeps=True):
            pre, tokens = count(texts)
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"), default_model())


def brute_force(text: str | None, pieces: PieceTable) -> tuple[int, int]:
    """Pre-tokens and tokens of a text, each pre-token by a dynamic program of its own (for tests)."""
    words = [w for w in (text or "").translate(_SPACES).split(" ") if w]
    total = 0
    for w in words:
        token, state = MARK + w, {0: (0.0, 0)}
        for begin in range(len(token)):
            s, n = state[begin]
            steps = [(begin + k, pieces.scores[token[begin : begin + k]], 1) for k in range(1, pieces.longest + 1) if begin + k <= len(token) and token[begin : begin + k] in pieces.scores]
            if token[begin] not in pieces.scores:
                steps.append((begin + 1, pieces.unknown, len(token[begin].encode("utf-8", "surrogatepass"))))
            for end, gain, tokens in steps:
                old = state.get(end, (float("-inf"), 0))
                if (s + gain, -(n + tokens)) > (old[0], -old[1]):
                    state[end] = (s + gain, n + tokens)
        total += state[len(token)][1]
    return len(words), total
